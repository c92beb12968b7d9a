"""Token ids as flat binary files, and token counts found in such files by their separators.

A token folder holds, for every part ``p`` in ascending document order:

- ``part-p.bin``: the ids of its documents one after another, each document closed by the end id,
  as little-endian unsigned integers of 2 bytes (vocabularies up to 65,536 ids) or 4;
- ``part-p.idx``: n + 1 little-endian unsigned 64-bit offsets, counted in ids from the start of the
  first part (prefix sums over the parts give each part's base), so document i is [idx[i], idx[i+1]);
- ``part-p.ids``: the n document ids as signed 64-bit integers (-2**63: null);
- ``part-p.place``, if places were given: the n documents' places in the order they are to be read in, as signed 64-bit integers.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from pagewright.llm.common import keyed, public_id, text_slices
from pagewright.llm.storage import put, store
from pagewright.session import cut_lineage

#: Distinct words whose ids a process remembers; at the limit the memory starts anew.
CACHE_ENTRIES = 1_100_000
#: Ids in one block of the separator scan.
BLOCK_IDS = 1 << 20

_OTHER_SPACE = re.compile(r"[^\S \n]")


def _ids(fs, path: str, dtype: str, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids [start, stop) of a flat file: memory-mapped where the folder is local, a ranged read elsewhere."""
    if isinstance(fs, pafs.LocalFileSystem):
        whole = fs.get_file_info(path).size
        return np.memmap(path, dtype, "r")[start:stop] if whole else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        width = np.dtype(dtype).itemsize
        stop = f.size() // width if stop is None else stop
        return np.frombuffer(f.read_at((stop - start) * width, start * width), dtype)


class Encoder:
    """Ids of whole texts through the ``tokenizers`` library, each distinct word encoded once.

    Byte-level BPE never joins across "non-space, one space, non-space". A text whose spaces all stand so is the ids of
    its first word and of every further word with the space before it; others are encoded whole.
    Special-token strings in a text are ordinary text, or with ``special`` the ids the vocabulary gives them, as the
    library does by itself.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}  # word: ids of " word"
        signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
        self.signs = dict(zip(signs, [i.tobytes() for i in self._ids(signs)]))
        self.packed = [struct.Struct(f"<{n}{'H' if self.dtype == '<u2' else 'I'}").pack for n in range(32)]
        # byte-level vocabularies spell a byte that is no visible Latin-1 character as the next one past 255
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.spell = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Ids of new words. Letters alone are one piece of the vocabulary's splitter, and a sign after them another, so
        such words go straight to its model; the rest is encoded as text."""
        known, signs, model = self.known, self.signs, self.tokenizer.model.tokenize
        space, table, rest = self.spell[32], self.spell, []
        packed, number = self.packed, attrgetter("id")

        def letters(word: str) -> bytes:
            spelt = word if word.isascii() else word.encode().decode("latin-1").translate(table)
            ids = list(map(number, model(space + spelt)))
            return packed[len(ids)](*ids) if len(ids) < len(packed) else np.array(ids, self.dtype).tobytes()

        for word in words:
            if word.isalpha():
                known[word] = letters(word)
            elif word[-1:] in signs and word[:-1].isalpha():
                base = word[:-1]
                ids = known.get(base)
                if ids is None:
                    ids = known[base] = letters(base)
                known[word] = ids + signs[word[-1]]
            else:
                rest.append(word)
        known.update(zip(rest, [i.tobytes() for i in self._ids([" " + w for w in rest])]))

    def encode(self, texts: list[str]) -> list[bytes]:
        even = [bool(t) and not ("  " in t or " \n" in t or "\n " in t or t[0] in " \n" or t[-1] in " \n"
                                 or _OTHER_SPACE.search(t)) for t in texts]
        if self.special:
            even = [e and not any(s in t for s in self.special) for e, t in zip(even, texts)]
        words = [t.split(" ") for t, e in zip(texts, even) if e]
        seen = set().union(*words)
        new = seen.difference(self.known)
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self.known.clear()
            new = seen
        self._learn(list(new))
        firsts = iter(self._ids([w[0] for w in words]))
        others = iter(self._ids([t for t, e in zip(texts, even) if not e]))
        rows, find = iter(words), self.known.__getitem__
        return [next(firsts).tobytes() + b"".join(map(find, next(rows)[1:])) if e else next(others).tobytes()
                for e in even]


def encoder_of(path: str, special: bool = False) -> Encoder:
    """This process's encoder. Worker processes outlive tasks, so what one task learned helps the next."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_pagewright_encoders", {})
    if (path, special) not in held:
        held[path, special] = Encoder(path, special)
    return held[path, special]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, ordered: bool = True,
                 special: bool = False, place: str | None = None) -> DataFrame:
    """Encode every row of ``docs`` (doc_id, text) into a token folder; returns its manifest.

    The manifest has a row per part: part, n_docs, n_tokens, base (ids in earlier parts), dtype.
    Documents stand in ascending doc_id order (null first), ties by a hash of the text; repeated rows are all
    written. A null or empty text is its end id alone. An empty table gives no part. Other columns
    are ignored. Rows are dealt by ranges of (doc_id, hash of text, row), so neither a doc_id nor
    a text that fills a third of the rows makes a large part. Parts are written by tasks
    that can be run again; memory is bounded by a slice of rows, or by one document. Without ``ordered``
    the rows are written as they are read, in no promised order and with no shuffle. ``special``: strings of special tokens
    in a text get their ids; without it they are ordinary text, so no text can hold an end id. ``place``: a long column
    without nulls, kept beside the ids; it decides nothing but which of two equal rows stands first.
    """
    key = keyed(docs) if place is None else keyed(docs, "doc_id", "text", F.col(place).cast("long").alias("_place"))
    key = key.withColumn("_n", F.monotonically_increasing_id())
    # monotonically_increasing_id differs between equal rows only, whose files are equal in any order
    rows = key.repartitionByRange("_id", "_th", "_n").sortWithinPartitions(
        "_id", "_th", "_text", *([] if place is None else ["_place"])) if ordered else key

    def write(batches):
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        part, encoder = TaskContext.get().partitionId(), encoder_of(tokenizer, special)
        end = np.array([end_id], encoder.dtype).tobytes()
        ids, sizes, places = [], [], []

        def pieces():
            for batch in batches:
                ids.extend(batch.column("_id").to_pylist())
                if place is not None:
                    places.extend(batch.column("_place").to_pylist())
                for _, texts in text_slices(batch, "_text", as_bytes=False):
                    found = encoder.encode(texts)
                    sizes.extend(len(x) // len(end) + 1 for x in found)
                    yield b"".join(x + end for x in found)

        stream = pieces()
        first = next(stream, None)
        if first is None:
            return
        name = f"{root}/part-{part:05d}"
        put(fs, f"{name}.bin", (p for chunk in ([first], stream) for p in chunk))
        put(fs, f"{name}.ids", [np.array(ids, "<i8").tobytes()])
        if place is not None:
            put(fs, f"{name}.place", [np.array(places, "<i8").tobytes()])
        offsets = np.zeros(len(sizes) + 1, "<u8")
        np.cumsum(sizes, out=offsets[1:])
        put(fs, f"{name}.off", [offsets.tobytes()])
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()),
            "n_tokens": pa.array([int(offsets[-1])], pa.int64()), "dtype": [encoder.dtype]})

    counted = cut_lineage(rows.mapInArrow(write, "part int, n_docs long, n_tokens long, dtype string"))
    # one row per part: a window over them is a prefix sum of a few thousand rows
    bases = counted.withColumn("base", F.coalesce(F.sum("n_tokens").over(
        W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))

    def shift(batches):
        fs, root = store(folder)
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist()):
                name = f"{root}/part-{part:05d}"
                put(fs, f"{name}.idx", [(_ids(fs, f"{name}.off", "<u8") + np.uint64(base)).tobytes()])
            yield batch

    return cut_lineage(_dealt(bases).mapInArrow(shift, bases.schema))


def _dealt(parts: DataFrame) -> DataFrame:
    """One task for every few parts, whatever the rows' size in the manifest."""
    return parts.repartition(max(1, parts.count() // 2), "part")


def read_tokens(manifest: DataFrame, folder: str, place: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from a token folder's files.

    ``ids_crc32`` is the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers. ``place`` names a further column
    for the places the folder was written with.
    """
    def read(batches):
        fs, root = store(folder)
        for batch in batches:
            for part, dtype in zip(batch.column("part").to_pylist(), batch.column("dtype").to_pylist()):
                name = f"{root}/part-{part:05d}"
                tokens, offsets = _ids(fs, f"{name}.bin", dtype), _ids(fs, f"{name}.idx", "<u8").astype("i8")
                ids = _ids(fs, f"{name}.ids", "<i8")
                places = None if place is None else _ids(fs, f"{name}.place", "<i8")
                for at in range(0, len(ids), 10_000):
                    to = min(at + 10_000, len(ids))
                    local = offsets[at:to + 1] - offsets[0]
                    some = memoryview(tokens[local[0]:local[-1]].astype("<u4").tobytes())
                    cuts = ((local - local[0]) * 4).tolist()
                    crcs = [zlib.crc32(some[a:b]) for a, b in zip(cuts, cuts[1:])]
                    yield pa.RecordBatch.from_pydict({
                        "_id": pa.array(ids[at:to], pa.int64()), "start": pa.array(offsets[at:to], pa.int64()),
                        "n_tokens": pa.array(np.diff(local), pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())} | (
                            {} if place is None else {"_place": pa.array(places[at:to], pa.int64())}))

    schema = "_id long, start long, n_tokens long, ids_crc32 long"
    rows = _dealt(manifest).mapInArrow(read, schema if place is None else f"{schema}, _place long")
    named = [] if place is None else [F.col("_place").alias(place)]
    return rows.select(public_id().alias("doc_id"), "start", "n_tokens", "ids_crc32", *named)


def scan_tokens(spark: SparkSession, folder: str, end_id: int, dtype: str = "<u2",
                block_ids: int = BLOCK_IDS) -> DataFrame:
    """(doc_no, start, n_tokens, closed) of every document in the ``*.bin`` files of a folder.

    Reads only the flat files, in name order, no index: blocks of ``block_ids`` ids are searched for
    ``end_id`` by one vector comparison; a scan over the blocks' (separators, last separator) gives
    each block the number of documents begun before it and where the open one started; a second
    search then cuts the documents. n_tokens counts the end id; documents may
    cross blocks and files. Ids after the last separator are a document with ``closed`` false.
    Empty files and an empty or missing folder give no rows.
    """
    fs, root = store(folder)
    width = np.dtype(dtype).itemsize
    infos = sorted((i for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
                    if i.path.endswith(".bin")), key=lambda i: i.path)
    base, files = 0, []
    for number, info in enumerate(infos):  # one row per file
        files.append((number, info.path, base, info.size // width))
        base += info.size // width
    total = base
    blocks = (spark.createDataFrame(files, "file int, path string, base long, n long").filter("n > 0")
              .select("file", "path", "base", "n", F.explode(F.sequence(
                  F.lit(0).cast("long"), F.expr(f"(n - 1) div {block_ids}"))).alias("block"))
              .repartition("file", "block"))

    def found(path, base, n, block, fs):
        ids = _ids(fs, path, dtype, block * block_ids, min(n, (block + 1) * block_ids))
        return np.flatnonzero(ids == end_id) + (base + block * block_ids)

    def summarise(batches):
        fs, _ = store(folder)
        for batch in batches:
            seen = [found(r["path"], r["base"], r["n"], r["block"], fs) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len(s) for s in seen], pa.int64()),
                 pa.array([int(s[-1]) if len(s) else -1 for s in seen], pa.int64())],
                [*batch.schema.names, "seps", "last"])

    sums = cut_lineage(blocks.mapInArrow(
        summarise, "file int, path string, base long, n long, block long, seps long, last long"))
    # two levels, so that no task sees more than one file's blocks or one row per file
    in_file = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    over_files = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    per_file = sums.groupBy("file").agg(F.sum("seps").alias("_s"), F.max("last").alias("_l")).select(
        "file", F.coalesce(F.sum("_s").over(over_files), F.lit(0)).alias("_before"),
        F.coalesce(F.max("_l").over(over_files), F.lit(-1)).alias("_open"))
    scanned = sums.join(per_file, "file").select(
        "file", "path", "base", "n", "block",
        (F.coalesce(F.sum("seps").over(in_file), F.lit(0)) + F.col("_before")).alias("first_no"),
        (F.greatest(F.coalesce(F.max("last").over(in_file), F.lit(-1)), F.col("_open")) + 1).alias("first_start"))

    def cut(batches):
        fs, _ = store(folder)
        for batch in batches:
            for r in batch.to_pylist():
                ends = found(r["path"], r["base"], r["n"], r["block"], fs) + 1
                starts, no = np.concatenate([[r["first_start"]], ends])[:len(ends)], r["first_no"]
                closed = np.ones(len(ends), bool)
                if r["base"] + min(r["n"], (r["block"] + 1) * block_ids) == total:
                    last = int(ends[-1]) if len(ends) else r["first_start"]
                    if last < total:
                        starts, ends = np.append(starts, last), np.append(ends, total)
                        closed = np.append(closed, False)
                yield pa.RecordBatch.from_pydict({
                    "doc_no": pa.array(no + np.arange(len(ends)), pa.int64()),
                    "start": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array(ends - starts, pa.int64()), "closed": pa.array(closed)})

    return scanned.repartition("file", "block").mapInArrow(
        cut, "doc_no long, start long, n_tokens long, closed boolean")


def document_numbers(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_no, doc_id): which document stands at which place of a token folder."""
    firsts = manifest.withColumn("_first", F.coalesce(F.sum("n_docs").over(
        W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))

    def read(batches):
        fs, root = store(folder)
        for batch in batches:
            for part, first in zip(batch.column("part").to_pylist(), batch.column("_first").to_pylist()):
                ids = _ids(fs, f"{root}/part-{part:05d}.ids", "<i8")
                yield pa.RecordBatch.from_pydict({
                    "doc_no": pa.array(first + np.arange(len(ids)), pa.int64()), "_id": pa.array(ids, pa.int64())})

    return _dealt(firsts).mapInArrow(read, "doc_no long, _id long").select(
        "doc_no", public_id().alias("doc_id"))
