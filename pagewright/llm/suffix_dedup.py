"""Substring duplicates by a distributed suffix array built with difference covers.

1. Texts are packed into slices of half a megabyte, the batches of one Arrow file per task in the shared checkpoint
   folder; a table row only names a slice, so a pass holds one slice at a time. All 50-byte strings of a slice are
   split among content-chosen anchors (``windows``), and neighbours with one anchor form a block.
   Blocks deal the suffixes out: equal 50-byte strings always lie in blocks of one anchor.
2. Anchors that stand in one block of the corpus only are left out (short anchor keys are compared by bucket).
3. Equal blocks are one block: all but those of the smallest doc_id are duplicates as a whole. Blocks travel packed, as
   records in binary values dealt by anchor; those of an anchor met in very many slices travel as rows instead,
   which aggregate before the shuffle and split in joins.
4. Where an anchor still has different blocks that agree on half a window on one side of it, their suffixes are sorted: the sampled triples of the difference
   cover {1, 2} mod 3 are sorted and named, names are sorted by recursion, the remaining suffixes are merged
   in, and neighbours of the suffix array are compared on their first 50 bytes.
   An anchor with very many different blocks would be one large sort; its suffixes are cut to 50
   bytes and sorted apart by value instead, which gives the same neighbours.
5. Every slice then removes what its marks cover.

What slices must know (shared anchors, wanted blocks, marks) is written as one file per slice in the
shared checkpoint folder, so texts are never shuffled.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pagewright.llm.common import keyed, public_id, text_slices
from pagewright.llm.storage import put, store
from pagewright.llm.windows import covered, runs_of
from pagewright.session import cut_lineage, scratch_path

SIZE, GRAM = 50, 16
SLICE_BYTES = 1 << 19
#: Bytes of anchor keys in a bucket; bytes of text sorted at once; different blocks from which an anchor is cut up.
BUCKET_BYTES, SORT_BYTES, CROWD = 4 << 20, 1 << 19, 2_000
#: Bytes of text that a task of a pass over the slices reads.
TASK_BYTES = 8 << 20
#: Bytes of block records in a bucket if all were shared; slices from which an anchor's blocks travel as rows.
RECORD_BYTES, HOT_SLICES = 16 << 20, 4_096
_KEY_BYTES = 5
_BYTE_HASH = np.random.default_rng(50).integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``s`` (integers >= 1, at most about a million) in sorted order."""
    n = len(s)
    if n < 32:
        rows = s.tolist()
        return np.array(sorted(range(n), key=lambda i: rows[i:]), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    # 1. sort the sampled triples (positions 1 and 2 mod 3; one past the end where that evens the halves) and name them
    positions = np.arange(n + (n % 3 == 1))
    sample = positions[positions % 3 != 0]
    order = sample[np.lexsort((t[sample + 2], t[sample + 1], t[sample]))]
    differs = np.zeros(len(order), bool)
    for k in range(3):
        differs[1:] |= t[order[1:] + k] != t[order[:-1] + k]
    rank = np.zeros(n + 4, np.int64)
    rank[order] = np.cumsum(differs) + 1
    # 2. recurse on the names where some are equal
    if rank[order[-1]] < len(order):
        halves = np.concatenate([sample[sample % 3 == 1], sample[sample % 3 == 2]])
        order = halves[suffix_array(rank[halves])]
        rank[order] = np.arange(1, len(order) + 1)
    # 3. sort the remaining suffixes by first symbol and the rank after it, and merge
    rest = np.arange(0, n, 3)
    rest = rest[np.lexsort((rank[rest + 1], t[rest]))]
    order = order[order < n]
    one, two = order[order % 3 == 1], order[order % 3 == 2]
    wide, symbols = n + 4, int(t.max()) + 1
    by_one = lambda i: t[i] * wide + rank[i + 1]
    by_two = lambda i: (t[i] * symbols + t[i + 1]) * wide + rank[i + 2]
    at = np.arange(len(rest)) + np.searchsorted(by_one(one), by_one(rest)) + np.searchsorted(by_two(two), by_two(rest))
    out, free = np.empty(n, np.int64), np.ones(n, bool)
    out[at], free[at] = rest, False
    out[free] = order
    return out


def later_windows(texts: list[bytes], counts: np.ndarray, owners: np.ndarray, size: int = SIZE):
    """(text number, window) of the first ``counts[i]`` windows of each text that a text of a smaller owner holds too."""
    lengths = np.array([len(t) for t in texts])
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    s = raw.astype(np.int64) + 2
    s[begin[1:] - 1] = 1  # ends of texts
    number = np.repeat(np.arange(len(texts)), lengths + 1)
    offset = np.arange(len(s)) - begin[number]
    suffixes = suffix_array(s)
    suffixes = suffixes[offset[suffixes] < counts[number[suffixes]]]
    grams = np.lib.stride_tricks.sliding_window_view(raw, size)
    first = np.ones(len(suffixes), bool)
    for at in range(1, len(suffixes), 1 << 17):  # compare neighbours
        to = min(at + (1 << 17), len(suffixes))
        first[at:to] = (grams[suffixes[at:to]] != grams[suffixes[at - 1:to - 1]]).any(1)
    starts = np.flatnonzero(first)
    own = owners[number[suffixes]]
    least = np.repeat(np.minimum.reduceat(own, starts), np.diff(np.append(starts, len(own)))) if len(own) else own
    late = suffixes[own > least]
    return number[late], offset[late]


_TEXTS = pa.schema([("ids", pa.int64()), ("texts", pa.binary())])


def _slices(docs: DataFrame) -> tuple[DataFrame, int]:
    """(slice, file) of rows packed as they are read, dealt out by size, and the bytes of all texts.

    Slice s is batch s % 2 ** 32 of its file. Every attempt of a task writes a file of its own, and the rows that
    Spark keeps of it name that file.
    """
    folder = scratch_path(docs.sparkSession, "slices")

    def pack(batches):
        context, sizes = TaskContext.get(), []
        part, path = context.partitionId(), f"{folder}/{context.partitionId()}-{context.taskAttemptId()}"
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        options = pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)
        with fs.open_output_stream(store(path)[1]) as sink, pa.ipc.new_file(sink, _TEXTS, options=options) as out:
            for batch in batches:
                for first, texts in text_slices(batch, "_text", SLICE_BYTES):
                    out.write_batch(pa.RecordBatch.from_arrays(
                        [batch.column("_id").slice(first, len(texts)), pa.array(texts, pa.binary())], schema=_TEXTS))
                    sizes.append(sum(map(len, texts)))
        yield pa.RecordBatch.from_arrays([
            pa.array([(part << 32) + n for n in range(len(sizes))], pa.int64()), pa.array([path] * len(sizes), pa.string()),
            pa.array(sizes, pa.int64())], ["slice", "file", "bytes"])

    slices = cut_lineage(keyed(docs).select("_id", "_text").mapInArrow(pack, "slice long, file string, bytes long"))
    total = slices.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    return slices.select("slice", "file").repartition(total // TASK_BYTES + 1), total


def _each(batches):
    """(slice number, ids, texts) of every slice row."""
    path = reader = None
    for batch in batches:
        for s, file in zip(batch.column("slice").to_pylist(), batch.column("file").to_pylist()):
            if file != path:
                fs, name = store(file)
                path, reader = file, pa.ipc.open_file(fs.open_input_file(name), options=pa.ipc.IpcReadOptions(use_threads=False))
            ids, texts = reader.get_batch(s % (1 << 32)).columns
            yield s, ids.to_numpy(), texts.to_pylist()


def _runs(texts: list[bytes], size: int, gram: int):
    return runs_of([_BYTE_HASH[np.frombuffer(t, np.uint8)] for t in texts], size, gram)


def _keys(anchor: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A slice's distinct short anchor keys ordered by bucket, their buckets, and each run's key number."""
    bucket = (anchor >> np.uint64(44)) % np.uint64(buckets)
    short = anchor & np.uint64((1 << 8 * _KEY_BYTES) - 1)
    both, back = np.unique((bucket << np.uint64(8 * _KEY_BYTES)) | short, return_inverse=True)
    return both & np.uint64((1 << 8 * _KEY_BYTES) - 1), (both >> np.uint64(8 * _KEY_BYTES)).astype(np.int64), back


def _per_slice(rows: DataFrame, folder: str, order: list[str]) -> None:
    """Write each slice's ``data`` (binary), joined in order, as the file ``folder``/slice."""
    def run(batches):
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        now, pieces = None, []
        for batch in batches:
            for s, data in zip(batch.column("slice").to_pylist(), batch.column("data").to_pylist()):
                if s != now and pieces:
                    put(fs, f"{root}/{now}", pieces)
                    pieces = []
                now = s
                pieces.append(data)
        if pieces:
            put(fs, f"{root}/{now}", pieces)
        yield pa.RecordBatch.from_pydict({"done": pa.array([1], pa.int32())})

    (rows.repartition("slice").sortWithinPartitions("slice", *order).select("slice", "data")
     .mapInArrow(run, "done int").agg(F.sum("done")).collect())


def _read(fs, path: str) -> bytes:
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return b""
    with fs.open_input_file(path) as f:
        return f.read()


_RUN = np.dtype([("anchor", "<u8"), ("block", "<u8"), ("_id", "<i8"), ("ord", "<i4"), ("start", "<i4"), ("count", "<i4"),
                 ("left", "<u4"), ("right", "<u4")])
_WANTED = np.dtype([("ord", "<i4"), ("start", "<i4"), ("count", "<i4"), ("_id", "<i8"), ("anchor", "<u8")])
_MARK = np.dtype([("ord", "<i4"), ("start", "<i4"), ("count", "<i4")])
#: Kinds of packed values: covered runs, blocks to be sorted, blocks to be cut up, blocks that travel as rows.
MARKS, WANTED, CROWDED, HOT = range(4)
_KIND = {MARKS: _MARK, WANTED: _WANTED, CROWDED: _WANTED, HOT: _RUN}


def _by_slice(kind: int, slices: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """(kind, slice, data): records as bytes, one value per slice."""
    order = np.argsort(slices, kind="stable")
    found, cuts = np.unique(slices[order], return_index=True)
    wanted = np.zeros(len(records), _KIND[kind])
    for name in wanted.dtype.names:
        wanted[name] = records[name]
    parts = np.split(wanted[order], cuts[1:]) if len(found) else []
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(found), kind), pa.int32()), pa.array(found, pa.int64()),
        pa.array([x.tobytes() for x in parts], pa.binary())], ["kind", "slice", "data"])


_PACKED = "kind int, slice long, data binary"


def _pack(rows: DataFrame, kind: int) -> DataFrame:
    """Rows with ``slice`` and the fields of the kind, packed."""
    names = _KIND[kind].names

    def run(batches):
        for batch in batches:
            records = np.zeros(batch.num_rows, _KIND[kind])
            for name in names:
                column = batch.column(name).to_numpy(zero_copy_only=False)
                records[name] = column.view("<u8") if records[name].dtype == "<u8" else column
            yield _by_slice(kind, batch.column("slice").to_numpy(zero_copy_only=False), records)

    return rows.select("slice", *names).mapInArrow(run, _PACKED)


def _shared_anchors(slices: DataFrame, size: int, gram: int, total: int) -> tuple[str, int]:
    """Writes, per slice, how often its anchor keys occur (once, more, in very many slices); (folder, buckets)."""
    buckets = max(1, int(total * 2 / (size - gram + 2) * _KEY_BYTES) // BUCKET_BYTES + 1)
    folder = scratch_path(slices.sparkSession, "shared")

    def emit(batches):
        for s, _, texts in _each(batches):
            keys, bucket, _ = _keys(_runs(texts, size, gram).anchor, buckets)
            raw = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([
                pa.array(some, pa.int32()), pa.array([s] * len(some), pa.int64()),
                pa.array([raw[cuts[b]:cuts[b + 1]].tobytes() for b in some], pa.binary())], ["bucket", "slice", "keys"])

    def compare(table: pa.Table) -> pa.Table:
        blobs = table.column("keys").to_pylist()
        sizes = np.array([len(b) // _KEY_BYTES for b in blobs])
        wide = np.zeros((sizes.sum(), 8), np.uint8)
        wide[:, :_KEY_BYTES] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, _KEY_BYTES)
        _, back, times = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
        ends = np.cumsum(sizes)[:-1]
        levels = [np.split(times[back] > n, ends) for n in (1, HOT_SLICES)]
        head = zip(table.column("bucket").to_pylist(), sizes.tolist())
        return pa.table({
            "slice": table.column("slice"), "bucket": table.column("bucket"),
            "data": pa.array([struct.pack("<ii", b, n) + np.packbits(x).tobytes() + np.packbits(y).tobytes()
                              for (b, n), x, y in zip(head, *levels)], pa.binary())})

    _per_slice(slices.mapInArrow(emit, "bucket int, slice long, keys binary").groupBy("bucket").applyInArrow(
        compare, "slice long, bucket int, data binary"), folder, ["bucket"])
    return folder, buckets


def _judge(slice_: np.ndarray, r: np.ndarray):
    """[(kind, slices, records)]: whole duplicates, and blocks whose anchor has other blocks of smaller documents."""
    order = np.lexsort((r["_id"], r["block"], r["anchor"]))
    r, slice_ = r[order], slice_[order]
    new_anchor = np.ones(len(r), bool)
    new_anchor[1:] = r["anchor"][1:] != r["anchor"][:-1]
    new_block = new_anchor.copy()
    new_block[1:] |= r["block"][1:] != r["block"][:-1]
    block = np.cumsum(new_block) - 1
    least = r["_id"][new_block]                       # ids are sorted inside a block
    anchor = np.cumsum(new_anchor[new_block]) - 1     # anchor of a block
    starts = np.flatnonzero(new_anchor[new_block])
    kinds = np.bincount(anchor)
    mixed = np.minimum.reduceat(least, starts) < np.maximum.reduceat(least, starts)
    # a block shares a window with another only if they agree on half a window beside the anchor
    agree = np.zeros(len(least), bool)
    for side in ("left", "right"):
        value = r[side][new_block]
        k = np.flatnonzero((value != 0) & mixed[anchor])
        _, back, times = np.unique((anchor[k].astype(np.uint64) << np.uint64(32)) | value[k], return_inverse=True, return_counts=True)
        agree[k] |= times[back] > 1
    late = r["_id"] > least[block]
    open_ = ~late & agree[block]
    crowded = kinds[anchor[block]] > CROWD
    return [(kind, slice_[k], r[k]) for kind, k in (
        (MARKS, late), (WANTED, open_ & ~crowded), (CROWDED, open_ & crowded))]


def _judged(slices: DataFrame, size: int, gram: int, total: int) -> DataFrame:
    """(kind, slice, data) over all blocks of shared anchors."""
    folder, buckets = _shared_anchors(slices, size, gram, total)
    deals = max(1, int(total * 2 / (size - gram + 2) * _RUN.itemsize) // RECORD_BYTES + 1)

    def keep(batches):
        fs, root = store(folder)
        for s, ids, texts in _each(batches):
            r = _runs(texts, size, gram)
            keys, _, back = _keys(r.anchor, buckets)
            data, at, levels = _read(fs, f"{root}/{s}"), 0, ([], [])
            while at < len(data):
                _, n = struct.unpack_from("<ii", data, at)
                width = (n + 7) // 8
                for i, level in enumerate(levels):
                    level.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at + 8 + i * width), count=n))
                at += 8 + 2 * width
            shared, hot = (np.concatenate(x).astype(bool) if x else np.zeros(0, bool) for x in levels)
            shared = shared | (np.bincount(back, minlength=len(keys)) > 1)
            k = np.flatnonzero(shared[back])
            records = np.zeros(len(k), _RUN)
            for name, column in (("anchor", r.anchor), ("block", r.block), ("ord", r.doc), ("start", r.start), ("count", r.count)):
                records[name] = column[k]
            for name, column in (("left", r.left), ("right", r.right)):
                records[name] = column[k] >> np.uint64(32) | (column[k] > 0)
            records["_id"] = ids[r.doc[k]]
            deal = np.where(hot[back[k]], -1 - s % deals, ((records["anchor"] >> np.uint64(20)) % np.uint64(deals)).astype(np.int64))
            order = np.argsort(deal, kind="stable")
            found, cuts = np.unique(deal[order], return_index=True)
            parts = np.split(records[order], cuts[1:]) if len(found) else []
            yield pa.RecordBatch.from_arrays([
                pa.array(found, pa.int32()), pa.array(np.full(len(found), s), pa.int64()),
                pa.array([x.tobytes() for x in parts], pa.binary())], ["deal", "slice", "data"])

    def judge(table: pa.Table) -> pa.Table:
        blobs = table.column("data").to_pylist()
        records = np.frombuffer(b"".join(blobs), _RUN)
        owner = np.repeat(table.column("slice").to_numpy(), [len(b) // _RUN.itemsize for b in blobs])
        if table.column("deal")[0].as_py() < 0:
            return pa.Table.from_batches([_by_slice(HOT, owner, records)])
        return pa.Table.from_batches([_by_slice(*found) for found in _judge(owner, records)])

    packed = cut_lineage(slices.mapInArrow(
        keep, "deal int, slice long, data binary").groupBy("deal").applyInArrow(judge, _PACKED))
    hot = packed.filter(F.col("kind") == HOT)
    return packed.union(_judged_rows(hot)) if not hot.isEmpty() else packed


def _judged_rows(hot: DataFrame) -> DataFrame:
    """``_judge`` for anchors of very many slices, as rows: aggregated before the shuffle, joins split where skewed."""
    def unpack(batches):
        for batch in batches:
            for s, data in zip(batch.column("slice").to_pylist(), batch.column("data").to_pylist()):
                r = np.frombuffer(data, _RUN)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(r), s), pa.int64()),
                    *[pa.array(np.ascontiguousarray(r[c])) for c in ("ord", "start", "count", "_id")],
                    *[pa.array(np.ascontiguousarray(r[c]).view(np.int64)) for c in ("anchor", "block")]],
                    ["slice", "ord", "start", "count", "_id", "anchor", "block"])

    runs = hot.mapInArrow(unpack, "slice long, ord int, start int, count int, _id long, anchor long, block long")
    kinds = cut_lineage(runs.groupBy("anchor", "block").agg(F.min("_id").alias("least")))
    mixed = (kinds.groupBy("anchor").agg(F.count("*").alias("n"), F.min("least").alias("lo"), F.max("least").alias("hi"))
             .filter("n > 1 and lo < hi").select("anchor", (F.col("n") > CROWD).alias("crowded")))
    judged = cut_lineage(runs.join(kinds.join(mixed, "anchor", "left"), ["anchor", "block"])
                         .withColumn("late", F.col("_id") > F.col("least")).filter("late or crowded is not null"))
    return (_pack(judged.filter("late"), MARKS)
            .union(_pack(judged.filter("not late and not crowded"), WANTED))
            .union(_pack(judged.filter("not late and crowded"), CROWDED)))


def _texts(slices: DataFrame, folder: str, size: int, windows: bool) -> DataFrame:
    """(slice, ord, start, count, _id, anchor, text) of the wanted blocks, or of each of their windows."""
    def run(batches):
        fs, root = store(folder)
        for s, _, texts in _each(batches):
            w = np.frombuffer(_read(fs, f"{root}/{s}"), _WANTED)
            if windows:
                counts = w["count"]
                w = np.repeat(w, counts)
                w["start"] += (np.arange(len(w)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
                w["count"] = 1
            for at in range(0, len(w), 20_000):
                some = w[at:at + 20_000]
                cut = [texts[o][a:a + c + size - 1] for o, a, c in zip(
                    some["ord"].tolist(), some["start"].tolist(), some["count"].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), s), pa.int64()),
                     *[pa.array(np.ascontiguousarray(some[c])) for c in ("ord", "start", "count", "_id")],
                     pa.array(np.ascontiguousarray(some["anchor"]).view(np.int64)), pa.array(cut, pa.binary())],
                    ["slice", "ord", "start", "count", "_id", "anchor", "text"])

    return slices.mapInArrow(
        run, "slice long, ord int, start int, count int, _id long, anchor long, text binary")


def _sorted_marks(blocks: DataFrame, size: int) -> DataFrame:
    """Marks from the suffix arrays of blocks, whole anchors at a time."""
    def flush(rows) -> pa.RecordBatch:
        slices, ords, starts, counts, texts, ids = (list(c) for c in zip(*rows))
        number, offset = later_windows(texts, np.array(counts), np.array(ids), size)
        order = np.lexsort((offset, number))
        number, offset = number[order], offset[order]
        first = np.ones(len(number), bool)
        first[1:] = (number[1:] != number[:-1]) | (offset[1:] != offset[:-1] + 1)
        at = np.flatnonzero(first)
        records = np.zeros(len(at), _MARK)
        records["ord"], records["start"] = np.array(ords)[number[at]], np.array(starts)[number[at]] + offset[at]
        records["count"] = np.diff(np.append(at, len(number)))
        return _by_slice(MARKS, np.array(slices)[number[at]], records)

    def run(batches):
        rows, bytes_, last = [], 0, None
        for batch in batches:
            anchors = batch.column("anchor").to_pylist()
            columns = [batch.column(c).to_pylist() for c in ("slice", "ord", "start", "count", "text", "_id")]
            for anchor, row in zip(anchors, zip(*columns)):
                if bytes_ >= SORT_BYTES and anchor != last:  # an anchor's blocks stay together
                    yield flush(rows)
                    rows, bytes_ = [], 0
                last = anchor
                rows.append(row)
                bytes_ += len(row[4]) + 1
        if rows:
            yield flush(rows)

    return blocks.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _PACKED)


def _later_rows(rows: DataFrame) -> DataFrame:
    """Rows whose text a row of a smaller _id has too.

    Always a merge join: rows come from a table of names, so Spark takes them for far smaller than they are.
    """
    values = rows.groupBy("text").agg(F.min("_id").alias("least"))
    return rows.join(values.hint("merge"), "text").filter("_id > least")


def _marks(slices: DataFrame, size: int, gram: int, total: int) -> DataFrame:
    """(kind, slice, data): packed runs of windows that also start in a document of a smaller id."""
    spark = slices.sparkSession
    judged = _judged(slices, size, gram, total)
    of = lambda kind: judged.filter(F.col("kind") == kind)
    wanted = scratch_path(spark, "wanted")
    _per_slice(of(WANTED), wanted, [])
    marks = of(MARKS).union(_sorted_marks(_texts(slices, wanted, size, False), size))
    if of(CROWDED).isEmpty():
        return marks
    folder = scratch_path(spark, "crowded")
    _per_slice(of(CROWDED), folder, [])
    return marks.union(_pack(_later_rows(_texts(slices, folder, size, True)), MARKS))


def remove_later_copies(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs``.

    Each byte in a string of ``size`` bytes that also starts in a document with a smaller doc_id is removed; strings are
    judged on the input, as UTF-8 bytes, and never cross documents. ``kept`` is the rest as bytes. Null texts are
    empty. Rows that share a doc_id are documents of one id and do not remove each other's strings; a null
    doc_id counts as smaller than any other and stays null. An empty table gives an empty result; other
    columns are ignored.
    """
    slices, total = _slices(docs)
    folder = scratch_path(docs.sparkSession, "marks")
    _per_slice(_marks(slices, size, gram, total), folder, [])

    def run(batches):
        fs, root = store(folder)
        for s, ids, texts in _each(batches):
            marks = np.frombuffer(_read(fs, f"{root}/{s}"), _MARK)
            marks = marks[np.argsort(marks["ord"], kind="stable")]
            cuts = np.searchsorted(marks["ord"], np.arange(len(texts) + 1))
            out = []
            for n, text in enumerate(texts):
                own, removed, spans, kept = marks[cuts[n]:cuts[n + 1]], 0, 0, text
                if len(own):
                    gone = covered(len(text), own["start"], own["count"], size)
                    removed, spans = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            sizes, removed, spans, digests, kept = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.int64()), pa.array(digests), pa.array(kept, pa.binary())],
                ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = slices.mapInArrow(
        run, "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.select(public_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
