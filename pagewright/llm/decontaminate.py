"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND.

Every passage of every document is a query. Weights are scaled so that an item's own words
sum to 1; a passage must reach ``threshold`` of that. Items stand in blocks; every posting list has its maximum per
block. Terms whose block maxima together stay below the threshold can't lift an item by
themselves, so only the other, essential terms open a block: a block whose bound (essential block maxima
found in the passage plus all the others') is below the threshold is skipped; open blocks' items are bounded by
their own weights in the same way, and what is left is scored in full.
Items found are then checked for overlap of their question and of their answer with the passage.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewright.llm.common import keyed, public_id, row_key, text_slices
from pagewright.llm.storage import put, store
from pagewright.session import cut_lineage, scratch_path

K1, B, THRESHOLD, OVERLAP, NGRAM, MIN_WORDS = 1.2, 0.75, 0.5, 0.5, 3, 5
#: Items per index block, and about the most items in one index shard (what a task holds and is sent).
BLOCK_ITEMS, SHARD_ITEMS = 8, 1_000
#: Bytes of text a task takes through all shards at a time, and words searched at once.
LOAD_BYTES, SEARCH_WORDS = 4 << 20, 150_000
#: ASCII characters that are no letter or digit part words.
_PARTS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str) -> list[bytes]:
    """Lower-cased words as UTF-8, split at ASCII characters other than letters and digits."""
    return text.lower().encode().translate(_PARTS).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer: after the last ``?``, else the last sentence, else the last third."""
    head, mark, tail = text.rpartition("?")
    if mark and words_of(tail) and words_of(head):
        return words_of(head), words_of(tail)
    parts = [p for p in (words_of(s) for s in _SENTENCE.split(text)) if p]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def overlap(part: list[bytes], passage: list[bytes]) -> float:
    """Share of the part's word n-grams (n up to 3) that stand in the passage; 1 for an empty part."""
    if not part:
        return 1.0
    n = min(NGRAM, len(part))
    grams = {tuple(part[i:i + n]) for i in range(len(part) - n + 1)}
    return len(grams & {tuple(passage[i:i + n]) for i in range(len(passage) - n + 1)}) / len(grams)


@dataclass
class Shard:
    """The index of one shard of items."""
    terms: dict[bytes, int]
    item_ids: np.ndarray
    texts: list[str]
    weights: list[dict[int, float]]
    essential: dict[bytes, int]  # terms that open blocks, with their numbers
    first: np.ndarray            # per term: its slice of the block postings
    blocks: np.ndarray           # block of a posting
    block_max: np.ndarray        # the most a term gives an item of that block
    rest: np.ndarray             # per block: sum of the maxima of terms that aren't essential
    item_first: np.ndarray       # per term: its slice of the item postings
    items: np.ndarray            # item of a posting
    item_weight: np.ndarray      # what the term gives the item
    item_rest: np.ndarray        # per item: sum of its weights of terms that aren't essential

    @staticmethod
    def build(postings, items: dict[int, str], threshold: float) -> Shard:
        """postings: (item_id, term, weight) of all items of the shard."""
        ids = np.array(sorted(items), np.int64)
        number = {int(i): n for n, i in enumerate(ids)}
        terms: dict[bytes, int] = {}
        weights: list[dict[int, float]] = [{} for _ in ids]
        for item, term, weight in sorted(postings):
            weights[number[item]][terms.setdefault(term, len(terms))] = weight
        n_blocks = -(-len(ids) // BLOCK_ITEMS)
        best: list[dict[int, float]] = [{} for _ in terms]
        for n, own in enumerate(weights):
            for t, w in own.items():
                best[t][n // BLOCK_ITEMS] = max(w, best[t].get(n // BLOCK_ITEMS, 0.0))
        # the longest lists are left out first, while every block's sum stays under half the threshold
        essential, rest = np.ones(len(terms), bool), np.zeros(n_blocks)
        for t in sorted(range(len(terms)), key=lambda t: (-len(best[t]), t)):
            more = rest.copy()
            for b, w in best[t].items():
                more[b] += w
            if more.max(initial=0) < threshold / 2:
                essential[t], rest = False, more
        lists: list[list[tuple[int, float]]] = [[] for _ in terms]
        item_rest = np.zeros(len(ids))
        for n, own in enumerate(weights):
            for t, w in own.items():
                lists[t].append((n, w))
                item_rest[n] += 0.0 if essential[t] else w
        flat = lambda rows: (np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64),
                             np.array([i for r in rows for i, _ in sorted(r)], np.int64),
                             np.array([w for r in rows for _, w in sorted(r)]))
        first, blocks, block_max = flat([own.items() for own in best])
        item_first, item, item_weight = flat(lists)
        return Shard(terms, ids, [items[int(i)] for i in ids], weights,
                     {t: n for t, n in terms.items() if essential[n]}, first, blocks, block_max, rest,
                     item_first, item, item_weight, item_rest)

    @staticmethod
    def _sums(rows, term, width, first, target, weight) -> np.ndarray:
        """(rows, width) sums of the postings of (row, term) pairs."""
        size = first[term + 1] - first[term]
        posting = np.repeat(first[term] - np.cumsum(size) + size, size) + np.arange(size.sum())
        key = np.repeat(rows, size) * width + target[posting]
        n = int(rows.max(initial=-1)) + 1
        return np.bincount(key, weight[posting], minlength=n * width).reshape(n, width)

    def search(self, documents: list[list[bytes]], stride: int, threshold: float):
        """(document, item number, score, passage words) of all items at or above the threshold in any passage.

        Passage j of a document is its words [j * stride, (j + 2) * stride). Blocks are bounded for all
        passages at once; where a block stays open its items are bounded, and items still open are scored.
        """
        sizes = np.array([len(d) for d in documents], np.int64)
        counts = np.maximum(1, -(-sizes // stride) - 1)
        firsts = np.concatenate([[0], np.cumsum(counts)])
        every = list(chain.from_iterable(documents))
        t = np.fromiter(map(self.essential.get, every, repeat(-1)), np.int64, len(every))
        at = np.flatnonzero(t >= 0)
        if not len(at) or not len(self.rest):
            return
        begin = np.concatenate([[0], np.cumsum(sizes)])
        doc = np.searchsorted(begin, at, "right") - 1
        j, t = (at - begin[doc]) // stride, t[at]
        kinds = len(self.terms)
        pairs = [((firsts[doc] + j - shift) * kinds + t)[(j >= shift) & (j - shift < counts[doc])] for shift in (0, 1)]
        passage, term = np.divmod(np.unique(np.concatenate(pairs)), kinds)
        least = threshold - 1e-9
        bound = self._sums(passage, term, len(self.rest), self.first, self.blocks, self.block_max) + self.rest
        opened = (bound >= least).any(1)
        number = np.cumsum(opened) - 1
        kept = opened[passage]
        if not kept.any():
            return
        scores = self._sums(number[passage[kept]], term[kept], len(self.item_ids), self.item_first, self.items,
                            self.item_weight) + self.item_rest
        blocks = np.repeat(bound[opened] >= least, BLOCK_ITEMS, axis=1)[:, :len(self.item_ids)]
        originals = np.flatnonzero(opened)
        for row, i in zip(*np.nonzero((scores >= least) & blocks)):
            p = originals[row]
            n = int(np.searchsorted(firsts, p, "right")) - 1
            start = int(p - firsts[n]) * stride
            words = documents[n][start:start + 2 * stride]
            own = {self.terms.get(w) for w in words}
            score = sum(w for t, w in self.weights[i].items() if t in own)
            if score >= least:
                yield n, i, score, words


def item_index(items: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(item_id, key, text, shard, words, term, weight): BM25 weights, scaled to sum 1 per item, statistics over all items.

    Every distinct (item_id, text) with a word is an item of its own, named by ``key``; null ids and texts name nothing.
    """
    texts = (items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
             .select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
             .withColumn("key", F.xxhash64("item_id", "text")))

    def split(batches):
        for batch in batches:
            out = {"item_id": [], "key": [], "text": [], "words": [], "term": [], "tf": []}
            for item, key, text in zip(*(batch.column(c).to_pylist() for c in ("item_id", "key", "text"))):
                words = words_of(text)
                for term, count in Counter(words).items():
                    for name, value in zip(out, (item, key, text, len(words), term, count)):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, pa.schema([
                ("item_id", pa.int64()), ("key", pa.int64()), ("text", pa.string()), ("words", pa.int64()),
                ("term", pa.binary()), ("tf", pa.int64())]))

    terms = texts.mapInArrow(split, "item_id long, key long, text string, words long, term binary, tf long")
    terms = cut_lineage(terms)
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    totals = terms.select("key", "words").distinct().agg(F.count("*").alias("n"), F.avg("words").alias("mean")).first()
    n, mean = totals["n"], totals["mean"] or 1.0
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    raw = terms.join(df, "term").withColumn(
        "raw", idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("words") / mean)))
    own = raw.groupBy("key").agg(F.sum("raw").alias("own"))
    shards = max(1, -(-n // SHARD_ITEMS))
    return raw.join(own, "key").select(
        "item_id", "key", "text", F.pmod("key", F.lit(shards)).cast("int").alias("shard"), "words", "term",
        (F.col("raw") / F.col("own")).alias("weight"))


def _write_shards(index: DataFrame, threshold: float) -> tuple[str, list[str], int]:
    """Every shard's index as a file of the shared folder, built by the task that gets its rows; and the most words of an item."""
    folder = scratch_path(index.sparkSession, "items")

    def build(table: pa.Table) -> pa.Table:
        keys, terms, weights = (table[c].to_pylist() for c in ("key", "term", "weight"))
        texts = dict(zip(keys, table["text"].to_pylist()))
        shard = Shard.build(list(zip(keys, terms, weights)), texts, threshold)
        ids = dict(zip(keys, table["item_id"].to_pylist()))
        parts = [(words_of(t), *question_and_answer(t)) for t in shard.texts]
        data = pickle.dumps(({f: getattr(shard, f) for f in Shard.__dataclass_fields__}, [ids[int(k)] for k in shard.item_ids], parts))
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        name = f"shard-{table['shard'][0].as_py()}"
        put(fs, f"{root}/{name}", [data])
        return pa.table({"name": [name], "words": pa.array([max(table["words"].to_pylist())], pa.int64())})

    built = index.groupBy("shard").applyInArrow(build, "name string, words long").collect()  # a file name per shard
    return folder, sorted(r["name"] for r in built), max((r["words"] for r in built), default=0)


def _load_shard(folder: str, name: str):
    fs, root = store(folder)
    with fs.open_input_file(f"{root}/{name}") as f:
        fields, ids, parts = pickle.loads(f.read())
    return Shard(**fields), ids, parts


def _holds(words: list[bytes], passage: list[bytes]) -> bool:
    n = len(words)
    return any(passage[i:i + n] == words for i in range(len(passage) - n + 1))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, min_overlap: float = OVERLAP,
                 min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): items whose question and answer a document holds.

    Every passage of every document (windows of twice the longest item, half overlapping, so each item lies whole
    in one) is searched against every item; reported is each pair's passage with the best score. ``score`` is the share of the
    item's own BM25 score. Every text under an item_id counts; an item of fewer than ``min_words`` words must stand
    in the passage word for word. Null, empty and blank texts match nothing; nor does an empty table of items or documents.
    Rows that share a doc_id count as one document with several texts; a null doc_id stays null.
    Other columns of either table are ignored. The index is built by tasks as files of about ``SHARD_ITEMS`` items, and
    the documents are read once: a task takes some megabytes of them through one file after another.
    """
    best = _found(docs, items, threshold, min_overlap, min_words).groupBy("_id", "item_id").agg(
        F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("m"))
    return best.select(public_id().alias("doc_id"), "item_id", "m.*")


def _found(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, min_overlap: float = OVERLAP,
           min_words: int = MIN_WORDS) -> DataFrame:
    """The rows ``contaminated`` takes the best of: one per passage with a hit, with the _id and _th of its row."""
    folder, names, longest = _write_shards(item_index(items), threshold)
    stride = max(64, longest)
    schema = "_id long, _th long, item_id long, score double, question_overlap double, answer_overlap double"

    def run(batches):
        held = {}  # the shard loaded last

        def search(ids, hashes, texts):
            documents, out = [words_of(t) for t in texts], []
            for name in names:
                if name not in held:
                    held.clear()
                    held[name] = _load_shard(folder, name)
                shard, item_ids, parts = held[name]
                for first, some in _runs(documents, SEARCH_WORDS):
                    for n, i, score, words in shard.search(some, stride, threshold):
                        whole, question, answer = parts[i]
                        if len(whole) < min_words and not _holds(whole, words):
                            continue
                        q, a = overlap(question, words), overlap(answer, words)
                        if q >= min_overlap and a >= min_overlap:
                            out.append((ids[first + n], hashes[first + n], item_ids[i], float(score), q, a))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (*[pa.int64()] * 3, *[pa.float64()] * 3))],
                ["_id", "_th", "item_id", "score", "question_overlap", "answer_overlap"]) if out else None

        for batch in batches:
            ids, hashes = batch.column("_id").to_pylist(), batch.column("_th").to_pylist()
            for first, some in text_slices(batch, "_text", LOAD_BYTES, as_bytes=False):
                found = search(ids[first:first + len(some)], hashes[first:first + len(some)], some)
                if found is not None:
                    yield found

    return keyed(docs).mapInArrow(run, schema)


def _runs(documents: list[list[bytes]], limit: int):
    """(first, documents) for runs of about ``limit`` words."""
    first, size = 0, 0
    for i, d in enumerate(documents):
        if size and size + len(d) > limit:
            yield first, documents[first:i]
            first, size = i, 0
        size += len(d)
    if documents[first:]:
        yield first, documents[first:]


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, all columns as they are.

    Every row is judged by its own text, also where a doc_id is null or repeated.
    """
    hit = _found(docs, items, threshold).select(F.col("_id").alias("_hit"), F.col("_th").alias("_hit_th")).distinct()
    row_id, text_hash = row_key()
    return docs.join(hit, (row_id == F.col("_hit")) & (text_hash == F.col("_hit_th")), "left_anti")
