"""Repeated word windows, found by counting anchored blocks and then single windows.

The method dealt for this operator is relative Lempel-Ziv parsing. No document is parsed into factors here: every
document is cut in runs at content-chosen anchors (``windows``), and the texts of the runs are blocks indexed by anchor. Where a whole
block stands elsewhere too, all its windows are repeated at once; where blocks of an anchor differ, the windows
themselves are counted one by one. Blocks and windows are equal where their 64-bit hashes are; texts are not compared again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pagewright.llm.common import keyed, public_id, text_slices
from pagewright.llm.windows import covered, runs_of, window_hashes
from pagewright.session import cut_lineage

WINDOW, GRAM = 35, 8
#: Word hashes a task remembers; at the limit the memory starts anew.
CACHE_WORDS = 200_000


class WordHashes:
    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.known, xxhash.xxh64_intdigest
        if len(known) > CACHE_WORDS:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w)
            out.append(h)
        return np.array(out, np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _all_runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(_id, _th, start, count, anchor, block) for every run of every document of ``keyed`` rows."""
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            ids, ths = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_th"))
            for first, texts in text_slices(batch, "_text"):
                r = runs_of([hashes(t.split()) for t in texts], window, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first + r.doc], pa.int64()), pa.array(ths[first + r.doc], pa.int64()),
                     pa.array(r.start, pa.int32()), pa.array(r.count, pa.int32()),
                     _signed(r.anchor), _signed(r.block)], ["_id", "_th", "start", "count", "anchor", "block"])

    return docs.mapInArrow(run, "_id long, _th long, start int, count int, anchor long, block long")


def _boundary_windows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(_id, _th, at, copies, anchor, hash) for every window of the wanted runs."""
    lists = wanted.groupBy("_id", "_th").agg(F.collect_list(F.struct("start", "count", "anchor", "copies")).alias("_r"))
    rows = docs.join(lists, ["_id", "_th"]).select(
        "_id", "_th", "_text", *[F.col(f"_r.{c}").alias(c) for c in ("start", "count", "anchor", "copies")])

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column("_text").cast(pa.binary())
            for n, text in enumerate(texts):
                start, count, anchor, copies = (
                    np.asarray(batch.column(c)[n].values) for c in ("start", "count", "anchor", "copies"))
                at, h = window_hashes(hashes(text.as_py().split()), start.astype(np.int64),
                                      count.astype(np.int64), window)
                size = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("_id")[n].as_py()] * size, pa.int64()),
                     pa.array([batch.column("_th")[n].as_py()] * size, pa.int64()),
                     pa.array(at, pa.int32()), pa.array(np.repeat(copies, count), pa.int64()),
                     pa.array(np.repeat(anchor, count), pa.int64()), _signed(h)],
                    ["_id", "_th", "at", "copies", "anchor", "hash"])

    return rows.mapInArrow(run, "_id long, _th long, at int, copies long, anchor long, hash long")


def duplicate_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(_id, _th, start, count): runs of windows of ``keyed`` docs whose word sequence also starts elsewhere.

    Hot anchors are never gathered: blocks and windows are counted by (anchor, hash) with map-side combining, and the
    joins by anchor, if skewed, are split at run time.
    """
    runs = cut_lineage(_all_runs(docs, window, gram))
    # counts are written before they are joined, so that both sides of a join are plain shuffles it can split
    shared = cut_lineage(runs.groupBy("anchor").count().filter("count > 1").select("anchor"))
    runs = cut_lineage(runs.join(shared, "anchor"))
    row = F.struct("_id", "_th", "start", "count")
    blocks = cut_lineage(runs.groupBy("anchor", "block").agg(F.count("*").alias("copies"), F.min(row).alias("one")))
    whole = runs.join(blocks.filter("copies > 1").select("anchor", "block"), ["anchor", "block"]).select(
        "_id", "_th", "start", "count")
    # anchors with a block found once and another block: its windows may still stand in the other
    open_ = cut_lineage(
        blocks.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("copies").alias("least"))
        .filter("kinds > 1 and least = 1").select("anchor"))
    wanted = blocks.join(open_, "anchor").select("anchor", "copies", "one.*")
    found = cut_lineage(_boundary_windows(docs, wanted, window))
    again = cut_lineage(
        found.groupBy("anchor", "hash").agg(F.sum("copies").alias("all"), F.min("copies").alias("least"))
        .filter("all > 1 and least = 1").select("anchor", "hash"))
    parts = found.filter("copies = 1").join(again, ["anchor", "hash"]).select(
        "_id", "_th", F.col("at").alias("start"), F.lit(1).alias("count"))
    return whole.union(parts)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for every row of ``docs``.

    Words are runs of anything but space and tab to carriage return. Each word in a window of ``window`` words whose
    sequence also starts anywhere else, same document included, is removed; windows are judged on the input.
    Kept words are joined by one space. Null, empty and blank texts have no words. Repeated rows are rows like any
    other and so remove each other's windows; a null doc_id stays null. An empty table gives an
    empty result; other columns are ignored.
    """
    rows = keyed(docs)
    marks = duplicate_spans(rows.select("_id", "_th", "_text"), window, gram)
    lists = marks.distinct().groupBy("_id", "_th").agg(F.collect_list(F.struct("start", "count")).alias("_m"))
    marked = rows.join(lists, ["_id", "_th"], "left").select(
        "_id", "_text", F.col("_m.start").alias("start"), F.col("_m.count").alias("count"))

    def run(batches):
        for batch in batches:
            for first, texts in text_slices(batch, "_text"):
                out = []
                for n, text in enumerate(texts, first):
                    words = text.split()
                    starts, size = batch.column("start")[n], len(words)
                    if starts.is_valid and size:
                        gone = covered(size, starts.values, batch.column("count")[n].values, window)
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                    kept = b" ".join(words)
                    out.append((size, size - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
                sizes, removed, digests, kept = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(first, len(texts)), pa.array(sizes, pa.int64()),
                     pa.array(removed, pa.int64()), pa.array(digests), pa.array(kept, pa.string())],
                    ["_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    done = marked.mapInArrow(
        run, "_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return done.select(public_id().alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept_text")
