"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut in ``segments`` segments. Two fingerprints that differ in at most ``max_bits``
bits differ in at most ``max_bits // segments`` bits of some segment, so every fingerprint asks the table of
(segment, value) for all values in that small Hamming ball and complete distances are checked.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pagewright.llm.common import NULL_ID, components, public_id, row_key, text_slices, unused
from pagewright.session import cut_lineage

SEED, WORDS, MAX_BITS, SEGMENTS = 42, 4, 4, 3
#: A table entry with more fingerprints than this is first thinned by close links (see ``_close_groups``).
CROWD = 32


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Signed 64-bit SimHash of a UTF-8 text: A-Z lower-cased, shingles of ``words`` words, XXH64 seed 42."""
    found = text.lower().split()  # on bytes: A-Z only, and space, tab to carriage return
    if not found:
        return 0
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(b" ".join(found[i:i + words]), SEED)
                       for i in range(max(1, len(found) - words + 1))])
    bits = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(bits), 1 << 16):
        ones += np.unpackbits(bits[at:at + (1 << 16)], axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(bits)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = WORDS, row: Column | None = None) -> DataFrame:
    """(_id, _th, _row, fp) for every row of ``docs``; ``row`` is a long carried along as _row (none: null)."""
    def run(batches):
        for batch in batches:
            for first, texts in text_slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, len(texts)) for c in ("_id", "_th", "_row")),
                     pa.array([fingerprint(t, words) for t in texts], pa.int64())], ["_id", "_th", "_row", "fp"])

    row_id, text_hash = row_key()
    row = F.lit(None) if row is None else row
    return docs.select(
        row_id.alias("_id"), text_hash.alias("_th"), row.cast("long").alias("_row"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"),
    ).mapInArrow(run, "_id long, _th long, _row long, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _segments(segments: int, max_bits: int) -> list[tuple[int, int, list[int]]]:
    """(mask, marker, ball) per segment. The marker lies outside the mask and tells segments apart."""
    width, extra = divmod(64, segments)
    out, low = [], 0
    for s in range(segments):
        size = width + (s < extra)
        mask = ((1 << size) - 1) << low
        outside = [b for b in range(64) if not mask >> b & 1][:8]
        marker = sum(1 << b for i, b in enumerate(outside) if (s + 1) >> i & 1)
        ball = [sum(1 << (low + b) for b in some)
                for r in range(max_bits // segments + 1) for some in combinations(range(size), r)]
        out.append((_signed(mask), _signed(marker), [_signed(b) for b in ball]))
        low += size
    return out


def _close_groups(fps: DataFrame) -> DataFrame:
    """Groups of fingerprints linked at one or two bits: (node, root).

    Two fingerprints are that close exactly if the one-bit balls around them meet. A ball point is
    met by at most 65 distinct fingerprints, so gathering them is bounded however dense the table is.
    """
    points = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)])
    met = (fps.select("fp", F.explode(points).alias("p")).groupBy("p").agg(F.collect_set("fp").alias("f"))
           .filter(F.size("f") > 1))
    return components(met.select(F.array_min("f").alias("a"), F.explode("f").alias("b")).distinct())


def linked(fps: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """(fp, root) for the distinct fingerprints of ``fps`` (column fp) that have a link: root names the component.

    Dense neighbourhoods would meet in all pairs of a table entry. Fingerprints in crowded
    entries are therefore first joined into groups by close links, and only the member of the smaller
    group asks, and only where the entry holds a larger one; links inside a group are not looked for
    again. Every link between different groups is still found by that rule, so components are exact.
    """
    parts = _segments(segments, max_bits)
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(marker)) for mask, marker, _ in parts])
    crowded = (fps.select(F.explode(keys).alias("k")).groupBy("k").count().filter(F.col("count") > CROWD).select("k"))
    dense = cut_lineage(fps.select("fp", F.explode(keys).alias("k")).join(crowded, "k").select("fp").distinct())
    groups = _close_groups(dense)
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    nodes = cut_lineage(
        fps.join(groups.join(sizes, "root").select(F.col("node").alias("fp"), "root", "n"), "fp", "left")
        .select("fp", F.coalesce("root", "fp").alias("g"), F.coalesce("n", F.lit(1)).alias("n")))
    entries = nodes.select(F.explode(keys).alias("k"), "fp", "g", "n")
    asks = F.array(*[F.col("fp").bitwiseAND(F.lit(mask)).bitwiseXOR(F.lit(b)).bitwiseOR(F.lit(marker))
                     for mask, marker, ball in parts for b in ball])
    asking = nodes.select(F.explode(asks).alias("k"), F.col("fp").alias("afp"), F.col("g").alias("ag"),
                          F.col("n").alias("an"))
    largest = (entries.groupBy("k").agg(F.count("*").alias("c"), F.max(F.struct("n", "g")).alias("top"))
               .filter(F.col("c") > CROWD).select("k", "top"))
    asking = (asking.join(largest, "k", "left")
              .filter(F.col("top").isNull() | (F.struct(F.col("an").alias("n"), F.col("ag").alias("g")) < F.col("top")))
              .drop("top"))
    smaller = (F.col("an") < F.col("n")) | ((F.col("an") == F.col("n")) & (F.col("ag") < F.col("g")))
    near = F.bit_count(F.col("afp").bitwiseXOR(F.col("fp"))) <= max_bits
    pairs = asking.join(entries, "k").filter(smaller & near).select(F.col("ag").alias("a"), F.col("g").alias("b"))
    between = components(pairs.distinct())
    own = nodes.filter("n > 1 or g <> fp").select("fp", "g").union(
        between.join(nodes.filter("n = 1"), between["node"] == nodes["fp"]).select("fp", "g")).distinct()
    return own.join(between.withColumnRenamed("node", "g"), "g", "left").select(
        "fp", F.coalesce("root", "g").alias("root"))


def _roots(rows: DataFrame, max_bits: int, segments: int) -> DataFrame:
    """(fp, least, root) for the distinct fingerprints of ``rows``: the smallest id with it, and its component."""
    classes = cut_lineage(rows.groupBy("fp").agg(F.min(public_id()).alias("least")))
    groups = linked(classes.select("fp"), max_bits, segments)
    return cut_lineage(classes.join(groups, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS,
                    segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Fingerprints that differ in at most ``max_bits`` bits are linked; ``component_id`` is the smallest
    doc_id that links reach, the row's own included. Null, empty and blank texts have fingerprint zero and are
    linked like any other. Repeated rows are all kept; a null doc_id stays null and is never a component_id
    unless all of its component are null. An empty table gives an empty result; other columns are
    ignored. Equal fingerprints are one entry, so copies cost nothing.
    """
    rows = cut_lineage(fingerprints(docs, words))
    roots = _roots(rows, max_bits, segments)
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = roots.join(least, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select(
        public_id().alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, all columns as they are.

    The kept row is the one with the component's smallest doc_id; of rows with that id the one with the
    least hashes of text and row, and of equal rows one. A row whose doc_id is null is
    kept only where no row of its component has an id. Components are judged one by one, also where ids repeat.
    """
    row = F.xxhash64(*docs.columns)
    rows = cut_lineage(fingerprints(docs, words, row))
    order = F.struct((F.col("_id") == NULL_ID).alias("none"), "_id", "_th", "_row")
    first = rows.groupBy("fp").agg(F.min(order).alias("first"))
    kept = (first.join(_roots(rows, max_bits, segments), "fp").groupBy("root").agg(F.min("first").alias("first"))
            .select("first._id", "first._th", "first._row"))
    key = ["_id", "_th", "_row"]
    kept = cut_lineage(kept.join(rows, key).groupBy(*key).agg(F.count("*").alias("copies")))
    # texts meet the narrow decisions once; the second branch is planned only where rows are equal throughout
    name = {k: unused(k, docs.columns) for k in key}
    row_id, text_hash = row_key()
    named = docs.withColumns({name["_id"]: row_id, name["_th"]: text_hash, name["_row"]: row})
    chosen = kept.select(*[F.col(k).alias(n) for k, n in name.items()], "copies")
    only = lambda c: named.join(chosen.filter(c).drop("copies"), list(name.values()), "left_semi").select(*docs.columns)
    one = only("copies = 1")
    return one if kept.filter("copies > 1").isEmpty() else one.union(only("copies > 1").dropDuplicates())
