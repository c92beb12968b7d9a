"""Mixing sources to target weights by Pfair scheduling.

A source's texts, in an order hashed from its rows, are a stream cut in blocks of ``block_bytes``.
With weight w, block j (from 0) is released at slot floor(j / w) and due before slot ceil((j + 1) / w);
earliest deadline first puts one released block in every slot, which keeps each source within less
than one block of w * slots at every slot until it runs out. Weights are whole numbers over a common sum (bytes, where the
shares are kept as found), so windows are exact and no error is carried along.

A schedule is one sequence: one task makes it, a step per block of 256 KB, holding an entry per source. Rows then get
their slots by a join on source and block.
"""

from __future__ import annotations

import heapq
from collections.abc import Collection, Iterable, Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagewright.llm.common import NULL_ID
from pagewright.operators.ordering import running_sum
from pagewright.session import cut_lineage

#: Bytes of text in a source block, and bands of the order inside a source.
BLOCK_BYTES, BANDS = 256 << 10, 4_096
#: Slots in one batch of the schedule.
BATCH_SLOTS = 10_000


def target_weights(sizes: Mapping[str, int], max_share: float = 1.0) -> dict[str, float]:
    """Shares in proportion to ``sizes``, as found; those above a smaller ``max_share`` are held at it.

    With fewer than 1 / max_share sources of any size the shares stay as found.
    """
    sizes = {s: n for s, n in sizes.items() if n > 0}
    held: set[str] = set()
    while sizes:
        rest = sum(n for s, n in sizes.items() if s not in held)
        free = 1 - max_share * len(held)
        if free < 0 or not rest:
            total = sum(sizes.values())
            return {s: n / total for s, n in sizes.items()}
        share = {s: max_share if s in held else free * n / rest for s, n in sizes.items()}
        over = {s for s, x in share.items() if x > max_share + 1e-12} - held
        if not over:
            return share
        held |= over
    return {}


def whole_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """The positive weights in whole numbers of the same proportions."""
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0}
    scale = 1
    for w in exact.values():
        scale = scale * w.denominator // Fraction(scale, w.denominator).numerator if scale % w.denominator else scale
    return {s: int(w * scale) for s, w in exact.items()}


def pfair(sources: Iterable[tuple[str, int, int]], total: int = 0, silent: Collection[str] = ()) -> Iterator[tuple[str, int, int, int, int, bool]]:
    """(source, block, release, deadline, slot, in_mix) of every block, slot by slot: earliest deadline first.

    ``sources``: (source, whole weight, blocks); ``total``: sum of all weights, more than theirs if some have no blocks. A source whose
    next block is missing has run out: it drops out when that block would have its turn, and ``in_mix`` is false from that slot on, but for ``silent`` sources.
    A slot in which no block is released stays empty.
    """
    sources = sorted(sources)
    total = total or sum(w for _, w, _ in sources)
    waiting = [(0, s, 0, w, n) for s, w, n in sources]  # (release, source, block, weight, blocks)
    ready: list[tuple[int, str, int, int, int, int]] = []
    heapq.heapify(waiting)
    now, mixed = 0, True
    while waiting or ready:
        if not ready:
            now = max(now, waiting[0][0])
        while waiting and waiting[0][0] <= now:
            release, s, j, w, n = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // w), s, j, w, n, release))
        deadline, s, j, w, n, release = heapq.heappop(ready)
        if j >= n:
            mixed = mixed and s in silent
            continue
        yield s, j, release, deadline, now, mixed
        heapq.heappush(waiting, ((j + 1) * total // w, s, j + 1, w, n))
        now += 1


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES,
        max_share: float = 1.0) -> DataFrame:
    """Every row of ``docs`` with its place in the mix: doc_id, source, block, release, deadline, slot, in_mix.

    A document belongs to the block its first byte falls in; one longer than a block fills several.
    A source that has run out drops out and the others go on by their weights to their ends, so every row has a slot and is in
    the mix, however small a source is.
    ``weights`` None: the bytes found, so the target is the shares as found; a ``max_share``
    below 1 slows larger sources down (see ``target_weights``), and what they have beyond it comes last. Only given ``weights``
    leave rows out: a
    source without weight has null slots, and ``in_mix`` is false from the first slot for which a source
    that has bytes has no block left, so that up to there each has the weight asked for to within one block.
    Null is a source of its own. Null and empty
    texts take no bytes; a source of such texts only is mixed like one of a single byte. Rows with equal (doc_id, text) stand side by side in any order; a null doc_id
    stays null; other columns are ignored. An empty table gives an empty result. There may be any number of sources.
    """
    return _placed(docs, weights, block_bytes, max_share).drop("_s", "_h", "_until")


def _row_hash() -> Column:
    """Of a row's doc_id and text (null: empty); with the source it names a row."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)),
                      F.coalesce(F.col("text").cast("string"), F.lit("")))


def _source_key() -> Column:
    source = F.col("source").cast("string")
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))


def _schedule(sources: DataFrame, weights: Mapping[str, float] | None, max_share: float) -> DataFrame:
    """(_s, block, release, deadline, slot, in_mix) of every block of ``sources`` (_s, bytes, blocks)."""
    names = ["_s", "block", "release", "deadline", "slot", "in_mix"]
    kinds = [pa.string(), *[pa.int64()] * 4, pa.bool_()]

    def run(batches):
        sizes = {s: (n, blocks) for batch in batches for s, n, blocks in
                 zip(*(batch.column(c).to_pylist() for c in ("_s", "bytes", "blocks")))}
        if weights is not None:
            whole = whole_weights(weights)
        elif max_share < 1:
            shares = target_weights({s: n for s, (n, _) in sizes.items()}, max_share)
            least = min(shares.values(), default=1.0)
            whole = {s: max(1, round(shares.get(s, least * 2 ** -12) * 2 ** 50)) for s in sizes}
        else:
            whole = {s: max(1, n) for s, (n, _) in sizes.items()}
        found = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)
        silent = {s for s, (n, _) in sizes.items() if not n}
        some = [(s, w, sizes[s][1]) for s, w in whole.items() if s in sizes]
        for s, j, release, deadline, slot, mixed in pfair(some, sum(whole.values()), silent):
            found.append((s, j, release, deadline, slot, mixed or weights is None))
            if len(found) == BATCH_SLOTS:
                yield pack()
                found = []
        if found:
            yield pack()

    schema = "_s string, block long, release long, deadline long, slot long, in_mix boolean"
    return cut_lineage(sources.select("_s", "bytes", "blocks").repartition(1).mapInArrow(run, schema))


def _placed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES,
            max_share: float = 1.0) -> DataFrame:
    """``mix`` with _s, _h and _until: the row's source key, hash, and bytes of its source up to its end."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        _source_key().alias("_s"),
        F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("_bytes"),
        _row_hash().alias("_h"))
    rows = rows.withColumn("_band", F.pmod(F.shiftright("_h", 40), F.lit(BANDS)))
    rows = cut_lineage(rows)  # narrow: the running sum reads it twice
    summed = running_sum(rows, ["_s"], ["_band"], ["_h", "doc_id"], "_bytes", "_until")
    summed = cut_lineage(summed.withColumn("block", F.expr(f"(_until - _bytes) div {block_bytes}")))
    sources = summed.groupBy("_s").agg(F.max("_until").alias("bytes"), F.greatest(
        F.max("block") + 1, F.ceil(F.max("_until") / block_bytes)).alias("blocks"))
    name = lambda s: "" if s is None else f"={s}"
    asked = None if weights is None else {name(s): w for s, w in weights.items()}
    placed = summed.join(_schedule(sources, asked, max_share), ["_s", "block"], "left")
    return placed.select("doc_id", "source", "block", "release", "deadline", "slot",
                         F.coalesce("in_mix", F.lit(False)).alias("in_mix"), "_s", "_h", "_until")


def in_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in slot order without the rows outside the mix (see ``mix``), all columns as they are.

    Inside a slot rows keep their source's order. Rows equal in doc_id, source and text go together, where the
    first of them stands.
    """
    first = (_placed(docs, **options).filter("in_mix").groupBy("_s", "_h")
             .agg(F.min("slot").alias("_slot"), F.min("_until").alias("_until")))
    first = first.select(F.col("_s").alias("_mix_s"), F.col("_h").alias("_mix_h"),
                         F.col("_slot").alias("_mix_slot"), F.col("_until").alias("_mix_until"))
    placed = docs.join(first, (_source_key() == F.col("_mix_s")) & (_row_hash() == F.col("_mix_h")))
    order = ["_mix_slot", "_mix_until"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def with_stored_place(docs: DataFrame, name: str) -> DataFrame:
    """Add ``name``: each row's place from 0 in the order ``docs`` is stored in, as ``in_mix`` leaves it once written.

    Of a table read from Parquet that is the order of its part files by name and of their rows; of any other the order of its
    partitions. Rows are counted per part, so no row is moved; the counts, a row per part, are sent to all tasks.
    """
    try:
        file = F.col("_metadata.file_path")  # a number with more digits makes a longer name
        placed = docs.select("*", F.struct(F.length(file), file).alias("_part"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        n = F.monotonically_increasing_id()
        placed = docs.withColumn("_n", n).select(
            *docs.columns, F.shiftright("_n", 33).alias("_part"), F.col("_n").bitwiseAND((1 << 33) - 1).alias("_row"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row per part
    firsts = placed.groupBy("_part").agg((F.max("_row") + 1).alias("_m")).select(
        "_part", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_first"))
    return placed.join(F.broadcast(firsts), "_part").select(*docs.columns, (F.col("_first") + F.col("_row")).alias(name))
