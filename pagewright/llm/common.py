"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewright.session import cut_lineage

#: Stands for a null id in row keys, so that rows with a null id are kept and joined like any other.
NULL_ID = -(2 ** 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """What ``keyed`` calls _id and _th, as columns of a table that may have columns of these names."""
    return (F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)),
            F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *extra: Column) -> DataFrame:
    """Only (_id, _th, _text) and ``extra``: the id with a stand-in for null, a hash of the text, the text (null: empty).

    ``(_id, _th)`` names a row: rows that share both are equal in all an operator reads. Other
    columns are left out, so their names can't clash.
    """
    row_id, text_hash = row_key(id_col, text_col)
    return docs.select(row_id.alias("_id"), text_hash.alias("_th"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), *extra)


def unused(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column is called so."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def public_id(name: str = "_id") -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20,
                as_bytes: bool = True) -> Iterator[tuple[int, list]]:
    """(first row, texts as UTF-8 bytes or strings) for runs of rows with about ``limit`` bytes, or one longer row.

    Keeps the memory of vectorised work per slice bounded whatever the texts' lengths.
    """
    texts = batch.column(column)
    if as_bytes:
        texts = texts.cast(pa.binary())
    first, size = 0, 0
    for row, length in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + length > limit:
            yield first, texts.slice(first, row - first).to_pylist()
            first, size = row, 0
        size += length
    if first < len(texts):
        yield first, texts.slice(first).to_pylist()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge table (a, b): root is the least node that can be reached.

    Large-star and small-star rounds: a node's neighbours are linked to its least neighbour, so
    trees flatten to stars in rounds that grow with the logarithm of the size. Each round is
    aggregates and joins only (no neighbour list is ever gathered) and is written to the shared
    checkpoint folder. Nodes without an edge are not returned.
    """
    state = cut_lineage(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(state)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").filter("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(parent, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = cut_lineage(parent.select("a", F.col("m").alias("b")).union(small).distinct())
        after = mark(state)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components: no fixed point; raise max_rounds")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        state.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
