"""Exact top-k inner products by block-at-a-time pruning.

Vectors are documents, components are terms. Candidates stay where they are: a task takes groups of bounded
size through the blocks of queries, which are files in the shared folder, and a group is cut in blocks of neighbouring vec_ids. Per query, a block's bound is the sum over
terms of the most its vectors can give (the term's maximum, or minimum for a negative query
weight). Blocks are scored through their forward index (the vectors' rows) in falling order of bound,
until the next bound is below the query's k-th score. The k-th score starts as the one a query reaches among the queries of its
own file, so most groups end at their first bound and give nothing on.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from pagewright.llm.storage import put, store
from pagewright.session import cut_lineage, scratch_path

#: Rows of a candidate group, of a block in it, and of a query block: fixed, so no task grows with the input.
GROUP_ROWS, BLOCK_ROWS, QUERY_ROWS = 16_384, 128, 1_024
_EXACT = float(2 ** 53)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
              scale: int = 1024) -> DataFrame:
    """(vec_id, v): components floor(scale * x), x as double; without null ids, null vectors, null or non-finite x."""
    x = F.col(vector_col).cast("array<double>")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    return (vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
            .filter(~F.exists(x, bad))
            .select(F.col(id_col).cast("long").alias("vec_id"),
                    F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v")))


def _matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def block_topk(queries: np.ndarray, query_ids: np.ndarray, docs: np.ndarray, ids: np.ndarray,
               k: int, block_rows: int = BLOCK_ROWS, floors: list | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """[(query_id, vec_id, score)] of each query's k best of ``docs`` (sorted by id), and blocks scored.

    ``floors``: a score per query that k candidates are known to reach, or None; lower scores are left out.
    """
    if not len(docs) or not len(queries):
        return [], 0
    size = max(1.0, float(np.abs(docs.astype(float)).max())) * max(1.0, float(np.abs(queries.astype(float)).max()))
    number = float if size * docs.shape[1] < _EXACT else object  # beyond: exact Python integers
    docs, queries = docs.astype(number), queries.astype(number)
    starts = np.arange(0, len(docs), block_rows)
    most, least = np.maximum.reduceat(docs, starts), np.minimum.reduceat(docs, starts)
    zero = queries * 0
    bounds = np.maximum(queries, zero) @ most.T + np.minimum(queries, zero) @ least.T
    out, scored = [], 0
    for q, query_id, bound, kth in zip(queries, query_ids, bounds, floors or [None] * len(queries)):
        top_s, top_i = np.zeros(0, number), np.zeros(0, np.int64)
        for b in np.argsort(-bound, kind="stable"):
            if kth is not None and bound[b] < kth:
                break
            scored += 1
            at = slice(starts[b], starts[b] + block_rows)
            score, own = docs[at] @ q, ids[at]
            fit = own != query_id if kth is None else (own != query_id) & (score >= kth)
            if not fit.any():
                continue
            top_s, top_i = np.concatenate([top_s, score[fit]]), np.concatenate([top_i, own[fit]])
            best = np.lexsort((top_i, -top_s))[:k]
            top_s, top_i = top_s[best], top_i[best]
            if len(top_s) == k:
                kth = top_s[-1] if kth is None else max(kth, top_s[-1])
        out += [(int(query_id), int(i), max(-2 ** 63, min(2 ** 63 - 1, int(s)))) for i, s in zip(top_i, top_s)]
    return out, scored


def _write_queries(query_rows: DataFrame, k: int) -> tuple[str, list[str]]:
    """Query blocks as files of the shared folder: ids, vectors and the k-th score among the other queries of the file."""
    blocks = max(1, -(-query_rows.count() // (QUERY_ROWS * 3 // 4)))
    folder = scratch_path(query_rows.sparkSession, "queries")

    def save(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        ids, v = table["vec_id"].to_numpy(), table["v"].to_pylist()
        matrix = _matrix(v, max(map(len, v), default=0))
        best: dict[int, list[int]] = {}
        for query_id, _, score in block_topk(matrix, ids, matrix, ids, k)[0]:
            best.setdefault(query_id, []).append(score)
        floors = [min(s) if len(s := best.get(int(i), [])) == k else None for i in ids]
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        name = f"queries-{table['b'][0].as_py()}"
        put(fs, f"{root}/{name}", [pickle.dumps((ids, v, floors))])
        return pa.table({"name": [name]})

    dealt = query_rows.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return folder, sorted(r["name"] for r in dealt.groupBy("b").applyInArrow(save, "name string").collect())  # a name per file


def _read_queries(folder: str, name: str):
    fs, root = store(folder)
    with fs.open_input_file(f"{root}/{name}") as f:
        return pickle.loads(f.read())


def exact_topk(vectors: DataFrame, k: int = 10, query_every: int = 100, id_col: str = "vec_id",
               vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows by integer inner product.

    Queries are the rows whose id is divisible by ``query_every``; candidates all rows with another
    id; ties go to the smaller vec_id; fewer candidates than k give all. Vectors that are null or hold
    null or non-finite components take no part, nor do rows without an id; a shorter vector counts as
    padded with zeros, an empty one scores zero. Scores beyond 64 bits are given as the nearest 64-bit number. Repeated rows: one id is one candidate and one
    query, its vector the largest in array order. Tables without queries or candidates give no rows.
    Other columns are ignored.

    A task holds one candidate group and one query block, both of fixed size; every group meets every
    query block, as any exact search of a stated query set must, and gives on what can still be among the k best.
    """
    rows = quantised(vectors, id_col, vector_col, scale)
    rows = cut_lineage(rows.groupBy("vec_id").agg(F.max("v").alias("v")))
    query_rows = rows.filter(F.col("vec_id") % query_every == 0)
    folder, names = _write_queries(query_rows, k)

    def search(batches):
        def groups():
            held, size = [], 0
            for batch in batches:
                at = 0
                while at < len(batch):
                    held.append(batch.slice(at, GROUP_ROWS - size))
                    at, size = at + len(held[-1]), size + len(held[-1])
                    if size == GROUP_ROWS:
                        yield pa.Table.from_batches(held)
                        held, size = [], 0
            if held:
                yield pa.Table.from_batches(held)

        for table in groups():
            table = table.sort_by("vec_id")
            v, ids = table["v"].to_pylist(), table["vec_id"].to_numpy()
            for name in names:
                query_ids, queries, floors = _read_queries(folder, name)
                width = max([len(x) for x in (*v, *queries)], default=0)
                found, _ = block_topk(_matrix(queries, width), query_ids, _matrix(v, width), ids, k, floors=floors)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["query_id", "vec_id", "score"])

    found = rows.mapInArrow(search, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


__all__ = ["block_topk", "exact_topk", "quantised"]
