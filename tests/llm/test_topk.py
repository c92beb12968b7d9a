import math
import random

import numpy as np
import pytest

from pagewright.llm import vector_topk


def brute(rows, k=10, every=100):
    vectors = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(1024 * x) for x in v]
        vectors[i] = max(q, vectors.get(i, q))
    out = []
    for q in (i for i in vectors if i % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows],
                                 "vec_id long, embedding array<double>, g int, score double")


@pytest.mark.parametrize("group", [50, 16_384])
def test_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(vector_topk, "GROUP_ROWS", group)
    monkeypatch.setattr(vector_topk, "QUERY_ROWS", 4)
    rng = random.Random(group)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0, rng.random()]) for _ in range(6)]) for i in range(0, 900, 3)]
    rows += [(i, [0.5] * 6) for i in range(1000, 1040)]  # ties
    rows += [(2000, None), (2100, [1.0, None]), (2200, [float("nan")] * 6), (2300, [float("inf")] * 6), (None, [1.0] * 6),
             (2400, []), (2500, [0.1]), (2600, [1e6] * 6), (2601, [1.1e6 + 0.3] * 6), (0, rows[0][1]), (300, [2.0] * 6)]
    got = vector_topk.exact_topk(frame(spark, rows).repartition(3))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_few_rows(spark):
    rows = [(0, [1.0]), (100, [2.0]), (7, [3.0])]
    assert sorted(map(tuple, vector_topk.exact_topk(frame(spark, rows)).collect())) == brute(rows)
    assert vector_topk.exact_topk(frame(spark, rows).filter("vec_id = 7")).count() == 0
    assert vector_topk.exact_topk(frame(spark, rows).limit(0)).count() == 0


def test_blocks_are_pruned():
    rng = np.random.default_rng(1)
    docs = np.abs(rng.integers(0, 3, (4096, 8)))
    docs[:64] += 100  # one block holds all the best
    found, scored = vector_topk.block_topk(np.ones((2, 8), int), np.array([-1, -2]), docs, np.arange(4096), 10, 64)
    assert len(found) == 20 and scored == 2
