import math
import random

import numpy as np
import pytest

from pagewright.llm import hard_negatives as H


def brute(rows, every=50, positives=5, negatives=3):
    usable = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        label = (label + 1) % 10 if i % 7 == 0 else label
        usable[i] = max((q, label), usable.get(i, (q, label)))
    out = []
    for a, (av, al) in usable.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, label) for i, (v, label) in usable.items() if i != a)
        for ps, p, _ in [x for x in scored if x[2] == al][:positives]:
            fit = [(s, i) for s, i, label in scored if label != al and 50 * -ps <= 100 * -s <= 95 * -ps]
            out += [(a, p, r, i, -ps, -s) for r, (s, i) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows],
                                 "vec_id long, embedding array<double>, label int, score int, v string, rank int").repartition(3)


def clustered(seed, n=900, dims=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    hot = lambda: 3 if rng.random() < 0.4 else rng.randrange(10)
    return [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)], hot()) for i in range(0, 5 * n, 5)]


@pytest.mark.parametrize("block,step,group", [(256, 4096, 32 << 20), (4, 50, 4_000)])
def test_equals_brute_force(spark, monkeypatch, block, step, group):
    for name, value in (("BLOCK_ANCHORS", block), ("STEP_ROWS", step), ("GROUP_BYTES", group)):
        monkeypatch.setattr(H, name, value)
    rows = clustered(block)
    rows += [(9000 + i, [0.5] * 6, i % 4) for i in range(60)]  # ties
    rows += [(9_100, None, 1), (9_150, [1.0, None], 1), (9_200, [float("nan")] * 6, 1), (9_250, [float("-inf")] * 6, 2),
             (None, [1.0] * 6, 1), (9_300, [1.0] * 6, None), (9_350, [], 4), (9_400, [0.3], 4), rows[0], (50, [2.0] * 6, 5)]
    got = H.hard_negatives(frame(spark, rows))
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500


def test_very_large_components(spark):
    rows = [(i, [4e6 + 7 * i, 1e6 - i], i % 2) for i in range(0, 150, 2)] + [(i, [2.6e6 + i, 1.4e6], (i + 1) % 2) for i in range(1, 150, 2)]
    assert sorted(map(tuple, H.hard_negatives(frame(spark, rows)).collect())) == brute(rows) != []


def test_few_rows(spark):
    rows = [(0, [1.0], 1), (2, [2.0], 2), (3, [1.2], 2), (50, [-1.0], 1)]
    assert sorted(map(tuple, H.hard_negatives(frame(spark, rows)).collect())) == brute(rows)
    assert H.hard_negatives(frame(spark, rows).filter("vec_id = 0")).count() == 0
    assert H.hard_negatives(frame(spark, rows).limit(0)).count() == 0


def test_tree_spans_and_bounds_save_work():
    rng = np.random.default_rng(5)
    centres = rng.integers(-200, 200, (8, 16))
    anchors = np.repeat(centres, 16, 0) + rng.integers(-2, 3, (128, 16))
    order, parent, edge = H.spanning_tree(anchors)
    assert sorted(order) == list(range(128)) and (parent < 0).sum() == 1
    place = {int(i): n for n, i in enumerate(order)}
    assert all(place[int(parent[i])] < place[i] for i in range(128) if parent[i] >= 0)
    assert (np.sort(edge)[:120] < 30).all()  # all but the links between the clusters are short
    docs = np.repeat(centres, 512, 0) + rng.integers(-9, 10, (4096, 16))
    ids, labels = np.arange(4096) + 1000, np.zeros(4096, np.int64)
    block = H.Block(np.arange(128), np.zeros(128, np.int64), anchors)
    found, scored = H.search(block, ids, labels, docs, 5)
    exact = anchors @ docs.T
    for a in range(128):
        want = sorted(zip(-exact[a], ids))[:5]
        assert [(v, s) for x, _, v, s in found if x == a] == [(v, -s) for s, v in want]
    assert scored < 0.5 * exact.size
