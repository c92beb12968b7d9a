import random

import pytest

from pagewright.llm import simhash
from tests.llm import brute


def as_rows(df):
    return sorted(map(repr, map(tuple, df.select("doc_id", "fingerprint", "component_id").collect())))


def near_copies(rng, n):
    words = [f"t{i}" for i in range(400)]
    bases = [rng.choices(words, k=rng.randint(3, 120)) for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = near_copies(rng, 150)
    rows += [(3, rows[3][1]), (900, None), (901, ""), (902, " \n"), (None, rows[5][1]), (None, "only here once"),
             (903, "ÀB cd E"), (904, "one"), (905, "z " * 30_000)]
    docs = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id long, text string, fp int, root string")
    assert as_rows(simhash.near_duplicates(docs)) == sorted(map(repr, brute.near_duplicates(rows)))


def test_whole_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert as_rows(simhash.near_duplicates(docs)) == sorted(map(repr, brute.near_duplicates(rows)))


@pytest.mark.parametrize("crowd", [0, 2, 1000])
@pytest.mark.parametrize("max_bits,segments", [(4, 3), (3, 2), (6, 4)])
def test_links_in_dense_tables(spark, monkeypatch, crowd, max_bits, segments):
    """Crowded entries, random points around few centres: every crowd limit finds the same components."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(crowd + max_bits)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = {0, 1} | {rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7)))
                    for _ in range(200)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    got = dict(map(tuple, simhash.linked(
        spark.createDataFrame([(signed(f),) for f in fps], "fp long"), max_bits, segments).collect()))
    want = brute.linked_components(fps, max_bits)
    groups = lambda roots: sorted(sorted(f for f in fps if roots(f) == r) for r in {roots(f) for f in fps})
    assert groups(lambda f: got.get(signed(f), signed(f))) == groups(lambda f: want[f])


def test_keep_one(spark):
    text = " ".join(f"k{i}" for i in range(60))
    rows = [(4, text, "b"), (2, text, "a"), (2, text, "a"), (9, "other words here entirely", "c"), (None, text, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [2, 9]
    assert simhash.keep_one(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs).columns == docs.columns


def test_keep_one_of_every_component(spark):
    """Null and repeated ids in several components: brute force picks one row of each."""
    rng = random.Random(5)
    rows = [(rng.choice([None, None, 7, 7, i]), t, rng.choice("ab")) for i, t in near_copies(rng, 80)]
    rows += [(None, f"only without id {i} " + " ".join(rng.choices("uvwxyz", k=30)), "n") for i in range(10)]
    rows += [(7, f"same id {i} " + " ".join(rng.choices("opqrst", k=30)), "m") for i in range(10)]
    rows += [(None, rows[-1][1], "x"), (8, rows[-1][1], "x"), rows[-1], rows[-1]]
    fps = [brute.simhash(t) for _, t, _ in rows]
    roots = brute.linked_components(fps)
    got = [tuple(r) for r in simhash.keep_one(
        spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    assert sorted(roots[brute.simhash(t)] for _, t, _ in got) == sorted(set(roots.values())) and set(got) <= set(rows)
    for d, t, _ in got:
        ids = [x for (x, _, _), f in zip(rows, fps) if roots[f] == roots[brute.simhash(t)] and x is not None]
        assert d == min(ids, default=None)
