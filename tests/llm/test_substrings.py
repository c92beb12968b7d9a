import random

import pytest

from pagewright.llm import lz_dedup
from tests.llm import brute

SCHEMA = "lang int, doc_id long, text string, _id string, anchor double, start int"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(1, d, t, "x", 0.5, 3) for d, t in rows], SCHEMA).repartition(3)


def key(rows):
    return sorted(map(repr, rows))


def random_documents(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    passages = [" ".join(rng.choices(words, k=rng.randint(20, 90))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(words, k=rng.randint(1, 60)))
                 for _ in range(rng.randint(0, 4))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(7, rows[7][1]), (n, None), (n + 1, ""), (n + 2, " \t\n"), (None, passages[0]), (None, None)]
    rows += [(n + 3, " ".join(passages * 20)), (n + 4, " ".join(["same"] * 200)), (n + 5, "é ü " * 40)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_windows_equal_brute_force(spark, seed):
    rows = random_documents(seed)
    got = lz_dedup.remove_repeats(frame(spark, rows)).drop("kept_text").collect()
    assert key(map(tuple, got)) == key(brute.repeated_windows(rows))


def test_repeated_windows_kept_text_and_empty(spark):
    passage = " ".join(f"p{i}" for i in range(35))
    got = lz_dedup.remove_repeats(frame(spark, [(1, f"a b {passage} c"), (2, f"{passage} d"), (3, "e f")]))
    assert {r["doc_id"]: r["kept_text"] for r in got.collect()} == {1: "a b c", 2: "d", 3: "e f"}
    assert lz_dedup.remove_repeats(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_repeated_windows_on_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = lz_dedup.remove_repeats(docs).drop("kept_text").collect()
    assert key(map(tuple, got)) == key(brute.repeated_windows(rows))
