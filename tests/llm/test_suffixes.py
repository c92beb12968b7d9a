import random

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import suffix_dedup
from pagewright.llm.common import NULL_ID
from tests.llm import brute
from tests.llm.test_substrings import frame, key, random_documents


@pytest.mark.parametrize("seed", range(12))
def test_suffix_array(seed):
    rng = random.Random(seed)
    n = rng.choice([0, 1, 2, 31, 32, 33, 34, 35, 200, 601, 1000])
    s = [rng.randint(1, rng.choice([1, 2, 300])) for _ in range(n)] if seed % 3 else [1 + i % 3 for i in range(n)]
    assert suffix_dedup.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(n), key=lambda i: s[i:])


def rows_of(df):
    return key(tuple(r)[:5] for r in df.drop("kept").collect())


@pytest.mark.parametrize("seed,crowd,sort,hot", [(1, 2_000, 1 << 19, 4_096), (2, 1, 1 << 19, 4_096), (3, 2_000, 100, 2),
                                                 (4, 3, 1 << 19, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, crowd, sort, hot):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "HOT_SLICES", hot)
    monkeypatch.setattr(suffix_dedup, "RECORD_BYTES", 4_000)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", sort)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 2_000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 500)
    rows = random_documents(seed)
    rng = random.Random(seed)
    rng.shuffle(rows)
    got = suffix_dedup.remove_later_copies(frame(spark, rows))
    assert rows_of(got) == key(brute.repeated_bytes(rows))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(suffix_dedup.remove_later_copies(docs)) == key(brute.repeated_bytes(rows))


def test_kept_bytes_and_empty(spark):
    shared = "".join(chr(65 + i % 26) + str(i) for i in range(30))
    got = suffix_dedup.remove_later_copies(frame(spark, [(2, "é" + shared + "z"), (1, shared)]))
    assert {r["doc_id"]: bytes(r["kept"]) for r in got.collect()} == {1: shared.encode(), 2: "éz".encode()}
    assert suffix_dedup.remove_later_copies(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_slices_are_named_not_carried(spark, monkeypatch):
    """Passes get the names of slices; rows that held the texts met by the dozen in one batch of an executor."""
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 2_000)
    monkeypatch.setattr(suffix_dedup, "TASK_BYTES", 20_000)
    docs = [(None if n == 7 else n, None if n % 10 == 3 else "é" * n * 20) for n in range(90)]
    slices, total = suffix_dedup._slices(frame(spark, docs).repartition(3))
    rows = [r.asDict() for r in slices.collect()]
    assert max(len(str(tuple(r.values()))) for r in rows) < 500 and len({r["slice"] for r in rows}) == len(rows) > 40
    texts = [(NULL_ID if i is None else i, (t or "").encode()) for i, t in docs]
    assert total == sum(len(t) for _, t in texts) and slices.rdd.getNumPartitions() == total // 20_000 + 1
    read = [x for _, ids, found in suffix_dedup._each([pa.RecordBatch.from_pylist(rows)]) for x in zip(ids.tolist(), found)]
    assert sorted(read) == sorted(texts)


def test_windows_are_not_broadcast(spark):
    late = suffix_dedup._later_rows(spark.range(1, 4).selectExpr("id as _id", "cast(cast(id % 2 as string) as binary) as text"))
    assert [r["_id"] for r in late.collect()] == [3]
    assert "Broadcast" not in late._jdf.queryExecution().executedPlan().toString()
