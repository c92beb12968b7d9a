"""Reuse of results by digest: exact whatever the filters say, contents not shuffled, nothing processed twice."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pagewright.operators import layout as L, result_store as R

SCHEMA = "doc_id long, text string, _bits int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("bits", [1 << 12, 64])
def test_split_is_exact(spark, monkeypatch, bits):
    """Also with a filter so small that it holds nearly everything."""
    monkeypatch.setattr(R, "LEAST_BITS", bits)
    monkeypatch.setattr(R, "MOST_BITS", bits)
    rows = [(i, f"text {i % 120}") for i in range(300)] + [(900, None), (901, ""), (None, "text 1"), (902, "")]
    known = {hashlib.sha256(t.encode()).hexdigest() for t in [f"text {i}" for i in range(0, 120, 3)] + ["", "elsewhere"]}
    results = spark.createDataFrame([(d, 1) for d in sorted(known)] + [(None, 2)], "digest string, n int")
    yes, no = L.cached_results(docs(spark, rows), results)
    is_known = lambda t: t is not None and hashlib.sha256(t.encode()).hexdigest() in known
    assert sorted(map(repr, yes.select("doc_id", "text").collect())) == sorted(map(repr, docs(spark, [r for r in rows if is_known(r[1])]).collect()))
    assert sorted(map(repr, no.select("doc_id", "text").collect())) == sorted(map(repr, docs(spark, [r for r in rows if not is_known(r[1])]).collect()))
    assert yes.columns == no.columns == ["doc_id", "text", "digest"]


def test_empty_sides(spark):
    some, none = docs(spark, [(1, "a")]), docs(spark, [(1, "a")]).limit(0)
    digests = lambda rows: rows.select(L.digest("text").alias("digest"))
    assert [x.count() for x in R.split_known(some, digests(none))] == [0, 1]
    assert [x.count() for x in R.split_known(none, digests(some))] == [0, 0]
    assert [x.count() for x in R.split_known(some, digests(some))] == [1, 0]


def test_contents_of_undoubted_rows_cross_no_exchange(spark):
    rows = docs(spark, [(i, f"text {i}") for i in range(50)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for side in R.split_known(rows, rows.filter("doc_id < 9").select(L.digest("text").alias("digest"))):
            plan = side._jdf.queryExecution().optimizedPlan().toString()
            assert "Union" in plan
            moved = [x for x in side._jdf.queryExecution().executedPlan().toString().splitlines()
                     if "Exchange hashpartitioning" in x and "ENSURE_REQUIREMENTS" in x]
            assert len(moved) <= 2  # the doubtful rows and the digests they are held against
            assert "BroadcastNestedLoopJoin" not in side._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_second_run_processes_nothing_again(spark, tmp_path):
    store, seen = R.ResultStore(spark, str(tmp_path / "store")), []

    def process(new):
        seen.append(sorted(r["text"] for r in new.collect()))
        return new.select("digest", F.upper("text").alias("read"))

    first = docs(spark, [(1, "a"), (2, "b"), (3, "a")])
    got = store.reuse(first, process, 0)
    assert sorted((r["doc_id"], r["read"]) for r in got.collect()) == [(1, "A"), (2, "B"), (3, "A")]
    more = docs(spark, [(1, "a"), (4, "c"), (5, "c"), (2, "b")])
    got = store.reuse(more, process, 1)
    assert sorted((r["doc_id"], r["read"]) for r in got.collect()) == [(1, "A"), (2, "B"), (4, "C"), (5, "C")]
    store.reuse(more, process, 2).count()
    assert seen == [["a", "b"], ["c"], []]


def test_unfinished_batches_are_not_seen(spark, tmp_path):
    store = R.ResultStore(spark, str(tmp_path / "store"))
    one = docs(spark, [(1, "a")]).select(L.digest("text").alias("digest"), F.lit("old").alias("read"))
    store.add(one, 0)
    one.withColumn("read", F.lit("half")).write.parquet(str(tmp_path / "store/results/batch=1"))  # died before its commit
    assert [r["read"] for r in store.results().collect()] == ["old"]
    store.add(one.withColumn("read", F.lit("new")), 1)
    store.add(one.withColumn("read", F.lit("new")), 1)  # run again
    assert [r["read"] for r in store.results().collect()] == ["new"] and store.digests().count() == 1
