"""Banded ranks, running sums and joins equal the plain windows."""

import random

from pyspark.sql import Window as W, functions as F

from pagewright.operators import metering as M
from pagewright.operators.ordering import joined_in_order, ranked, running_sum


def table(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.6 else rng.randrange(20), rng.randrange(50), i, rng.randrange(9))
            for i in range(3000)]
    return spark.createDataFrame(rows, "g int, k int, i int, v int").withColumn("b", F.floor(F.col("k") / 10))


def test_rank_and_running_sum(spark):
    df = table(spark)
    w = W.partitionBy("g").orderBy("k", "i")
    want = df.withColumn("r", F.row_number().over(w)).withColumn(
        "s", F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)))
    got = running_sum(ranked(df, ["g"], ["b"], ["k", "i"], "r"), ["g"], ["b"], ["k", "i"], "v", "s")
    cols = ["g", "i", "r", "s"]
    assert got.select(cols).exceptAll(want.select(cols)).isEmpty() and got.count() == 3000


def test_joined_in_order(spark):
    df = table(spark).withColumn("t", F.col("i").cast("string"))
    got = {r.g: r.out for r in joined_in_order(df, ["g"], ["b"], ["k", "i"], "t", "-", "out").collect()}
    rows = {}
    for r in df.collect():
        rows.setdefault(r.g, []).append((r.k, r.i))
    assert got == {g: "-".join(str(i) for _, i in sorted(v)) for g, v in rows.items()}


def usage(spark, seed=5):
    rng = random.Random(seed)
    rows = [(i, 0 if rng.random() < 0.4 else rng.randrange(5), 1704067200 + rng.randrange(200_000), rng.randrange(1, 8))
            for i in range(1500)]
    return spark.createDataFrame(rows, "event_id long, user_id long, s long, pages int").withColumn(
        "ts", F.timestamp_seconds("s"))


def test_sessions_equal_session_window(spark):
    df = usage(spark)
    for gap in (60, 300, 1800):
        want = (df.groupBy("user_id", F.session_window("ts", f"{gap} seconds").alias("w"))
                .agg(F.count("*").alias("events"), F.sum("pages").alias("pages"))
                .select("user_id", "w.start", "w.end", "events", "pages"))
        got = M.usage_sessions(df, gap)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_session_gap_itself_joins_as_session_window_does(spark):
    df = spark.createDataFrame([(1, 1704067200 + s, 1) for s in (0, 60, 121)], "user_id long, s long, pages int")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    want = df.groupBy("user_id", F.session_window("ts", "60 seconds")).count().count()
    assert M.usage_sessions(df, 60).count() == want


def test_rate_limit_flags_what_is_past_the_limit(spark):
    df = usage(spark)
    w = W.partitionBy("user_id", F.date_trunc("minute", "ts")).orderBy("ts", "event_id")
    want = {r.event_id for r in df.withColumn("n", F.row_number().over(w)).filter("n > 2").collect()}
    got = {r.event_id for r in M.rate_limit(df, 2).filter("limited").collect()}
    assert got == want


def test_rows_without_a_key_are_kept(spark):
    df = spark.createDataFrame([(1, 1, 1), (None, 1, 2)], "g int, b int, i int")
    assert {r.i: r.r for r in ranked(df, ["g"], ["b"], ["i"], "r").collect()} == {1: 1, 2: None}


def test_rows_that_lie_together_are_ranked_alike(spark):
    rng = random.Random(6)
    some = lambda n: rng.choice([None, *range(n)])
    rows = [(some(4), some(3), some(3), rng.randrange(5), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, b int, c int, v int, n int").repartition(3, "g")
    banded, whole = (ranked(df, ["g"], ["b", "c"], ["v", "n"], "rank", together) for together in (False, True))
    assert sorted(whole.dtypes) == sorted(banded.dtypes)
    plain = lambda found: sorted(repr(sorted(r.asDict().items())) for r in found.collect())
    assert plain(whole) == plain(banded)
