"""Licence dates, quotas, job progress and capped history."""

import pytest
from pyspark.sql import functions as F

from pagewright.operators import metering as M


def licensed(spark, key, as_of):
    df = spark.createDataFrame([(1, key)], "user_id long, license_key string")
    return M.validate_license(df, as_of).first()


@pytest.mark.parametrize("key, plan, valid, reason", [
    (None, "free", True, None),
    ("", "free", True, None),
    ("PRO", "free", False, "Invalid key format"),
    ("pro-20241301-S", "free", False, "unconverted data remains: 1"),
    ("pro-soon-S", "free", False, "time data 'soon' does not match format '%Y%m%d'"),
    ("pro-20300230-S", "free", False, "day is out of range for month"),
    ("pro-2030115-S", "pro", True, None),
    ("PRO-20240115-S", "free", False, "expired"),
    ("gold-20300101", "gold", True, None),
    ("Enterprise-20300101-S", "enterprise", True, None),
])
def test_keys(spark, key, plan, valid, reason):
    row = licensed(spark, key, "2024-01-15 00:00:01")
    assert (row.plan, row.valid, row.reason) == (plan, valid, reason)


def test_expiry_is_the_start_of_the_day(spark):
    assert licensed(spark, "pro-20240115-S", "2024-01-15 00:00:00").valid
    assert licensed(spark, "pro-20240115-S", "2024-01-14 23:59:59").expires == "20240115"


def test_unknown_plans_get_basic_features(spark):
    df = spark.createDataFrame([(1, "gold-20300101"), (2, "pro-20300101")], "user_id long, license_key string")
    got = {r.user_id: r.allowed for r in
           M.check_feature(M.validate_license(df, "2024-01-01"), "batch_processing").collect()}
    assert got == {1: False, 2: True}


def test_job_progress(spark):
    files = spark.createDataFrame(
        [(1, "completed"), (1, "failed"), (2, "processing"), (2, "completed")], "job_id long, file_status string")
    jobs = spark.createDataFrame([(1,), (2,), (9,)], "job_id long")
    got = {r.job_id: (r.status, r.progress, r.error) for r in M.job_status(jobs, files).collect()}
    assert got == {1: ("completed", 100.0, "1 file(s) failed"), 2: ("processing", 50.0, None),
                   9: ("not_found", None, None)}
    bare = spark.createDataFrame([(1, None, None), (2, 0, 0)], "job_id long, total long, completed long")
    new = {r.job_id: r.progress for r in M.job_status(bare, files).collect()}
    old = {r.job_id: r.progress for r in M.job_status(bare, files, legacy=True).collect()}
    assert new == {1: 100.0, 2: None} and old == {1: 0.0, 2: None}


def test_capped_history_changes_the_day_total(spark):
    df = spark.range(10).select(
        F.col("id").alias("event_id"), F.lit(1).alias("user_id"), F.lit(2).alias("pages"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("ts"))
    assert M.usage_stats(df, "2024-01-01", 3).first().daily_pages == 6
    assert M.usage_stats(df, "2024-01-01").first().daily_pages == 20
    assert M.usage_stats(df, "2024-01-02", None).first().daily_pages == 0
    assert M.usage_stats(df, "2024-01-01", 3, per_user=True).first().total_pages == 20


def test_quota_edge(spark):
    usage = spark.createDataFrame([(1, 20), (2, 21)], "user_id long, pages int").withColumn(
        "ts", F.lit("2024-02-03").cast("timestamp"))
    plans = spark.createDataFrame([(1, "free")], "user_id long, plan string")
    got = {r.user_id: (r.plan, r.over_quota, r.remaining)
           for r in M.monthly_quota(usage, plans, {"free": 20}).collect()}
    assert got == {1: ("free", False, 0), 2: ("free", True, 0)}
