"""Queries that run a stream over the given tables and return what it wrote (H)."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from pagewright.plans import fixtures as fx
from pagewright.plans.fixtures import with_views
from pagewright.plans.intake_queries import _CLASSIFIED
from pagewright.plans.metering_queries import GAP_SECONDS
from pagewright.plans.registry import query
from pagewright.session import scratch_path
from pagewright.streaming import streams as S

IDLE_SECONDS = 3600


def _usage(spark, sf):
    return fx.usage_of(fx.stream_table(spark, sf, "events"))


@query("h1_stream_intake", with_views(
    f"SELECT file_id, error_class, error_message FROM ({_CLASSIFIED})", "files_fx"))
def _(spark, sf):
    files = fx.files_of(fx.stream_table(spark, sf, "pages"))
    accepted = S.ready_output(spark, "accepted", files.schema)
    rejected = S.ready_output(spark, "quarantine", files.schema.add("error_class", "string").add("error_message", "string"))
    S.stream_intake(files, accepted, rejected, scratch_path(spark, "intake-state")).awaitTermination()
    none = F.lit(None).cast("string")
    good = spark.read.parquet(accepted).select("file_id", none.alias("error_class"), none.alias("error_message"))
    return good.unionByName(spark.read.parquet(rejected).select("file_id", "error_class", "error_message"))


# Run in update mode, so that windows still open at the end are given out as they stand.
@query("h2_stream_usage", with_views("""
  SELECT user_id, CAST(CAST(day AS DATE) AS VARCHAR) AS day, CAST(sum(pages) AS BIGINT) AS pages, count(*) AS events
  FROM (SELECT *, date_trunc('day', ts) AS day FROM usage_fx)
  GROUP BY ALL""", "usage_fx"))
def _(spark, sf):
    days = S.latest_updates(
        S.run_available(S.stream_usage(_usage(spark, sf)), "usage", "update"), ["user_id", "day"])
    return days.select("user_id", F.col("day").cast("date").cast("string").alias("day"), "pages", "events")


def _windows(stream, name):
    return S.latest_updates(S.run_available(stream, name, "update"), ["user_id", "window_start", "window_end"])


def _windows_sql(minutes: str) -> str:
    return f"""
      SELECT user_id, window_start, window_start + INTERVAL 1 MINUTE AS window_end, count(*) AS requests
      FROM ({minutes})
      GROUP BY ALL HAVING count(*) > 1"""


@query("h3_stream_rate_limit", with_views(_windows_sql(
    "SELECT *, date_trunc('minute', ts) AS window_start FROM usage_fx"), "usage_fx"))
def _(spark, sf):
    return _windows(S.stream_rate_limit(_usage(spark, sf), 1), "rate")


@query("h3_stream_rate_limit_sliding", with_views(_windows_sql("""
  SELECT *, time_bucket(INTERVAL 30 SECOND, ts) - k * INTERVAL 30 SECOND AS window_start
  FROM usage_fx, (VALUES (0), (1)) v(k)"""), "usage_fx"))
def _(spark, sf):
    return _windows(S.stream_rate_limit(_usage(spark, sf), 1, "30 seconds"), "rate-sliding")


@query("h4_stream_jobs", with_views(f"""
  , j AS (SELECT job_id, count(*) AS total, count(*) FILTER (file_status <> 'processing') AS done,
                 count(*) FILTER (file_status = 'failed') AS failed, max(ts) AS last_ts
          FROM job_files_fx GROUP BY 1),
    n AS (SELECT *, 5 AS want,
                 last_ts + INTERVAL {IDLE_SECONDS} SECOND < (SELECT max(ts) FROM job_files_fx) - INTERVAL 10 MINUTE AS idle
          FROM j)
  SELECT job_id, CASE WHEN done >= want THEN 'completed' WHEN idle THEN 'failed' ELSE 'processing' END AS status,
         done * 100.0::DOUBLE / want AS progress, done, failed,
         CASE WHEN done < want AND idle THEN 'idle' WHEN failed > 0 THEN failed || ' file(s) failed' END AS error
  FROM n""", "job_files_fx"))
def _(spark, sf):
    files = fx.job_files_of(fx.stream_table(spark, sf, "events")).withColumn("total", F.lit(5).cast("long"))
    updates = S.run_available(S.stream_jobs(files, IDLE_SECONDS), "jobs", "update")
    latest = updates.groupBy("job_id").agg(F.max_by(F.struct(
        "status", "progress", "done", "failed", "error"), "batch_id").alias("u"))
    return latest.select("job_id", "u.*")


@query("h5_stream_dedupe", "SELECT DISTINCT sha256(text) AS digest FROM documents")
def _(spark, sf):
    documents = fx.stream_table(spark, sf, "documents").select(
        "doc_id", "text", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("ts"))
    return S.run_available(S.stream_dedupe(documents, "text", "1 hour"), "dedupe").select("digest")


@query("h6_stream_sessions", with_views("""
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end,
         count(*) AS events, CAST(sum(pages) AS BIGINT) AS pages
  FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
        FROM (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                               + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS opens FROM usage_fx))
  GROUP BY user_id, s""", "usage_fx"))
def _(spark, sf):
    """All sessions: a second run goes on after a heartbeat past the last event, which closes what the first left open."""
    usage, beats = _usage(spark, sf), scratch_path(spark, "beats")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in usage.schema])
    closed = lambda: S.stream_sessions(usage.unionByName(S.heartbeats(spark, beats, schema)), GAP_SECONDS)
    out, state = S.ready_output(spark, "sessions", closed().schema), scratch_path(spark, "sessions-state")
    S.run_available(closed(), "sessions", out=out, state=state)
    last = fx.usage_fx(spark, sf).agg(F.max("ts") + F.expr(f"INTERVAL {GAP_SECONDS + 2 * 3600} SECONDS")).first()[0]
    S.land_heartbeat(spark, beats, schema, last)
    return S.run_available(closed(), "sessions", out=out, state=state).drop("batch_id")
