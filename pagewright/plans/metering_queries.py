"""Queries on jobs, usage, licences and limits (G), and batch sessions (H6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import metering as M
from pagewright.plans import fixtures as fx
from pagewright.plans.fixtures import with_views
from pagewright.plans.registry import query
from pagewright.session import scratch_path

AS_OF = "2024-01-15"
CAPPED_AS_OF = "2024-01-27"
LIMITS = {"free": 20, "pro": 270, "enterprise": 2000}
GAP_SECONDS = 6 * 3600

_JOBS = """
  SELECT job_id, CASE WHEN n = d THEN 'completed' ELSE 'processing' END AS status,
         d * 100.0::DOUBLE / n AS progress,
         CASE WHEN f > 0 THEN f || ' file(s) failed' END AS error
  FROM (SELECT job_id, count(*) AS n, count(*) FILTER (file_status <> 'processing') AS d,
               count(*) FILTER (file_status = 'failed') AS f FROM job_files_fx GROUP BY 1)"""


@query("g1_job_status", with_views(f"""
  SELECT job_id, status, round(progress, 9) AS progress, error FROM ({_JOBS})
  UNION ALL SELECT job_id + 1000000000, 'not_found', NULL, NULL FROM ({_JOBS})""", "job_files_fx"))
def _(spark, sf):
    files = fx.job_files_fx(spark, sf)
    jobs = files.select("job_id").distinct()
    unknown = jobs.select((F.col("job_id") + 1000000000).alias("job_id"))
    return M.job_status(jobs.unionByName(unknown), files).withColumn("progress", F.round("progress", 9))


@query("g2_purge_jobs", with_views(f"""
  , done AS (SELECT job_id FROM ({_JOBS}) WHERE status = 'completed')
  SELECT 'job' AS kind, job_id, NULL AS format FROM ({_JOBS}) WHERE status <> 'completed'
  UNION ALL SELECT 'output', job_id, f FROM ({_JOBS}), (VALUES ('txt'), ('json')) v(f) WHERE status <> 'completed'
  UNION ALL SELECT 'unknown', job_id + 1000000000, NULL FROM done""", "job_files_fx"))
def _(spark, sf):
    files = fx.job_files_fx(spark, sf)
    jobs = files.select("job_id").distinct()
    done = M.job_status(jobs, files).filter(F.col("status") == "completed").select("job_id")
    outputs = jobs.withColumn("format", F.explode(F.array(F.lit("txt"), F.lit("json"))))
    ids = done.unionByName(done.select((F.col("job_id") + 1000000000).alias("job_id")))
    left, kept, unknown = M.purge_jobs(jobs, outputs, ids)
    row = lambda df, kind, fmt: df.select(F.lit(kind).alias("kind"), "job_id", fmt.alias("format"))
    none = F.lit(None).cast("string")
    return (row(left, "job", none).unionByName(row(kept, "output", F.col("format")))
            .unionByName(row(unknown, "unknown", none)))


@query("g3_usage_running_total", with_views("""
  SELECT event_id, user_id, pages, CAST(sum(pages) OVER (PARTITION BY user_id ORDER BY ts, event_id
         ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_pages FROM usage_fx""", "usage_fx"))
def _(spark, sf):
    return M.usage_running_total(fx.usage_fx(spark, sf)).select(
        "event_id", "user_id", "pages", "running_pages")


@query("g4_usage_history", with_views("""
  SELECT event_id, user_id, pages FROM usage_fx ORDER BY ts DESC, event_id DESC LIMIT 1000""", "usage_fx"))
def _(spark, sf):
    return M.usage_history(fx.usage_fx(spark, sf)).select("event_id", "user_id", "pages")


@query("g4_usage_history_per_user", with_views("""
  SELECT event_id, user_id, pages FROM usage_fx
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20""", "usage_fx"))
def _(spark, sf):
    return M.usage_history(fx.usage_fx(spark, sf), 20, per_user=True).select("event_id", "user_id", "pages")


@query("g5_usage_stats", with_views("""
  SELECT (SELECT CAST(sum(pages) AS BIGINT) FROM usage_fx) AS total_pages,
         (SELECT CAST(coalesce(sum(pages), 0) AS BIGINT)
          FROM (SELECT * FROM usage_fx ORDER BY ts DESC, event_id DESC LIMIT 1000)
          WHERE CAST(ts AS DATE) = DATE '2024-01-27') AS daily_pages,
         (SELECT CAST(coalesce(sum(pages), 0) AS BIGINT) FROM usage_fx
          WHERE CAST(ts AS DATE) = DATE '2024-01-27') AS exact_daily_pages""", "usage_fx"))
def _(spark, sf):
    usage = fx.usage_fx(spark, sf)
    exact = M.usage_stats(usage, CAPPED_AS_OF, None).select(F.col("daily_pages").alias("exact_daily_pages"))
    return M.usage_stats(usage, CAPPED_AS_OF, M.HISTORY_CAP).crossJoin(F.broadcast(exact))  # one row each


@query("g5_usage_stats_per_user", with_views("""
  SELECT user_id, CAST(sum(pages) AS BIGINT) AS total_pages,
         CAST(coalesce(sum(pages) FILTER (rn <= 20 AND CAST(ts AS DATE) = DATE '2024-01-27'), 0) AS BIGINT)
           AS daily_pages
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM usage_fx)
  GROUP BY user_id""", "usage_fx"))
def _(spark, sf):
    return M.usage_stats(fx.usage_fx(spark, sf), CAPPED_AS_OF, 20, per_user=True)


@query("g6_usage_by_type_day", with_views("""
  SELECT CAST(day AS VARCHAR) AS day, doc_type, CAST(grouping(day, doc_type) AS BIGINT) AS level,
         CAST(sum(pages) AS BIGINT) AS pages, count(*) AS events
  FROM (SELECT *, CAST(ts AS DATE) AS day FROM usage_fx) GROUP BY ROLLUP (day, doc_type)""", "usage_fx"))
def _(spark, sf):
    return M.usage_by_type_day(fx.usage_fx(spark, sf)).withColumn("day", F.col("day").cast("string"))


_LICENSED = """
  SELECT *, CASE WHEN license_key IS NULL THEN NULL
                 WHEN len(p) < 2 THEN 'Invalid key format'
                 WHEN try_strptime(p[2], '%Y%m%d') IS NULL
                   THEN 'time data ''' || p[2] || ''' does not match format ''%Y%m%d'''
                 WHEN TIMESTAMP '2024-01-15 00:00:01' > strptime(p[2], '%Y%m%d') THEN 'expired' END AS reason
  FROM (SELECT *, string_split(license_key, '-') AS p FROM licenses_fx)"""
_LICENSED = f"""
  SELECT *, CASE WHEN reason IS NULL AND license_key IS NOT NULL THEN lower(p[1]) ELSE 'free' END AS plan
  FROM ({_LICENSED})"""


def _licensed(spark, sf):
    return M.validate_license(fx.licenses_fx(spark, sf), "2024-01-15 00:00:01")


@query("g7_validate_license", with_views(f"""
  SELECT user_id, plan, reason IS NULL AS valid, reason,
         CASE WHEN reason IS NULL AND license_key IS NOT NULL THEN p[2] END AS expires
  FROM ({_LICENSED})""", "licenses_fx"))
def _(spark, sf):
    return _licensed(spark, sf).select("user_id", "plan", "valid", "reason", "expires")


@query("g8_check_feature", with_views(f"""
  SELECT user_id, plan IN ('pro', 'enterprise') AS batch_allowed, plan = 'enterprise' AS custom_allowed,
         CASE plan WHEN 'pro' THEN 'ocr_basic,ocr_advanced,batch_processing,priority_support'
           WHEN 'enterprise' THEN 'ocr_basic,ocr_advanced,batch_processing,priority_support,on_prem_deployment,custom_models'
           ELSE 'ocr_basic' END AS features
  FROM ({_LICENSED})""", "licenses_fx"))
def _(spark, sf):
    batch = M.check_feature(_licensed(spark, sf), "batch_processing").withColumnRenamed("allowed", "batch_allowed")
    both = M.check_feature(batch, "custom_models").withColumnRenamed("allowed", "custom_allowed")
    return both.select("user_id", "batch_allowed", "custom_allowed",
                       F.array_join("features", ",").alias("features"))


_QUOTA = f"""
  SELECT user_id, month, plan, pages, max_pages, pages > max_pages AS over_quota,
         greatest(max_pages - pages, 0) AS remaining
  FROM (SELECT u.user_id, month, coalesce(plan, 'free') AS plan, pages,
               CASE coalesce(plan, 'free') WHEN 'pro' THEN 270 WHEN 'enterprise' THEN 2000 ELSE 20 END AS max_pages
        FROM (SELECT user_id, date_trunc('month', ts) AS month, CAST(sum(pages) AS BIGINT) AS pages
              FROM usage_fx GROUP BY ALL) u LEFT JOIN ({_LICENSED}) l USING (user_id))"""


@query("g9_monthly_quota", with_views(f"""
  SELECT user_id, CAST(CAST(month AS DATE) AS VARCHAR) AS month, plan, pages, max_pages, over_quota, remaining
  FROM ({_QUOTA})""", "usage_fx", "licenses_fx"))
def _(spark, sf):
    quota = M.monthly_quota(fx.usage_fx(spark, sf), _licensed(spark, sf), LIMITS)
    return quota.withColumn("month", F.col("month").cast("date").cast("string"))


@query("g10_rate_limit", with_views("""
  SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts)
         ORDER BY ts, event_id) > 1 AS limited FROM usage_fx""", "usage_fx"))
def _(spark, sf):
    return M.rate_limit(fx.usage_fx(spark, sf), 1).select("event_id", "user_id", "limited")


@query("g13_log_records", """
  SELECT json_extract_string(j, '$.timestamp') AS stamp, json_extract_string(j, '$.level') AS level,
         json_extract_string(j, '$.function') AS function, CAST(json_extract(j, '$.line') AS BIGINT) AS line,
         json_extract_string(j, '$.message') AS message, json_extract_string(j, '$.exception.value') AS failure
  FROM (SELECT json_object('timestamp', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'),
          'level', CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END,
          'function', event_type, 'line', event_id % 400, 'message', props,
          'exception', CASE WHEN event_type = 'error' THEN json_object('value', 'event ' || event_id) END) AS j
        FROM events)""")
def _(spark, sf):
    events = fx.table(spark, sf, "events")
    failed = F.col("event_type") == "error"
    error = F.when(failed, F.struct(F.lit("ServerException").alias("type"),
                                    F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("value")))
    lines = M.log_records(events.select(
        F.col("ts").alias("timestamp"), F.when(failed, "ERROR").otherwise("INFO").alias("level"),
        F.lit("pagewright").alias("logger"), F.col("event_type").alias("function"),
        (F.col("event_id") % 400).alias("line"), F.col("props").alias("message"), error.alias("exception")))
    parsed = F.from_json("value", "timestamp string, level string, function string, line bigint, "
                                  "message string, exception struct<value: string>")
    return lines.select(parsed.alias("j")).select(
        F.col("j.timestamp").alias("stamp"), "j.level", "j.function", "j.line", "j.message",
        F.col("j.exception.value").alias("failure"))


@query("g14_service_metrics", """
  SELECT event_type, count(*) AS requests,
         round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 9) AS per_second,
         round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
         round(quantile_cont(value, 0.99), 6) AS p99,
         round(avg(CASE WHEN event_id % 7 = 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS error_rate
  FROM events GROUP BY event_type""")
def _(spark, sf):
    events = fx.table(spark, sf, "events").select(
        "event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("latency"),
        (F.col("event_id") % 7 == 0).alias("is_error"))
    m = M.service_metrics(events, ["event_type"], exact=True)
    rounded = {"per_second": 9, "error_rate": 9, "p50": 6, "p95": 6, "p99": 6}
    return m.withColumns({c: F.round(c, d) for c, d in rounded.items()})


@query("g14_sketch_percentiles", """
  SELECT event_type, n, s.name, true AS within
  FROM (SELECT event_type, count(*) AS n FROM events
        WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' GROUP BY event_type),
       (VALUES ('p50'), ('p95'), ('p99')) s(name)""")
def _(spark, sf):
    """Percentiles of a range of days from stored daily sketches; their true rank must be within a percent of the one asked for."""
    events = fx.table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("latency"))
    path = scratch_path(spark, "sketches")
    M.latency_sketches(events, ["event_type"]).write.parquet(path)
    found = M.sketch_percentiles(spark.read.parquet(path), ["event_type"], M.LATENCY_SHARES, "2024-01-03", "2024-01-20")
    asked = found.select("event_type", "n", F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(s).alias("share"), F.col(n).alias("v")) for n, s in M.LATENCY_SHARES.items()])).alias("a"))
    some = events.filter(F.col("ts").cast("date").between("2024-01-03", "2024-01-20"))
    ranks = some.join(F.broadcast(asked), "event_type").groupBy("event_type", "n", "a").agg(  # three rows per type
        F.avg((F.col("latency") < F.col("a.v")).cast("int")).alias("below"), F.avg((F.col("latency") <= F.col("a.v")).cast("int")).alias("upto"))
    within = (F.col("below") <= F.col("a.share") + 0.01) & (F.col("upto") >= F.col("a.share") - 0.01)
    return ranks.select("event_type", "n", "a.name", within.alias("within"))


@query("g2_purge_stored", """
  SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events WHERE NOT (CAST(ts AS DATE) < DATE '2024-01-04' OR event_id % 97 = 0)""")
def _(spark, sf):
    """Events stored by day, those of the first days and some others purged, twice."""
    path = scratch_path(spark, "stored")
    events = fx.table(spark, sf, "events").select("event_id", F.col("ts").cast("date").alias("day"))
    events.write.partitionBy("day").parquet(path)
    old = events.filter((F.col("day") < "2024-01-04") | (F.col("event_id") % 97 == 0)).select("event_id")
    for _ in range(2):
        M.purge_stored(spark, path, old, "event_id")
    return spark.read.parquet(path).select("event_id", F.col("day").cast("string").alias("day"))


@query("h6_usage_sessions", with_views("""
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end,
         count(*) AS events, CAST(sum(pages) AS BIGINT) AS pages
  FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
        FROM (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                               + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS opens FROM usage_fx))
  GROUP BY user_id, s""", "usage_fx"))
def _(spark, sf):
    return M.usage_sessions(fx.usage_fx(spark, sf), GAP_SECONDS)


@query("i11_queue_users", with_views(f"""
  SELECT user_id, total_pages, daily_pages, q.plan, q.remaining
  FROM (SELECT user_id, CAST(sum(pages) AS BIGINT) AS total_pages,
               CAST(coalesce(sum(pages) FILTER (CAST(ts AS DATE) = DATE '2024-01-15'), 0) AS BIGINT) AS daily_pages
        FROM usage_fx GROUP BY 1)
  LEFT JOIN (SELECT * FROM ({_QUOTA}) WHERE month = TIMESTAMP '2024-01-01') q USING (user_id)""",
    "usage_fx", "licenses_fx"))
def _(spark, sf):
    users, _recent = M.queue_report(fx.usage_fx(spark, sf), _licensed(spark, sf), LIMITS, AS_OF)
    return users


@query("i11_queue_recent", with_views("""
  SELECT event_id, user_id, doc_type, pages FROM usage_fx ORDER BY ts DESC, event_id DESC LIMIT 10""", "usage_fx"))
def _(spark, sf):
    _users, recent = M.queue_report(fx.usage_fx(spark, sf), _licensed(spark, sf), LIMITS, AS_OF)
    return recent.select("event_id", "user_id", "doc_type", "pages")
