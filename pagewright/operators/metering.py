"""Jobs, usage, licences, quotas, limits and service measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from pagewright.operators.ordering import ranked, running_sum
from pagewright.session import cut_lineage

#: Features and limits by plan.
BASIC = ["ocr_basic"]
PRO = ["ocr_basic", "ocr_advanced", "batch_processing", "priority_support"]
ENTERPRISE = ["ocr_basic", "ocr_advanced", "batch_processing", "priority_support", "on_prem_deployment", "custom_models"]
FEATURES = {"free": BASIC, "pro": PRO, "enterprise": ENTERPRISE}
HISTORY_CAP = 1000
#: Fixed value: year, month, day (either may lack its leading zero) and what is left over.
EXPIRY = r"(?s)^(\d{4})(1[0-2]|0[1-9]|[1-9])(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])(.*)$"
RATE_PER_MINUTE = 60


def job_status(jobs: DataFrame, job_files: DataFrame, legacy: bool = False) -> DataFrame:
    """Status, progress in percent and error of each requested ``job_id``.

    A job is completed when no file of it is being processed. Unknown ids give
    ``not_found``. A job may bring its own ``total`` and ``completed``; ``legacy`` reads a
    missing completed as 0 and a missing total as 1. A total of 0 gives null.
    """
    counts = job_files.groupBy("job_id").agg(
        F.count("*").alias("n_files"),
        F.count_if(F.col("file_status") != "processing").alias("n_done"),
        F.count_if(F.col("file_status") == "failed").alias("n_failed"))
    joined = jobs.join(counts, "job_id", "left")
    if "total" not in jobs.columns:
        joined = joined.withColumns({"total": F.col("n_files"), "completed": F.col("n_done")})
    known = F.col("n_files").isNotNull()
    finished = F.col("n_done") == F.col("n_files")
    if legacy:
        done, total = F.coalesce("completed", F.lit(0)), F.coalesce("total", F.lit(1))
    else:
        done = F.coalesce("completed", F.when(finished, 1).otherwise(0))
        total = F.coalesce("total", F.lit(1))
    return joined.select(
        "job_id",
        F.when(~known, "not_found").when(finished, "completed").otherwise("processing").alias("status"),
        F.when(known, F.try_divide(done.cast("double"), total) * 100).alias("progress"),
        F.when(F.col("n_failed") > 0, F.concat(F.col("n_failed").cast("string"), F.lit(" file(s) failed")))
        .alias("error"))


def purge_jobs(jobs: DataFrame, outputs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs left, outputs left, ids that named no job) after deleting ``ids``."""
    ids = ids.select("job_id").distinct()
    return (jobs.join(ids, "job_id", "left_anti"), outputs.join(ids, "job_id", "left_anti"),
            ids.join(jobs, "job_id", "left_anti"))


def usage_running_total(usage: DataFrame) -> DataFrame:
    """Add ``running_pages``: pages of the user so far, by time and then event.

    A user may have a third of all events, so totals are carried between minutes and only
    a minute's events of a user are sorted together.
    """
    banded = usage.withColumn("_minute", F.date_trunc("minute", "ts"))
    return running_sum(banded, ["user_id"], ["_minute"], ["ts", "event_id"], "pages",
                       "running_pages").drop("_minute")


def usage_history(usage: DataFrame, cap: int = HISTORY_CAP, per_user: bool = False) -> DataFrame:
    """The latest ``cap`` events, of all or of each user.

    Over all events each task keeps at most ``cap`` rows before any shuffle. A user's events are ranked
    inside minutes and placed by their count, so any ``cap`` has the same plan and no task sorts all
    events of a user. Events without a time are the oldest; those without a user are all kept.
    """
    if not per_user:
        return usage.orderBy(F.desc("ts"), F.desc("event_id")).limit(cap)
    oldest = F.to_timestamp(F.lit("0001-01-01"))
    banded = usage.withColumn("_minute", F.coalesce(F.date_trunc("minute", "ts"), oldest))
    placed = ranked(banded, ["user_id"], ["_minute"], ["ts", "event_id"], "_rank")
    totals = usage.groupBy("user_id").agg(F.count("*").alias("_n"))
    return (placed.join(totals, "user_id", "left")
            .filter(F.col("_rank").isNull() | (F.col("_n") - F.col("_rank") < cap))
            .drop("_minute", "_rank", "_n"))


def usage_stats(usage: DataFrame, as_of: str, history_cap: int | None = None,
                per_user: bool = False) -> DataFrame:
    """Pages in all, and pages on the ``as_of`` day.

    With a ``history_cap`` (``HISTORY_CAP`` is the service's) the day is counted over that many latest events only.
    """
    keys = ["user_id"] if per_user else []
    on_day = F.sum(F.when(F.to_date("ts") == F.lit(as_of).cast("date"), F.col("pages")))
    whole = usage.groupBy(*keys).agg(F.sum("pages").alias("total_pages"),
                                     F.coalesce(on_day, F.lit(0)).alias("daily_pages"))
    if history_cap is None:
        return whole
    recent = usage_history(usage, history_cap, per_user).groupBy(*keys).agg(
        F.coalesce(on_day, F.lit(0)).alias("daily_pages"))
    whole = whole.drop("daily_pages")
    if per_user:
        return whole.join(recent, "user_id")
    return whole.crossJoin(F.broadcast(recent))  # one row each


def usage_by_type_day(usage: DataFrame) -> DataFrame:
    """Pages and events by day and document type, with day totals and the grand total."""
    return usage.rollup(F.to_date("ts").alias("day"), "doc_type").agg(
        F.grouping_id().alias("level"), F.sum("pages").alias("pages"), F.count("*").alias("events"))


def validate_license(licenses: DataFrame, as_of: str) -> DataFrame:
    """Add plan, valid, reason, expires and features from keys of PLAN-EXPIRY-SIGNATURE.

    A key expires at the start of its expiry day. Any plan name is taken as valid.
    """
    parts = F.split("license_key", "-")
    expiry_text = F.get(parts, F.lit(1))
    piece = lambda i: F.regexp_extract(expiry_text, EXPIRY, i)
    shaped, rest = piece(1) != "", piece(4)
    day = F.try_to_timestamp(
        F.concat_ws("-", piece(1), piece(2), F.trim(piece(3))), F.lit("yyyy-M-d"))
    no_key = F.col("license_key").isNull() | (F.col("license_key") == "")
    reason = (
        F.when(no_key, None).when(F.size(parts) < 2, "Invalid key format")
        .when(~shaped, F.concat(F.lit("time data '"), expiry_text,
                                F.lit("' does not match format '%Y%m%d'")))
        .when(rest != "", F.concat(F.lit("unconverted data remains: "), rest))
        .when(day.isNull(), "day is out of range for month")
        .when(F.lit(as_of).cast("timestamp") > day, "expired"))
    checked = licenses.withColumn("reason", reason)
    valid = F.col("reason").isNull()
    plan = F.when(valid & ~no_key, F.lower(F.get(parts, F.lit(0)))).otherwise("free")
    return checked.withColumns({
        "plan": plan, "valid": valid, "expires": F.when(valid & ~no_key, expiry_text),
    }).withColumn("features", _features_of("plan"))


def plan_features(spark: SparkSession) -> DataFrame:
    """Dimension (plan, features)."""
    return spark.createDataFrame(list(FEATURES.items()), "plan string, features array<string>")


def _features_of(plan: str) -> Column:
    listed = lambda names: F.array(*map(F.lit, names))
    chosen = listed(BASIC)
    for name, features in FEATURES.items():
        chosen = F.when(F.col(plan) == name, listed(features)).otherwise(chosen)
    return chosen


def check_feature(validated: DataFrame, feature: str) -> DataFrame:
    """Add ``allowed``: whether the licence's plan has the feature."""
    plans = F.broadcast(plan_features(validated.sparkSession).withColumnRenamed("features", "_listed"))
    listed = F.coalesce("_listed", F.array(*map(F.lit, BASIC)))
    return (validated.join(plans, "plan", "left")
            .withColumn("allowed", F.array_contains(listed, feature)).drop("_listed"))


def monthly_quota(usage: DataFrame, user_plans: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Pages per user and month against the plan's limit; users without a plan are ``free``."""
    months = usage.groupBy("user_id", F.date_trunc("month", "ts").alias("month")).agg(
        F.sum("pages").alias("pages"))
    limit = F.create_map(*[F.lit(v) for pair in limits.items() for v in pair])
    plan = F.coalesce("plan", F.lit("free"))
    with_plan = months.join(user_plans.select("user_id", "plan"), "user_id", "left")
    allowed = F.coalesce(F.try_element_at(limit, plan), F.lit(limits["free"]))
    return with_plan.select(
        "user_id", "month", plan.alias("plan"), "pages", allowed.alias("max_pages"),
        (F.col("pages") > allowed).alias("over_quota"),
        F.greatest(allowed - F.col("pages"), F.lit(0)).alias("remaining"))


def rate_limit(events: DataFrame, per_minute: int = RATE_PER_MINUTE) -> DataFrame:
    """Add ``minute`` and ``limited``: whether the event is past the user's limit in its minute.

    Events are ranked within a second and offset by the seconds before it.
    """
    banded = events.withColumns({"minute": F.date_trunc("minute", "ts"),
                                 "_second": F.date_trunc("second", "ts")})
    placed = ranked(banded, ["user_id", "minute"], ["_second"], ["ts", "event_id"], "_rank")
    return placed.withColumn("limited", F.col("_rank") > per_minute).drop("_rank", "_second")


def rate_windows(events: DataFrame, per_minute: int = RATE_PER_MINUTE,
                 slide: str | None = None) -> DataFrame:
    """Users and windows with more than ``per_minute`` events; sliding when ``slide`` is given."""
    window = F.window("ts", "1 minute", slide) if slide else F.window("ts", "1 minute")
    return (events.groupBy("user_id", window.alias("w")).agg(F.count("*").alias("requests"))
            .filter(F.col("requests") > per_minute)
            .select("user_id", F.col("w.start").alias("window_start"),
                    F.col("w.end").alias("window_end"), "requests"))


def usage_sessions(usage: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Bursts of a user's events no further apart than the gap, as ``session_window`` makes them.

    Events of a user in one clock slot as long as the gap always belong together, so they are
    summed first; only slots, whose number the time span bounds, are put in order per user.
    """
    slot = F.floor(F.unix_micros("ts") / (gap_seconds * 1_000_000))
    slots = usage.groupBy("user_id", slot.alias("slot")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.count("*").alias("n"), F.sum("pages").alias("p"))
    along = W.partitionBy("user_id").orderBy("slot")
    gap = F.expr(f"INTERVAL {int(gap_seconds)} SECONDS")
    opens = F.coalesce(F.col("first") > F.lag("last").over(along) + gap, F.lit(True))
    upto = along.rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = slots.withColumn("_opens", opens).withColumn(
        "_session", F.sum(F.col("_opens").cast("int")).over(upto))
    return numbered.groupBy("user_id", "_session").agg(
        F.min("first").alias("session_start"), (F.max("last") + gap).alias("session_end"),
        F.sum("n").alias("events"), F.sum("p").alias("pages")).drop("_session")


def log_records(events: DataFrame) -> DataFrame:
    """One JSON line per event: timestamp, level, logger, function, line, message, exception.

    ``exception`` is a struct column and left out of the line where it is null.
    """
    # fixed values: the fields of a log line, in order
    fields = ["timestamp", "level", "logger", "function", "line", "message", "exception"]
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    row = F.struct(*[stamp.alias(f) if f == "timestamp" else F.col(f) for f in fields])
    return events.select(F.to_json(row, {"ignoreNullFields": "true"}).alias("value"))


def exact_percentiles(events: DataFrame, by: list[str], value: str, shares: dict[str, float],
                      cuts: int = 1024) -> DataFrame:
    """``by`` and one column per entry of ``shares``: the interpolated percentile of ``value``; nulls don't count.

    Approximate quantiles cut each group's values in bands. Exact counts per band tell which bands hold the wanted
    ranks, and only those bands are put in order, so no task sees all values of a group.
    """
    rows = events.filter(F.col(value).isNotNull()).select(
        F.struct(*by).alias("_k"), F.col(value).cast("double").alias("_v"))
    steps = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    groups = rows.groupBy("_k").agg(F.approx_percentile("_v", steps, 10 * cuts).alias("_cuts"), F.count("*").alias("_n"))
    banded = (rows.groupBy("_k", "_v").agg(F.count("*").alias("_c")).join(groups.drop("_n"), "_k")
              .select("_k", "_v", "_c", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_band")))
    before = W.partitionBy("_k").orderBy("_band").rowsBetween(W.unboundedPreceding, -1)
    totals = banded.groupBy("_k", "_band").agg(F.sum("_c").alias("_m")).withColumn(
        "_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    wanted = groups.select("_k", F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), (F.lit(share) * (F.col("_n") - 1)).alias("at"))
        for name, share in shares.items()])).alias("_w")).select(
        "_k", F.col("_w.name").alias("_name"), F.floor("_w.at").alias("_lo"), F.ceil("_w.at").alias("_hi"),
        (F.col("_w.at") - F.floor("_w.at")).alias("_part"))
    places = wanted.join(totals, "_k").filter(
        (F.col("_before") <= F.col("_hi")) & (F.col("_before") + F.col("_m") > F.col("_lo"))).drop("_m")
    upto = W.partitionBy("_k", "_band").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = (banded.join(places.select("_k", "_band").distinct(), ["_k", "_band"], "left_semi")
              .withColumn("_to", F.sum("_c").over(upto)))
    met = places.join(inside, ["_k", "_band"]).withColumns({
        "_to": F.col("_before") + F.col("_to"), "_from": F.col("_before") + F.col("_to") - F.col("_c")})
    at = lambda rank: F.when((F.col("_from") <= F.col(rank)) & (F.col(rank) < F.col("_to")), F.col("_v"))
    found = met.groupBy("_k", "_name", "_part").agg(F.max(at("_lo")).alias("_a"), F.max(at("_hi")).alias("_b"))
    value_ = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")
    return found.groupBy("_k").agg(*[F.max(F.when(F.col("_name") == n, value_)).alias(n) for n in shares]).select(
        *[F.col(f"_k.{c}").alias(c) for c in by], *shares)


#: Percentiles of the service report.
LATENCY_SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def service_metrics(events: DataFrame, by: list[str], exact: bool = False) -> DataFrame:
    """Requests per second over the time seen, latency percentiles and error rate.

    The default percentiles come from a sketch of fixed size; ``exact`` ones from ``exact_percentiles``.
    """
    seconds = (F.max("ts").cast("double") - F.min("ts").cast("double"))
    sketch = [] if exact else [F.approx_percentile("latency", F.lit(s)).alias(n) for n, s in LATENCY_SHARES.items()]
    measures = events.groupBy(*by).agg(
        F.count("*").alias("requests"),
        F.try_divide(F.count("*").cast("double"), seconds).alias("per_second"), *sketch,
        (F.count_if(F.col("is_error")) / F.count("*")).alias("error_rate"))
    if not exact:
        return measures
    found = exact_percentiles(events, by, "latency", LATENCY_SHARES).select(
        F.struct(*by).alias("_k"), *LATENCY_SHARES)
    return measures.withColumn("_k", F.struct(*by)).join(found, "_k", "left").select(
        *by, "requests", "per_second", *LATENCY_SHARES, "error_rate")


#: Items a level of a sketch keeps: at 800 a rank is off by less than half a percent of the rows.
SKETCH_SIZE = 800


def latency_sketches(events: DataFrame, by: list[str], value: str = "latency", ts: str = "ts", k: int = SKETCH_SIZE) -> DataFrame:
    """(``by``, day, n, sketch): one mergeable quantile sketch per group and day, to be stored; nulls don't count.

    A group's rows are sketched where they are read and sketches merged after the shuffle, so a busy group is no large task.
    """
    rows = events.filter(F.col(value).isNotNull())
    return rows.groupBy(*by, F.col(ts).cast("date").alias("day")).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def sketch_percentiles(sketches: DataFrame, by: list[str], shares: dict[str, float], first: str | None = None,
                       last: str | None = None) -> DataFrame:
    """``by``, n and one column per entry of ``shares`` over days ``first`` to ``last``, by merging sketches; no event is read."""
    some = sketches
    if first is not None:
        some = some.filter(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        some = some.filter(F.col("day") <= F.lit(last).cast("date"))
    merged = some.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_s"))
    return merged.select(*by, "n", *[F.kll_sketch_get_quantile_double("_s", F.lit(s)).alias(name) for name, s in shares.items()])


def purge_stored(spark: SparkSession, path: str, ids: DataFrame, key: str = "job_id", partition: str = "day") -> DataFrame:
    """Delete the rows of ``ids`` from the Parquet table at ``path``, partitioned by ``partition``; (key, found) of every id.

    Only partitions that hold such rows are written again; the others keep their files. What is left of them is written to a
    working table first, then put in place partition by partition, and partitions with nothing left are removed last, so the same
    call again finishes what a lost driver left undone.
    """
    table = spark.read.parquet(path)
    ids = cut_lineage(ids.select(key).filter(F.col(key).isNotNull()).distinct())
    found = cut_lineage(table.select(key, partition).join(ids, key, "left_semi").distinct())
    report = cut_lineage(ids.join(found.select(key).distinct().withColumn("found", F.lit(True)), key, "left")
                         .select(key, F.coalesce("found", F.lit(False)).alias("found")))
    touched = cut_lineage(found.select(partition).distinct())
    same = table[partition].eqNullSafe(touched[partition])
    left = cut_lineage(table.join(touched, same, "left_semi").join(ids, key, "left_anti"))
    (left.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))
    keeps = left.select(partition).distinct()
    empty = touched.join(keeps, touched[partition].eqNullSafe(keeps[partition]), "left_anti")
    hadoop = spark._jvm.org.apache.hadoop.fs
    for row in empty.select(F.col(partition).cast("string").alias("p")).toLocalIterator():  # a folder per emptied partition
        name = "__HIVE_DEFAULT_PARTITION__" if row["p"] is None else spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(row["p"])
        folder = hadoop.Path(f"{path}/{partition}={name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return report


def queue_report(usage: DataFrame, user_plans: DataFrame, limits: dict[str, int], as_of: str,
                 recent: int = 10) -> tuple[DataFrame, DataFrame]:
    """(pages today and quota left in the ``as_of`` month per user, the latest documents)."""
    day = F.lit(as_of).cast("date")
    this_month = usage.filter(F.date_trunc("month", "ts") == F.date_trunc("month", day.cast("timestamp")))
    today = usage_stats(usage, as_of, None, per_user=True)
    quota = monthly_quota(this_month, user_plans, limits).select("user_id", "plan", "remaining")
    return today.join(quota, "user_id", "left"), usage_history(usage, recent)
