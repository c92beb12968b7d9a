"""Structured Streaming forms of intake, usage, limits, jobs, de-duplication and sessions.

The transformations are the batch ones wherever they allow it. ``run_available`` drives a
stream over what is there now and stops; sinks write one folder per micro-batch, replaced
if the batch is retried, so a restart neither loses nor doubles rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagewright.operators import intake, metering
from pagewright.operators.layout import digest
from pagewright.session import scratch_path
from pagewright.sources.files import directly_in, is_plain


def _start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str):
    return (stream.writeStream.foreachBatch(write).outputMode(mode)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def ready_output(spark: SparkSession, name: str, schema) -> str:
    """A fresh sink folder that already holds an empty batch, so that a stream without input is an empty table."""
    out = scratch_path(spark, name)
    spark.createDataFrame([], schema).write.parquet(f"{out}/batch_id=-1")
    return out


def run_available(stream: DataFrame, name: str, mode: str = "append", out: str | None = None,
                  state: str | None = None) -> DataFrame:
    """Run a stream over all input there is and give its output as a table with ``batch_id``.

    With ``out`` and ``state`` of an earlier run it goes on where that run ended.
    """
    spark = stream.sparkSession
    out = out or ready_output(spark, name, stream.schema)
    _start(stream, lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch_id={i}"),
           state or scratch_path(spark, f"{name}-state"), mode).awaitTermination()
    return spark.read.schema(stream.schema.add("batch_id", "long")).parquet(out)


def stream_intake(files: DataFrame, accepted: str, quarantine: str, checkpoint: str,
                  max_mb: int = 100):
    """Check new files with the batch rules into an accepted and a quarantine folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        checked = intake.classify_files(batch, max_mb).persist()
        try:
            good = checked.filter(F.col("error_class").isNull()).drop("error_class", "error_message")
            good.write.mode("overwrite").parquet(f"{accepted}/batch_id={batch_id}")
            (checked.filter(F.col("error_class").isNotNull())
             .write.mode("overwrite").parquet(f"{quarantine}/batch_id={batch_id}"))
        finally:
            checked.unpersist()
    return _start(files, write, checkpoint, "append")


def stream_usage(usage: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Pages per user and day, given out once the day is closed; later events are dropped."""
    return (usage.withWatermark("ts", delay)
            .groupBy(F.window("ts", "1 day").alias("w"), "user_id")
            .agg(F.sum("pages").alias("pages"), F.count("*").alias("events"))
            .select("user_id", F.col("w.start").alias("day"), "pages", "events"))


def stream_rate_limit(events: DataFrame, per_minute: int = metering.RATE_PER_MINUTE,
                      slide: str | None = None, delay: str = "1 minute") -> DataFrame:
    """Users over the limit per closed minute, tumbling or sliding."""
    return metering.rate_windows(events.withWatermark("ts", delay), per_minute, slide)


def stream_dedupe(documents: DataFrame, content: str, delay: str, key: str = "doc_id") -> DataFrame:
    """The first document of each digest within the watermark: (digest, key, ts), ``ts`` being the event time.

    Contents are hashed where they are read; only digests are shuffled and kept, and a digest leaves
    the state when event time has passed it by ``delay``.
    """
    return (documents.select(digest(content).alias("digest"), key, "ts").withWatermark("ts", delay)
            .dropDuplicatesWithinWatermark(["digest"]))


def heartbeats(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of rows that only tell the time, with null in all columns but ``ts``; see ``land_heartbeat``.

    A source that falls silent keeps its last windows open for ever. United with such a stream it needs no event to close them.
    """
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def land_heartbeat(spark: SparkSession, path: str, schema, ts) -> None:
    """Tell the streams that read ``path`` that event time has reached ``ts``."""
    row = tuple(ts if f.name == "ts" else None for f in schema)
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)


def stream_sessions(usage: DataFrame, gap_seconds: int = 1800, delay: str = "1 hour") -> DataFrame:
    """Closed bursts of a user's events. Rows without a user only move the time (see ``heartbeats``)."""
    return (usage.withWatermark("ts", delay)
            .groupBy("user_id", F.session_window("ts", f"{gap_seconds} seconds").alias("s"))
            .agg(F.count("user_id").alias("events"), F.sum("pages").alias("pages"))
            .filter("events > 0")  # a filter on the user would move below the watermark
            .select("user_id", F.col("s.start").alias("session_start"),
                    F.col("s.end").alias("session_end"), "events", "pages"))


def latest_updates(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last row given out per key by a stream run in update mode: closed and still open groups alike."""
    values = [c for c in updates.columns if c not in (*keys, "batch_id")]
    return (updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_u"))
            .select(*keys, *[F.col(f"_u.{c}").alias(c) for c in values]))


JOB_UPDATE = "job_id long, status string, progress double, done long, failed long, error string"
_ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobProgress(StatefulProcessor):
    """The state of a job: its counts, its files' outcomes, and a timer for the time it will have been idle too long.

    Up to ``FEW`` files are kept with the counts, so that an ordinary job is read and written by one call each; every call goes from the
    Python worker to the state store and back. A larger job has a map entry per file, and a batch reads and writes the entries of
    the files it holds only, whatever the size of the job.
    """

    #: Files of a job that are kept in one value, and rows taken together from a batch.
    FEW, ROWS = 32, 10_000

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "file_id long", "status string")
        self.job = handle.getValueState("job", "total long, done long, failed long, last_ms long, timer_ms long, mapped boolean, "
                                               "completed_files array<long>, failed_files array<long>")

    @staticmethod
    def _outcomes(rows: Iterable[Row]) -> dict[int, str]:
        """Outcome per file of some rows; completed wins over failed."""
        out = {}
        for r in rows:
            if r.file_status != "processing" and r.file_id is not None and out.get(r.file_id) != "completed":
                out[r.file_id] = "failed" if r.file_status == "failed" else "completed"
        return out

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.job.get()  # a job without state has no files and no timer either, which saves asking for them
        total, done, failed, last_ms, timer, mapped, good, bad = known or (0, 0, 0, 0, None, False, [], [])
        few = dict.fromkeys(good, "completed") | dict.fromkeys(bad, "failed")
        seen = set()
        while some := list(islice(rows, self.ROWS)):
            total = max(total, max((r.total for r in some if r.total is not None), default=0))
            last_ms = max(last_ms, max((r.ms for r in some if r.ms is not None), default=0))
            for file, status in self._outcomes(some).items():
                if not mapped:
                    before = few.get(file)
                else:
                    entry = self.files.getValue((file,)) if known or file in seen else None
                    before = entry and entry[0]
                    seen.add(file)
                if before is not None and before in (status, "completed"):
                    continue
                done += before is None
                failed += (status == "failed") - (before is not None)
                if mapped:
                    self.files.updateValue((file,), (status,))
                    continue
                few[file] = status
                if len(few) > self.FEW:  # from now on an entry each
                    for f, outcome in few.items():
                        self.files.updateValue((f,), (outcome,))
                    seen.update(few)
                    mapped, few = True, {}
        due = max(last_ms + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1)
        self.job.update((total, done, failed, last_ms, due, mapped, [f for f, s in few.items() if s == "completed"],
                         [f for f, s in few.items() if s == "failed"]))
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        yield self._row(key, "completed" if done >= total else "processing", total, done, failed,
                        f"{failed} file(s) failed" if failed else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        total, done, failed, _, _, mapped, *_ = self.job.get()
        if mapped:
            self.files.clear()
        self.job.clear()
        if done < total:
            yield self._row(key, "failed", total, done, failed, "idle")

    @staticmethod
    def _row(key, status: str, total: int, done: int, failed: int, error: str | None) -> Row:
        return Row(job_id=key[0], status=status, progress=done * 100.0 / total if total else None, done=done, failed=failed, error=error)

    def close(self) -> None:
        pass


def stream_jobs(job_files: DataFrame, idle_seconds: int = 3600, delay: str = "10 minutes") -> DataFrame:
    """Progress of each job whenever its files change: processing, completed or failed.

    Input rows are file outcomes (job_id, file_id, total, file_status, ts). Each file counts once, by its last
    outcome; a completed file stays completed. A finished job is remembered, so that repeated or late rows don't
    start it anew, until event time has passed its last file by ``idle_seconds``; a job that is still processing
    then fails as idle. State lives in RocksDB, see ``JobProgress``; the session's state store provider is set to it, which
    keyed state with maps and timers needs.
    """
    job_files.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS_DB)
    rows = (job_files.select("job_id", F.col("file_id").cast("long").alias("file_id"), F.col("total").cast("long").alias("total"),
                             "file_status", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).withWatermark("ts", delay))
    return rows.groupBy("job_id").transformWithState(
        JobProgress(idle_seconds * 1000), JOB_UPDATE, "Update", "EventTime")


def scan_stream(spark: SparkSession, path: str, content: bool = False, files_per_batch: int | None = None,
                max_age: str = "36500d") -> DataFrame:
    """New files directly in a folder, or of a pattern, as (path, length[, modified, content]); bytes are read only when ``content`` is asked for.

    A path comes once, also when its file changes, and whatever its time: paths are remembered for as long as ``max_age`` before the
    newest file's time, so move files out of the folder before lowering it. ``files_per_batch`` bounds a micro-batch (none: all there is).
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("maxFileAge", max_age).option(
        "recursiveFileLookup", str(is_plain(path)).lower())
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    more = [F.col("modificationTime").alias("modified"), "content"] if content else []
    files = reader.load(path)
    return (files.filter(directly_in(path)) if is_plain(path) else files).select("path", "length", *more)
