"""The library's front door: files in, page results out, in one call.

Vision models are not part of the library. A *reader* turns file bytes into page facts, a
*detector* turns pages into word boxes, and a *recognizer* reads boxes; each is a callable
given by the user.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
import posixpath

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.config import Config
from pagewright.functions.errors import ExportError
from pagewright.functions.geometry import resize_plan
from pagewright.operators import export_shapes as X, intake, layout, metering, reading
from pagewright.operators.decode import Recognizer, apply_recognizer
from pagewright.session import cut_lineage
from pagewright.sources import sinks
from pagewright.sources.files import scan_documents
from pagewright.sources.guarded import DETECT_ERROR, READ_ERROR
from pagewright.streaming.streams import scan_stream

#: Files with (path, length, content) to the same plus page_count, width and height.
Reader = Callable[[DataFrame], DataFrame]
#: Files with (doc_id, page_count, content, ...), one row each, to boxes with doc_id, page_number, x, y, w, h,
#: confidence and, unless a recognizer is given, text and rec_confidence. The detector makes the pages, so that
#: a file's bytes are handed over once and not once a page.
Detector = Callable[[DataFrame], DataFrame]


#: A folder or file, several of them, or a table with ``content``.
Source = str | Iterable[str] | DataFrame


@dataclass(frozen=True)
class Batch:
    """What one run gives: every file with its outcome, page results, and kept boxes."""

    files: DataFrame
    results: DataFrame
    regions: DataFrame

    @property
    def failures(self) -> DataFrame:
        return self.files.filter(F.col("status") == "failed")

    def summary(self) -> DataFrame:
        return reading.document_summary(self.results)

    def outcomes(self) -> DataFrame:
        """Every file with its document's totals; a failed one has status failed, its error, and null totals."""
        return reading.with_failures(self.files.drop("status"), self.summary(), ["doc_id"], "document")


#: The tables of a ``Batch`` in the order they are written.
_BATCH_TABLES = ("regions", "results", "files")


class Engine:
    def __init__(self, spark: SparkSession, detector: Detector, reader: Reader | None = None,
                 recognizer: Callable[[], Recognizer] | None = None, config: Config = Config()):
        self.spark, self.config = spark, config
        self.reader, self.detector, self.recognizer = reader, detector, recognizer

    def sources(self, source: Source) -> DataFrame:
        """Files as (path, length, content): of a folder or file, a list of them, or a table.

        A table of in-memory sources has ``content`` and ``file_type`` (``pdf``, ``png``, ...) and gets
        ``path`` from them unless it has one; its paths must then be distinct to tell documents apart.
        """
        if isinstance(source, str):
            return scan_documents(self.spark, source, content=True, supported_only=False)
        if isinstance(source, DataFrame):
            if "path" not in source.columns:
                named = intake.from_bytes(source, F.col("file_type"), strict=True)
                source = named.withColumn("path", F.col("file_name"))
            return source.withColumn("length", F.octet_length("content").cast("long"))
        paths = list(source)
        if not paths:
            raise ValueError("no sources")
        files = [scan_documents(self.spark, p, content=True, supported_only=False) for p in paths]
        return reduce(DataFrame.unionByName, files)

    def facts(self, files: DataFrame) -> DataFrame:
        """Every file without its bytes, with page_count, width, height and ``error_class`` (null if accepted).

        The reader runs once, over files that pass the cheap checks; what it finds is written to a working table.
        """
        limits = {"max_mb": self.config.document.max_file_size_mb,
                  "validate_types": self.config.security.validate_file_types,
                  "allowed": self.config.security.allowed_extensions}
        checked = intake.classify_files(files, **limits)
        passed = checked.filter(F.col("error_class").isNull()).drop("error_class", "error_message")
        failed = checked.filter(F.col("error_class").isNotNull()).drop("content")
        if self.reader is None:
            if "page_count" not in passed.columns:
                passed = passed.withColumn("page_count", F.lit(None).cast("int"))
            opened = passed.drop("content").withColumns(
                {c: F.lit(None).cast("int") for c in ("width", "height") if c not in passed.columns})
            opened = opened.withColumns({c: F.lit(None).cast("string") for c in ("error_class", "error_message")})
        else:
            opened = intake.classify_files(self.reader(passed).drop("content"), **limits)
            if READ_ERROR in opened.columns:
                broken = F.col(READ_ERROR).isNotNull()
                opened = opened.withColumns({
                    "error_class": F.when(broken, "DocumentLoadException").otherwise(F.col("error_class")),
                    "error_message": F.coalesce(READ_ERROR, "error_message")}).drop(READ_ERROR)
        return cut_lineage(opened.unionByName(failed, allowMissingColumns=True))

    def process_batch(self, source: Source) -> Batch:
        """All files of a folder, list or table. A rejected file keeps its row and gives no pages.

        Files are opened once for their facts and once for their boxes. Both are written to
        working tables, so that no later step or export runs the models again. Without a reader a file has the
        pages its boxes are on, one at least; with one, boxes on pages the file does not have make the file fail.
        A file that a guarded reader or detector (``sources.guarded``) fails on keeps its row like a rejected one; the
        others go on.
        """
        scanned = self.sources(source)
        ok = F.col("error_class").isNull()
        files = self.facts(scanned).withColumn("doc_id", F.col("path")).withColumn(
            "status", F.when(ok, "ok").otherwise("failed"))
        accepted = files.filter(ok)
        known = accepted.select("path", "doc_id", *[c for c in accepted.columns if c not in (
            *scanned.columns, "doc_id", "error_class", "error_message", "status")])
        regions = self.detector(scanned.join(known, "path"))
        told = DETECT_ERROR in regions.columns
        if self.recognizer is not None:
            if told:
                regions = cut_lineage(regions)  # the detector runs once for boxes and errors
                bad = regions.filter(F.col(DETECT_ERROR).isNotNull())
                regions = regions.filter(F.col(DETECT_ERROR).isNull()).drop(DETECT_ERROR)
            regions = apply_recognizer(regions, self.recognizer, self.config.ocr.batch_size)
            if told:
                regions = regions.unionByName(bad, allowMissingColumns=True)
        found = cut_lineage(regions)
        error = F.max(DETECT_ERROR) if told else F.lit(None).cast("string")
        seen = found.groupBy("doc_id").agg(F.max("page_number").alias("_seen"), F.min("page_number").alias("_least"),
                                           error.alias("_error"))
        counted = accepted.join(seen, "doc_id", "left").withColumn(
            "page_count", F.coalesce("page_count", F.greatest("_seen", F.lit(1)), F.lit(1)).cast("int"))
        stray = F.when((F.col("_seen") > F.col("page_count")) | (F.col("_least") < 1), F.concat(
            F.lit("boxes on page "), F.when(F.col("_least") < 1, F.col("_least")).otherwise(F.col("_seen")).cast("string"),
            F.lit(" of "), F.col("page_count").cast("string")))
        judged = counted.select("path", "page_count", F.coalesce("_error", stray).alias("_problem"))
        files = files.drop("page_count").join(judged, "path", "left")
        files = cut_lineage(files.withColumns({
            "status": F.when(F.col("_problem").isNotNull(), "failed").otherwise(F.col("status")),
            "error_class": F.when(F.col("_problem").isNotNull(), "DetectionException").otherwise(F.col("error_class")),
            "error_message": F.coalesce("_problem", "error_message")}).drop("_problem"))
        accepted = files.filter(ok)
        found = found.drop(DETECT_ERROR).join(accepted.select("doc_id"), "doc_id", "left_semi")
        kept = cut_lineage(reading.gate_recognition(found, self.config.ocr.recognition_threshold))
        number = F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page_number")
        results = reading.page_results(accepted.select("doc_id", number), kept)
        if self.reader is not None:  # one point per pixel, for the searchable layer
            sizes = [F.col(side).alias(f"{sheet}_{side}")
                     for sheet in ("image", "sheet") for side in ("width", "height")]
            results = results.join(accepted.select("doc_id", *sizes), "doc_id")
        return Batch(files, results, kept)

    def watch(self, folder: str, out: str, state: str, files_per_batch: int | None = None,
              every: str | None = None) -> StreamingQuery:
        """Process the files of a folder as they come, and write each micro-batch's tables under ``out``; see ``watched``.

        Without ``every`` the stream ends when all there is has been processed; started again with the same ``state`` it goes on with
        files of new names (``scan_stream``). With ``every`` ("1 minute") it runs until it is stopped. A micro-batch that is
        tried again replaces what its first attempt left.
        """
        def write(files: DataFrame, batch_id: int) -> None:
            batch = self.process_batch(files)
            for name in _BATCH_TABLES:  # the files last: a batch counts once they are there
                getattr(batch, name).write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")

        arriving = scan_stream(self.spark, folder, content=True, files_per_batch=files_per_batch)
        trigger = {"processingTime": every} if every else {"availableNow": True}
        return (arriving.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(**trigger).start())

    def watched(self, out: str) -> Batch:
        """What ``watch`` has written so far, as one batch. Of a file that was processed again, such as with a new state, the last
        outcome counts."""
        tables = {name: self.spark.read.parquet(f"{out}/{name}") for name in _BATCH_TABLES}
        last = tables["files"].groupBy("doc_id").agg(F.max("batch_id").alias("batch_id"))
        return Batch(**{name: t.join(last, ["doc_id", "batch_id"], "left_semi").drop("batch_id").select(
            *[c for c in t.columns if c != "batch_id"]) for name, t in tables.items()})

    def process(self, source: Source) -> Batch:
        """One file; its rejection is an error here."""
        batch = self.process_batch(source)
        bad = batch.failures.select("error_class", "error_message").first()
        if bad is not None:
            raise ValueError(f"{bad.error_class}: {bad.error_message}")
        return batch

    def process_bytes(self, content: bytes, file_type: str) -> Batch:
        """One document held in memory."""
        return self.process(self.spark.createDataFrame([(content, file_type)], "content binary, file_type string"))

    def info(self, source: Source) -> DataFrame:
        """Facts per file: name, type, and the error; where a reader tells them also pages, page sizes, metadata, dpi
        and the size its images are reduced to."""
        files = self.facts(self.sources(source)).withColumn("file_id", F.col("path"))
        pages = intake.explode_pages(
            files.filter(F.col("error_class").isNull()), self.config.document.dpi_for_pdf_render)
        facts = intake.document_info(pages).select("file_id", "total_pages", "page_sizes", "metadata")
        dpi = pages.groupBy("file_id").agg(F.max("dpi").alias("dpi"))
        reduced = resize_plan(F.col("width"), F.col("height"), self.config.ocr.max_image_dimension)
        return files.join(facts, "file_id", "left").join(dpi, "file_id", "left").select(
            "path", intake.route_format("path").alias("type"), "length", "total_pages", "page_sizes", "metadata", "dpi",
            reduced.alias("reduced"), "error_class", "error_message")

    def tables(self, batch: Batch) -> DataFrame:
        """Table cells of a batch's pages; none where detection is switched off."""
        found = layout.detect_tables(batch.regions)
        return found if self.config.document.enable_table_detection else found.limit(0)

    def key_values(self, batch: Batch) -> DataFrame:
        """``key: value`` lines of a batch; none where extraction is switched off."""
        lines = reading.line_texts(batch.regions).select(
            "doc_id", "page_number", "line_no", F.col("line_text").alias("text"), F.lit(1.0).alias("confidence"))
        found = layout.extract_key_values(lines)
        return found if self.config.document.enable_kv_extraction else found.limit(0)

    def limited(self, events: DataFrame) -> DataFrame:
        """Requests marked where a user is past the configured limit of the minute."""
        return metering.rate_limit(events, self.config.security.rate_limit_per_minute)

    def output_collisions(self, batch: Batch, fmt: str) -> DataFrame:
        """Names that more than one accepted document of the batch would be written under."""
        named = batch.files.filter(F.col("status") == "ok").select(
            X.output_name("path", F.lit(fmt)).alias("output"))
        return X.output_collisions(named)

    def export_documents(self, batch: Batch, path: str, fmt: str) -> str:
        """One output per document, in the folder ``path``/output=stem.fmt, for txt, json and csv.

        Two documents that would share a name are an error.
        """
        sinks.export_documents(batch.results, batch.regions, self._names(batch, fmt), path, fmt)
        return path

    def export_files(self, batch: Batch, path: str, fmt: str) -> str:
        """Exactly one file ``path``/stem.fmt per accepted document, for txt, json and csv; all or none appear.

        Two documents that would share a name are an error.
        """
        names = self._names(batch, fmt).join(batch.files.filter(F.col("status") == "ok").select("doc_id"), "doc_id")
        return sinks.export_files(batch.results, batch.regions, names, path, fmt)

    def _names(self, batch: Batch, fmt: str) -> DataFrame:
        clash = self.output_collisions(batch, fmt).first()
        if clash is not None:
            raise ExportError(f"{clash.files} files would be written as {clash.output}")
        return batch.files.select("doc_id", X.output_name("path", F.lit(fmt)).alias("output"))

    def export(self, batch: Batch, path: str, fmt: str | None = None) -> str:
        """Write a batch; the format comes from the extension, ``txt`` if that is unknown."""
        if fmt is None:
            ext = posixpath.splitext(path)[1].lstrip(".").lower()
            fmt = ext if ext in sinks.WRITERS else "txt"
        if fmt not in sinks.WRITERS:
            raise ExportError(f"Unsupported export format: {fmt}")
        return sinks.export(batch.results, batch.regions, path, fmt)

    def quick(self, path: str, output: str | None = None, fmt: str = "txt") -> str:
        """Read one file and write it next to the source as ``stem_ocr.fmt``."""
        return self.export(self.process(path), output or default_output(path, fmt), fmt)


def default_output(path: str, fmt: str) -> str:
    return f"{posixpath.splitext(path)[0]}_ocr.{fmt}"
