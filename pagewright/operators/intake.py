"""File intake: format routing, checks, page rows, and the quarantine of rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagewright.config import IMAGE_EXTENSIONS, PDF_EXTENSIONS, SUPPORTED_EXTENSIONS
from pagewright.functions.errors import error_taxonomy
from pagewright.functions.text import base_name, fixed, suffix
from pagewright.operators.lists import by_list

# The limits here and the message texts of the checks below.
MEGABYTE = 1048576
PDF_DPI, IMAGE_DPI = 300, 72
MIN_SIDE = 10


def is_supported_format(path: Column | str) -> Column:
    return suffix(path).isin(*SUPPORTED_EXTENSIONS)


def route_format(path: Column | str) -> Column:
    """``pdf``, ``image`` or ``unsupported``, by file extension in any letter case."""
    ext = suffix(path)
    return (F.when(ext.isin(*PDF_EXTENSIONS), "pdf")
            .when(ext.isin(*IMAGE_EXTENSIONS), "image").otherwise("unsupported"))


def _size_mb() -> Column:
    return F.col("length") / MEGABYTE


def check_size(files: DataFrame, max_mb: int = 100) -> DataFrame:
    """Add ``size_ok`` and, for files over the limit, ``size_message``."""
    over = _size_mb() > max_mb
    message = F.concat(F.lit("File size ("), fixed(_size_mb(), 1), F.lit(f"MB) exceeds limit ({max_mb}MB)"))
    return files.withColumns({"size_ok": ~over, "size_message": F.when(over, message)})


def check_extension(files: DataFrame, enabled: bool = True,
                    allowed: tuple[str, ...] = SUPPORTED_EXTENSIONS) -> DataFrame:
    """Add ``format_ok`` and ``format_message``; everything passes when switched off."""
    bad = ~suffix("path").isin(*allowed) if enabled else F.lit(False)
    message = F.concat(F.lit("Unsupported file format: "), suffix("path"))
    return files.withColumns({"format_ok": ~bad, "format_message": F.when(bad, message)})


def with_extensions(files: DataFrame, allowed: DataFrame, keep: bool = True) -> DataFrame:
    """Files whose extension (with its dot, lower case) is in a table of extensions, or is not."""
    return by_list(files, suffix("path"), allowed, keep)


def from_bytes(contents: DataFrame, file_type: Column, strict: bool = False) -> DataFrame:
    """Name and type for in-memory ``content``; a missing type is an error.

    ``strict`` raises on it; otherwise the row carries ``error``.
    """
    missing = "file_type must be specified for byte sources"
    named = contents.withColumns({
        "file_name": F.concat(F.lit("document."), file_type),
        "file_type": file_type,
        "source_type": F.when(file_type == "pdf", "pdf").when(file_type.isNotNull(), "image"),
        "error": F.when(file_type.isNull(), missing),
    })
    if not strict:
        return named
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.lit(missing))).otherwise(F.col("file_name"))
    return named.withColumn("file_name", checked).drop("error")


def explode_pages(files: DataFrame, pdf_dpi: int = PDF_DPI) -> DataFrame:
    """One row per page: ``pdf_dpi`` for pdf and 72 for images. Files of no pages give none."""
    kind = route_format("path")
    numbered = files.filter((F.col("page_count") > 0) & (kind != "unsupported"))
    return numbered.select(
        "file_id", "path", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page_number"),
        "width", "height",
        F.when(kind == "pdf", pdf_dpi).otherwise(IMAGE_DPI).alias("dpi"), kind.alias("source_type"))


def document_info(pages: DataFrame) -> DataFrame:
    """One row per file: name, type, page count, page sizes in order, and metadata.

    Page sizes are joined per hundred pages first, so a file of very many pages does not
    bring one row per page to a single task.
    """
    size = F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))
    part = F.floor(F.col("page_number") / 100)
    ordered = lambda key, text: F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct(key, F.col(text).alias("v")))), lambda r: r["v"]), ",")
    parts = (pages.withColumns({"_part": part, "_size": size})
             .groupBy("file_id", "path", "_part")
             .agg(F.count("*").alias("_n"), ordered("page_number", "_size").alias("_sizes"),
                  F.min(F.struct("page_number", "_size")).alias("_first")))
    whole = parts.groupBy("file_id", "path").agg(
        F.sum("_n").alias("total_pages"), ordered("_part", "_sizes").alias("page_sizes"),
        F.min("_first").alias("_first"))
    ext = suffix("path")
    metadata = F.map_from_arrays(
        F.array(F.lit("format"), F.lit("size")), F.array(F.upper(ext), F.col("_first._size")))
    return whole.select(
        "file_id", base_name("path").alias("file_name"), ext.alias("file_type"), "total_pages",
        "page_sizes",
        F.when(route_format("path") == "image", metadata)
        .otherwise(F.create_map().cast("map<string,string>")).alias("metadata"))


def document_problems(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Every document with ``reason``, null for the valid, and its first bad page."""
    w, h = F.col("width"), F.col("height")
    empty = w.isNull() | h.isNull() | (w == 0) | (h == 0)
    page = F.concat(F.lit("Page "), F.col("page_number").cast("string"))
    reason = F.when(empty, F.concat(page, F.lit(" has invalid image"))).when(
        (h < MIN_SIDE) | (w < MIN_SIDE),
        F.concat(page, F.lit(" is too small: "), w.cast("string"), F.lit("x"), h.cast("string")))
    checked = pages.withColumn("_reason", reason)
    worst = checked.groupBy("file_id").agg(
        F.count("*").alias("_pages"),
        F.min(F.when(F.col("_reason").isNotNull(), F.col("page_number"))).alias("bad_page"),
        F.min_by("_reason", F.when(F.col("_reason").isNotNull(), F.col("page_number"))).alias("_reason"))
    return (documents.join(worst, "file_id", "left")
            .withColumn("reason", F.when(F.col("_pages").isNull(), "Document has no pages")
                        .otherwise(F.col("_reason")))
            .drop("_pages", "_reason"))


def validate_documents(documents: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid documents, quarantine with ``reason`` and ``bad_page``)."""
    checked = document_problems(documents, pages)
    valid = checked.filter(F.col("reason").isNull()).drop("reason", "bad_page")
    return valid, checked.filter(F.col("reason").isNotNull())


def classify_files(files: DataFrame, max_mb: int = 100, validate_types: bool = True,
                   allowed: tuple[str, ...] = SUPPORTED_EXTENSIONS) -> DataFrame:
    """Add ``error_class`` (null if accepted) and ``error_message``; the first failing check wins.

    Checks run in the order size, format, no pages, page too small, on one pass over the
    manifest, whose width and height hold for each of a file's pages. A manifest without
    page facts gets the first two checks only.
    """
    checked = check_extension(check_size(files, max_mb), validate_types, allowed)
    problem = F.lit(None).cast("string")
    if "page_count" in files.columns:
        w, h = F.col("width"), F.col("height")
        size = F.concat(w.cast("string"), F.lit("x"), h.cast("string"))
        problem = (
            F.when(F.col("page_count").isNull() | (F.col("page_count") < 1), "Document has no pages")
            .when(w.isNull() | h.isNull() | (w == 0) | (h == 0), "Page 1 has invalid image")
            .when((w < MIN_SIDE) | (h < MIN_SIDE), F.concat(F.lit("Page 1 is too small: "), size)))
    return checked.withColumns({
        "error_class": F.when(~F.col("size_ok"), "FileSizeException")
        .when(~F.col("format_ok"), "UnsupportedFormatException")
        .when(problem.isNotNull(), "InvalidDocumentException"),
        "error_message": F.coalesce(F.col("size_message"), F.col("format_message"), problem),
    }).drop("size_ok", "size_message", "format_ok", "format_message")


def intake_report(files: DataFrame, max_mb: int = 100) -> DataFrame:
    """Files and bytes by outcome: accepted, size, format or invalid."""
    names = {"FileSizeException": "size", "UnsupportedFormatException": "format",
             "InvalidDocumentException": "invalid"}
    outcome = F.lit("accepted")
    for error, name in names.items():
        outcome = F.when(F.col("error_class") == error, name).otherwise(outcome)
    return (classify_files(files, max_mb).groupBy(outcome.alias("outcome"))
            .agg(F.count("*").alias("files"), F.sum("length").alias("bytes")))


def failures_by_ancestor(failures: DataFrame) -> DataFrame:
    """Failure rows counted under their class and under each ancestor of it.

    Rows are counted per class before they meet the taxonomy, which is fixed.
    """
    counts = failures.groupBy("error_class").agg(F.count("*").alias("n"))
    pairs = error_taxonomy(failures.sparkSession)
    return (counts.join(F.broadcast(pairs), "error_class")
            .groupBy("ancestor").agg(F.sum("n").alias("failures"), F.min("distance").alias("nearest")))
