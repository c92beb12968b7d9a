"""Writers for export shapes. Output is a folder of part files, in document and page order.

Rows are range-partitioned by their order, not hashed by document, so one huge document
is written by several tasks; part files in name order give the right order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from pagewright.config import EXPORT_FORMATS
from pagewright.functions.errors import ExportError
from pagewright.operators import export_shapes as X
from pagewright.operators.reading import PAGE, line_texts
from pagewright.sources.document_files import write_document_files

Writer = Callable[[DataFrame, DataFrame, str], None]


def _ordered(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _txt_lines(results: DataFrame) -> DataFrame:
    """(doc_id, page_number, value): pages as text rows; the sink ends each with a page's last newline."""
    return X.txt_pages(results).select(
        *PAGE, F.expr("substring(content, 1, length(content) - 1)").alias("value"))


def write_txt(results: DataFrame, regions: DataFrame, path: str, per_document: bool = False) -> None:
    """Text files; ``per_document`` makes one folder per document id.

    In files that hold several documents each document's text comes after a line with its id.
    """
    pages = _txt_lines(results)
    if per_document:
        _ordered(pages, *PAGE).select("doc_id", "value").write.mode("overwrite").partitionBy("doc_id").text(path)
        return
    first = pages.groupBy("doc_id").agg(F.min("page_number").alias("page_number"))
    several = F.broadcast(first.agg((F.count("*") > 1).alias("_several")))  # one row
    names = first.crossJoin(several).filter("_several").select(
        *PAGE, F.concat(F.lit("=== "), F.col("doc_id").cast("string"), F.lit(" ===")).alias("value"), F.lit(0).alias("_o"))
    rows = names.unionByName(pages.withColumn("_o", F.lit(1)))
    _ordered(rows, *PAGE, "_o").select("value").write.mode("overwrite").text(path)


def _document_rows(results: DataFrame, regions: DataFrame, names: DataFrame, fmt: str) -> tuple[DataFrame, list[str]]:
    """(doc_id, output, value or CSV columns, ...) of every document in pieces, and the order of a document's pieces."""
    if fmt == "txt":
        rows, order = _txt_lines(results), PAGE
    elif fmt == "json":
        rows = X.json_fragments(results, regions).withColumnRenamed("text", "value")
        order = [*PAGE, "part", "ord"]
    elif fmt == "csv":
        rows, order = X.export_csv(regions).withColumns(
            {"page_number": F.col("Page"), "_id": F.col("Region_ID")}), ["doc_id", "page_number", "_id"]
    else:
        raise ExportError(f"no output per document in format: {fmt}")
    return rows.join(names, "doc_id"), order


def export_documents(results: DataFrame, regions: DataFrame, names: DataFrame, path: str, fmt: str) -> None:
    """One folder per document, named by ``names`` (doc_id, output): text, JSON or CSV rows in order.

    Documents are written in pieces, so a huge one is the work of several tasks; its part files in name order are
    its text. ``export_files`` writes one file per document instead.
    """
    rows, order = _document_rows(results, regions, names, fmt)
    named = _ordered(rows, "output", *order)
    if fmt == "csv":
        (named.drop("doc_id", "page_number", "_id").write.mode("overwrite").option("header", True)
         .partitionBy("output").csv(path))
    else:
        named.select("output", "value").write.mode("overwrite").partitionBy("output").text(path)


def export_files(results: DataFrame, regions: DataFrame, names: DataFrame, path: str, fmt: str) -> str:
    """Exactly one file per document in the folder ``path``, called as ``names`` (doc_id, output) says; all or none appear.

    Text, JSON and CSV with a header; every named document gets its file, also one without pages or boxes. A document is written by
    one task as a stream, so its size is bounded by nothing but the file system.
    """
    rows, order = _document_rows(results, regions, names, fmt)
    if fmt == "csv":
        columns = [c for c in X.export_csv(regions).columns if c != "doc_id"]
        rows = rows.select("output", *order, F.to_csv(F.struct(*columns)).alias("value"))
        first = F.lit(",".join(columns))
    else:
        rows, first = rows.select("output", *order, "value"), F.lit(None).cast("string")
    rest = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order if c != "doc_id"]
    heads = names.select("output", F.lit(0).alias("_body"), "doc_id", *rest, first.alias("value"))
    lines = heads.unionByName(rows.withColumn("_body", F.lit(1)))
    # lines stay with their document, but for names that several documents share
    shared = names.groupBy("output").agg((F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("n"))
    key = ("output",) if not shared.filter("n > 1").isEmpty() else ("doc_id", "output")
    return write_document_files(lines, path, ["_body", *[F.asc_nulls_first(c) for c in order]], key=key)


def write_overlay(results: DataFrame, regions: DataFrame, path: str) -> None:
    """Labels and outlines to be drawn over the page images, as ordered rows."""
    _ordered(X.overlay_labels(regions), *PAGE, "region_ord").write.mode("overwrite").parquet(path)


def write_json(results: DataFrame, regions: DataFrame, path: str) -> None:
    """One line of JSON per page, with its document id."""
    pages = _ordered(X.json_pages(results, regions), "doc_id", "page_number")
    document = F.to_json(F.struct(F.col("doc_id").cast("string").alias("document")))
    line = F.concat(F.expr("substring(_doc, 1, length(_doc) - 1)"), F.lit(',"page":'),
                    F.col("page_json"), F.lit("}"))
    pages.withColumn("_doc", document).select(line.alias("value")).write.mode("overwrite").text(path)


def write_csv(results: DataFrame, regions: DataFrame, path: str) -> None:
    rows = _ordered(X.export_csv(regions), "doc_id", "Page", "Region_ID")
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_docx(results: DataFrame, regions: DataFrame, path: str) -> None:
    """The word-processor file's content as ordered rows."""
    _ordered(X.word_blocks(results), "doc_id", "page_number", "block_no").write.mode("overwrite").parquet(path)


def write_pdf(results: DataFrame, regions: DataFrame, path: str) -> None:
    """Placed text lines of the page layout."""
    rows = _ordered(X.pdf_line_layout(results, line_texts(regions)), "doc_id", "page_number", "sheet", "line_no")
    rows.write.mode("overwrite").parquet(path)


def write_searchable_pdf(results: DataFrame, regions: DataFrame, path: str) -> None:
    """Scaled invisible text; ``results`` must carry the page's image and sheet sizes."""
    sizes = ["image_width", "image_height", "sheet_width", "sheet_height"]
    missing = [c for c in sizes if c not in results.columns]
    if missing:
        raise ExportError(f"page sizes are needed for searchable output: {', '.join(missing)}")
    layer = X.searchable_layer(results.select("doc_id", "page_number", *sizes), regions)
    _ordered(layer, "doc_id", "page_number", "region_ord").write.mode("overwrite").parquet(path)


WRITERS: dict[str, Writer] = {
    "txt": write_txt, "json": write_json, "csv": write_csv, "docx": write_docx,
    "pdf": write_pdf, "searchable_pdf": write_searchable_pdf,
}
assert set(WRITERS) == set(EXPORT_FORMATS)


def register_writer(fmt: str, writer: Writer) -> None:
    """Add or replace the writer of a format."""
    WRITERS[fmt] = writer


def export(results: DataFrame, regions: DataFrame, path: str, fmt: str) -> str:
    """Write page results and their boxes in one of the registered formats."""
    if fmt not in WRITERS:
        raise ExportError(f"Unsupported export format: {fmt}")
    WRITERS[fmt](results, regions, path)
    return path
