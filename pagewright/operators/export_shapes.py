"""Export-ready tables: text, JSON, CSV, word-processor and page-layout rows, response shapes.

``results`` are page results (doc_id, page_number, full_text, confidence, num_regions);
``regions`` are the boxes behind them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagewright.config import EXPORT_FORMATS
from pagewright.functions.geometry import corner_points
from pagewright.functions.text import base_name, fixed, stem, suffix
from pagewright.operators.ordering import joined_in_order, ranked
from pagewright.operators.reading import PAGE

#: Input positions per band when a page's boxes are joined or counted.
BAND = 4096
PAGES_PER_BAND = 64
# The headings, labels and field names that the shapes below write.
#: The text page's layout in points.
SHEET_WIDTH, SHEET_HEIGHT = 595, 842
TITLE_Y, TITLE_SIZE, LEFT = 50, 16, 50
FIRST_LINE_Y, LINE_STEP, LINE_SIZE, LAST_Y = 80, 15, 11, 800
LINES_PER_SHEET = (LAST_Y - FIRST_LINE_Y) // LINE_STEP + 1


def _page_band() -> Column:
    return F.floor(F.col("page_number") / PAGES_PER_BAND)


def _with_total(results: DataFrame) -> DataFrame:
    """Add ``_band``, ``total_pages`` and the document's first and last page.

    Pages are counted per band of pages and the totals come back by (document, band), so a document of very many
    pages is never joined in one task.
    """
    banded = results.withColumn("_band", F.coalesce(_page_band(), F.lit(-1)))
    whole = W.partitionBy("doc_id")
    bands = banded.groupBy("doc_id", "_band").agg(
        F.count("*").alias("_n"), F.min("page_number").alias("_lo"), F.max("page_number").alias("_hi")).select(
        "doc_id", "_band", F.sum("_n").over(whole).alias("total_pages"),
        F.min("_lo").over(whole).alias("first_page"), F.max("_hi").over(whole).alias("last_page"))
    return banded.join(bands, ["doc_id", "_band"])


def txt_pages(results: DataFrame) -> DataFrame:
    """The text export page by page: a header if the document has several pages, the text, a gap."""
    header = F.concat(F.lit("--- Page "), F.col("page_number").cast("string"), F.lit(" ---\n"))
    return _with_total(results).select(
        *PAGE, F.concat(F.when(F.col("total_pages") > 1, header).otherwise(""),
                        F.col("full_text"), F.lit("\n\n")).alias("content"))


def export_txt(results: DataFrame) -> DataFrame:
    """The whole text file of each document in one value; ``txt_pages`` is the form for sinks."""
    pages = txt_pages(results).withColumn("_band", _page_band())
    return joined_in_order(pages, ["doc_id"], ["_band"], ["page_number"], "content", "", "content")


def _region_rows(regions: DataFrame, points: bool) -> DataFrame:
    """Each region as JSON, with its band of the page's input order."""
    box = F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height"))
    fields = [F.col("text"), F.col("confidence"), box.alias("bounding_box")]
    if points:
        corners = corner_points(*map(F.col, ("x", "y", "w", "h")))  # field by field: a lambda would be interpreted
        fields.append(F.array(*[F.array(corners[i]["x"], corners[i]["y"]) for i in range(4)]).alias("points"))
    return regions.select(*PAGE, "region_ord", F.floor(F.col("region_ord") / BAND).alias("_band"),
                          F.to_json(F.struct(*fields)).alias("_json"))


def _region_json(regions: DataFrame, points: bool) -> DataFrame:
    """Each page's regions as the inside of a JSON array, in input order."""
    rows = _region_rows(regions, points)
    return joined_in_order(rows, PAGE, ["_band"], ["region_ord"], "_json", ",", "_regions")


def json_pages(results: DataFrame, regions: DataFrame, points: bool = True) -> DataFrame:
    """One JSON object per page with its text, measures and regions."""
    body = F.concat(_page_head(), F.coalesce("_regions", F.lit("")), F.lit("]}"))
    return (results.join(_region_json(regions, points), PAGE, "left")
            .select(*PAGE, body.alias("page_json")))


def _document_json(pages: DataFrame) -> DataFrame:
    banded = pages.withColumn("_band", _page_band())
    joined = joined_in_order(banded, ["doc_id"], ["_band"], ["page_number"], "page_json", ",", "_pages")
    totals = pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"))
    return joined.join(totals, "doc_id")


def export_json(results: DataFrame, regions: DataFrame) -> DataFrame:
    """One JSON document per document id; ``json_pages`` is the form for sinks."""
    return _document_json(json_pages(results, regions)).select(
        "doc_id", F.concat(F.lit('{"total_pages":'), F.col("total_pages").cast("string"),
                           F.lit(',"pages":['), F.col("_pages"), F.lit("]}")).alias("document"))


def _page_head() -> Column:
    """A page's JSON object up to its regions."""
    head = F.to_json(F.struct("page_number", "full_text", "confidence", "num_regions"))
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"text_regions":['))


def _fragments(results: DataFrame, regions: DataFrame, points: bool, opening: Column, closing: Column) -> DataFrame:
    """(doc_id, page_number, part, ord, text) whose texts, in that order, are each document's JSON.

    Part 0 opens a page, and the document on its first page; part 1 are the regions; part 2 closes the page, and the
    document on its last. No page or document is ever put in one value; what says whether a region is its page's
    first comes back by (page, band), as totals do.
    """
    pages = _with_total(results)
    is_first = F.col("page_number") == F.col("first_page")
    heads = pages.select(*PAGE, F.lit(0).alias("part"), F.lit(0).cast("long").alias("ord"),
                         F.concat(F.when(is_first, opening).otherwise(","), _page_head()).alias("text"))
    tails = pages.select(*PAGE, F.lit(2).alias("part"), F.lit(0).cast("long").alias("ord"), F.concat(
        F.lit("]}"), F.when(F.col("page_number") == F.col("last_page"), closing).otherwise("")).alias("text"))
    rows = _region_rows(regions, points)
    firsts = rows.groupBy(*PAGE, "_band").agg(F.min("region_ord").alias("_m")).select(
        *PAGE, "_band", F.min("_m").over(W.partitionBy(*PAGE)).alias("_first"))
    body = rows.join(firsts, PAGE + ["_band"]).select(
        *PAGE, F.lit(1).alias("part"), F.col("region_ord").cast("long").alias("ord"),
        F.concat(F.when(F.col("region_ord") == F.col("_first"), "").otherwise(","), F.col("_json")).alias("text"))
    known = results.select(*PAGE)  # regions of pages that aren't asked for are left out, as in ``json_pages``
    return heads.unionByName(body.join(known, PAGE, "left_semi")).unionByName(tails)


def json_fragments(results: DataFrame, regions: DataFrame, points: bool = True) -> DataFrame:
    """``export_json`` in ordered pieces, for documents and pages that don't fit in one value."""
    opening = F.concat(F.lit('{"total_pages":'), F.col("total_pages").cast("string"), F.lit(',"pages":['))
    return _fragments(results, regions, points, opening, F.lit("]}"))


def api_fragments(results: DataFrame, regions: DataFrame, job_ids: DataFrame, fmt: str = "json") -> DataFrame:
    """``api_response``'s bodies in ordered pieces."""
    job = F.col("job_id").cast("string")
    named = results.join(job_ids, "doc_id")
    head = F.to_json(F.struct(job.alias("job_id"), F.lit("completed").alias("status"), "total_pages"))
    opening = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"pages":['))
    url = F.lit("null") if fmt == "json" else F.concat(
        F.lit('"/download/'), job, F.lit("/"), job, F.lit(f'.{fmt}"'))
    return _fragments(named, regions, False, opening, F.concat(F.lit('],"download_url":'), url, F.lit("}")))


def api_response(results: DataFrame, regions: DataFrame, job_ids: DataFrame, fmt: str = "json") -> DataFrame:
    """The service's answer per document: job, status, pages, and a link unless JSON was asked for.

    ``job_ids`` maps doc_id to job_id.
    """
    docs = _document_json(json_pages(results, regions, points=False)).join(job_ids, "doc_id")
    job = F.col("job_id").cast("string")
    link = F.concat(F.lit("/download/"), job, F.lit("/"), job, F.lit(f".{fmt}"))
    url = F.lit(None).cast("string") if fmt == "json" else link
    head = F.to_json(F.struct(job.alias("job_id"), F.lit("completed").alias("status"), "total_pages"))
    tail = F.coalesce(F.concat(F.lit('"'), url, F.lit('"')), F.lit("null"))
    body = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"pages":['),
                    F.col("_pages"), F.lit('],"download_url":'), tail, F.lit("}"))
    return docs.select("doc_id", "job_id", F.lit("completed").alias("status"), "total_pages",
                       url.alias("download_url"), body.alias("response"))


def export_csv(regions: DataFrame) -> DataFrame:
    """One row per region with its 1-based place on the page."""
    banded = regions.withColumn("_band", F.floor(F.col("region_ord") / BAND))
    placed = ranked(banded, PAGE, ["_band"], ["region_ord"], "_place")
    return placed.select(
        "doc_id", F.col("page_number").alias("Page"), F.col("_place").alias("Region_ID"),
        F.col("text").alias("Text"), fixed(F.col("confidence"), 3).alias("Confidence"),
        F.col("x").alias("X"), F.col("y").alias("Y"), F.col("w").alias("Width"), F.col("h").alias("Height"))


def word_blocks(results: DataFrame) -> DataFrame:
    """The word-processor file as rows (doc_id, page_number, block_no, kind, text); page 0 is the front."""
    block = lambda no, kind, text: F.struct(
        F.lit(no).alias("block_no"), F.lit(kind).alias("kind"), text.alias("text"))
    several = F.col("total_pages") > 1
    measures = F.concat(
        F.lit("Detected Regions: "), F.col("num_regions").cast("string"), F.lit("  |  Confidence: "),
        fixed(F.col("confidence") * 100, 2), F.lit("%"))
    blocks = F.array_compact(F.array(
        F.when(several, block(1, "heading", F.concat(F.lit("Page "), F.col("page_number").cast("string")))),
        F.when(several, block(2, "measures", measures)),
        F.when(F.col("full_text") != "", block(3, "text", F.col("full_text")))
        .otherwise(block(3, "no_text", F.lit("[No text detected]"))),
        F.when(F.col("page_number") < F.col("total_pages"), block(4, "page_break", F.lit(""))),
    ))
    body = _with_total(results).select(*PAGE, F.explode(blocks).alias("b")).select(*PAGE, "b.*")
    totals = results.groupBy("doc_id").agg(F.count("*").alias("n"))
    front = totals.select("doc_id", F.lit(0).alias("page_number"), F.explode(F.array(
        block(1, "title", F.lit("OCR Document")),
        block(2, "paragraph", F.concat(F.lit("Total Pages: "), F.col("n").cast("string"))),
        block(3, "paragraph", F.lit("")))).alias("b")).select(*PAGE, "b.*")
    return front.unionByName(body)


def _titles(pages: DataFrame) -> DataFrame:
    return pages.select(
        *PAGE, F.lit(0).alias("sheet"), F.lit(-1).alias("line_no"),
        F.concat(F.lit("Page "), F.col("page_number").cast("string")).alias("text"),
        F.lit(LEFT).alias("x"), F.lit(TITLE_Y).alias("y"), F.lit(TITLE_SIZE).alias("font_size"),
        F.lit(False).alias("overflow"))


def _placed(lines: DataFrame, legacy: bool) -> DataFrame:
    """Lines (page, line_no from 0, text) at their place on their sheet."""
    sheet = F.floor(F.col("line_no") / LINES_PER_SHEET).cast("int")
    placed = lines.select(
        *PAGE, sheet.alias("sheet"), F.col("line_no").cast("int").alias("line_no"), "text", F.lit(LEFT).alias("x"),
        (FIRST_LINE_Y + LINE_STEP * (F.col("line_no") % LINES_PER_SHEET)).cast("int").alias("y"),
        F.lit(LINE_SIZE).alias("font_size"), (sheet > 0).alias("overflow"))
    return placed.filter(~F.col("overflow")) if legacy else placed


def pdf_text_layout(results: DataFrame, legacy: bool = False) -> DataFrame:
    """Text placed on A4 sheets: a title at the top of each page, then lines downward.

    Lines that do not fit go on to a further sheet and are marked ``overflow``; ``legacy``
    drops them instead. ``pdf_line_layout`` is the form for pages whose text doesn't fit in one value.
    """
    lines = results.select(*PAGE, F.posexplode(F.split("full_text", "\n")).alias("line_no", "text"))
    return _titles(results).unionByName(_placed(lines, legacy))


def pdf_line_layout(pages: DataFrame, lines: DataFrame, legacy: bool = False) -> DataFrame:
    """``pdf_text_layout`` from lines (page, line_no, line_text) as ``reading.line_texts`` gives them; no page text is made.

    A page of ``pages`` without lines has one empty line.
    """
    own = lines.select(*PAGE, "line_no", F.col("line_text").alias("text")).join(pages.select(*PAGE), PAGE, "left_semi")
    blank = pages.select(*PAGE).join(lines.select(*PAGE), PAGE, "left_anti").select(
        *PAGE, F.lit(0).cast(lines.schema["line_no"].dataType).alias("line_no"), F.lit("").alias("text"))
    return _titles(pages).unionByName(_placed(own.unionByName(blank), legacy))


def searchable_layer(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Invisible text boxes scaled from image pixels to the sheet.

    ``pages`` has image_width, image_height, sheet_width, sheet_height per page. Pages
    missing on either side are left out, as are blank words.
    """
    sx, sy = (F.col(f"sheet_{d}").cast("double") / F.col(f"image_{d}") for d in ("width", "height"))
    return (regions.filter(F.col("text") != "").join(pages, PAGE).select(
        *PAGE, "region_ord", "text",
        (F.col("x") * sx).alias("x0"), (F.col("y") * sy).alias("y0"),
        ((F.col("x") + F.col("w")) * sx).alias("x1"), ((F.col("y") + F.col("h")) * sy).alias("y1"),
        (F.col("h") * sy * 0.8).alias("font_size")))


def overlay_labels(regions: DataFrame) -> DataFrame:
    """Label text, its anchor above the box, and the box outline in whole pixels."""
    label = F.concat(F.substring("text", 1, 20), F.lit("... ("),
                     fixed(F.col("confidence"), 2), F.lit(")"))
    corners = corner_points(*map(F.col, ("x", "y", "w", "h")))
    outline = F.transform(corners, lambda p: F.struct(
        p["x"].cast("int").alias("x"), p["y"].cast("int").alias("y")))
    return regions.select(*PAGE, "region_ord", label.alias("label"), F.col("x").alias("anchor_x"),
                          (F.col("y") - 5).alias("anchor_y"), outline.alias("outline"))


def infer_export_format(path: Column | str) -> Column:
    """Struct (format, warned): the format of a file name, ``txt`` with a warning if unknown."""
    ext = F.regexp_replace(suffix(path), r"^\.", "")
    known = ext.isin(*EXPORT_FORMATS)
    return F.struct(F.when(known, ext).otherwise("txt").alias("format"), (~known).alias("warned"))


def output_name(path: Column | str, fmt: Column, mode: str = "batch") -> Column:
    """``stem.fmt`` in a batch, ``stem_ocr.fmt`` next to the source for a single file."""
    col = F.col(path) if isinstance(path, str) else path
    if mode == "batch":
        return F.concat(stem(col), F.lit("."), fmt)
    if mode != "single":
        raise ValueError(f"unknown mode: {mode}")
    folder = F.substring(col, F.lit(1), F.length(col) - F.length(base_name(col)))
    return F.concat(folder, stem(col), F.lit("_ocr."), fmt)


def output_collisions(named: DataFrame, output: str = "output") -> DataFrame:
    """Output names that more than one file would write, with how many."""
    return named.groupBy(output).agg(F.count("*").alias("files")).filter(F.col("files") > 1)


def fan_out_formats(files: DataFrame, formats: tuple[str, ...] = ("txt", "json")) -> DataFrame:
    """Every document once per requested format."""
    return files.withColumn("format", F.explode(F.array(*map(F.lit, formats))))
