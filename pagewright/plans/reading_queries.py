"""Queries on reading order and roll-ups (E) and export shapes (F)."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from pagewright.operators import export_shapes as X, reading as R
from pagewright.plans import fixtures as fx
from pagewright.plans.fixtures import with_views
from pagewright.plans.registry import query
from pagewright.session import scratch_path
from pagewright.sources import sinks
from pagewright.sources.document_files import read_document_files, write_document_files

r9 = lambda c: F.round(c, 9)


def kept(spark, sf):
    return R.gate_recognition(fx.regions_fx(spark, sf))


def results(spark, sf, legacy_first_box=False):
    return R.page_results(fx.page_base_fx(spark, sf), kept(spark, sf), legacy_first_box)


def measures(spark, sf):
    return R.page_measures(fx.page_base_fx(spark, sf), kept(spark, sf))


def _steady(df):
    """Confidence to nine digits, so that text made from it does not turn on summation order."""
    return df.withColumn("confidence", r9("confidence"))


@query("e1_reading_order", with_views("""
  SELECT doc_id, page_number, region_ord,
         row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y, x, region_ord) AS reading_pos
  FROM kept_fx""", "kept_fx"))
def _(spark, sf):
    return R.reading_order(kept(spark, sf)).select(*R.PAGE, "region_ord", "reading_pos")


# The oracle needs no fold: in this view's geometry lines are the source text's lines.
@query("e2_assign_lines", with_views("""
  SELECT doc_id, page_number, region_ord,
         dense_rank() OVER (PARTITION BY doc_id, page_number ORDER BY line_no) - 1 AS line_no
  FROM kept_fx""", "kept_fx"))
def _(spark, sf):
    return R.assign_lines(kept(spark, sf)).select(*R.PAGE, "region_ord", "line_no")


@query("e3_assemble_text", with_views("""
  SELECT doc_id, page_number, string_agg(line_text, chr(10) ORDER BY line_no) AS full_text
  FROM line_text_fx GROUP BY ALL""", "line_text_fx"))
def _(spark, sf):
    return R.assemble_text(kept(spark, sf))


@query("e3_line_texts", with_views("""
  SELECT doc_id, page_number, line_text,
         dense_rank() OVER (PARTITION BY doc_id, page_number ORDER BY line_no) - 1 AS line_no
  FROM line_text_fx""", "line_text_fx"))
def _(spark, sf):
    return R.line_texts(kept(spark, sf)).select(*R.PAGE, "line_no", "line_text")


@query("e3_assemble_text_legacy", with_views("""
  SELECT doc_id, page_number, string_agg(line_text, chr(10) ORDER BY line_no) AS full_text
  FROM (SELECT doc_id, page_number, line_no, string_agg(text, ' ' ORDER BY y, x, region_ord) AS line_text
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y, x, region_ord) AS rn
              FROM kept_fx) WHERE rn > 1 GROUP BY ALL)
  GROUP BY ALL""", "kept_fx"))
def _(spark, sf):
    return R.assemble_text(kept(spark, sf), legacy_first_box=True)


@query("e4_page_confidence", with_views("""
  SELECT doc_id, page_number, round(avg(confidence), 9) AS confidence FROM kept_fx GROUP BY ALL""", "kept_fx"))
def _(spark, sf):
    return R.page_confidence(kept(spark, sf)).select(*R.PAGE, r9("confidence").alias("confidence"))


@query("e5_page_results", with_views("""
  SELECT doc_id, page_number, full_text, round(confidence, 9) AS confidence, num_regions
  FROM page_results_fx""", "page_results_fx"))
def _(spark, sf):
    return _steady(results(spark, sf))


_SUMMARY = """count(*) AS total_pages, CAST(sum(num_regions) AS BIGINT) AS total_regions,
  round(avg(confidence), 9) AS avg_confidence"""


@query("e6_document_summary", with_views(
    f"SELECT doc_id, {_SUMMARY} FROM page_results_fx GROUP BY doc_id", "page_results_fx"))
def _(spark, sf):
    return R.document_summary(measures(spark, sf)).withColumn("avg_confidence", r9("avg_confidence"))


@query("e8_summary_cube", with_views(f"""
  SELECT lang, source, CAST(grouping(lang, source) AS BIGINT) AS level, {_SUMMARY}
  FROM page_results_fx JOIN documents USING (doc_id) GROUP BY CUBE (lang, source)""", "page_results_fx"))
def _(spark, sf):
    cube = R.summary_cube(measures(spark, sf), fx.table(spark, sf, "documents"))
    return cube.withColumn("avg_confidence", r9("avg_confidence"))


_TXT = """
  SELECT doc_id, page_number,
         CASE WHEN n > 1 THEN '--- Page ' || page_number || ' ---' || chr(10) ELSE '' END
           || full_text || chr(10) || chr(10) AS content
  FROM page_results_fx JOIN (SELECT doc_id, count(*) AS n FROM page_base_fx GROUP BY 1) USING (doc_id)"""


@query("f1_txt_pages", with_views(_TXT, "page_results_fx"))
def _(spark, sf):
    return X.txt_pages(results(spark, sf))


@query("f1_export_txt", with_views(f"""
  SELECT doc_id, string_agg(content, '' ORDER BY page_number) AS content FROM ({_TXT}) GROUP BY 1""",
    "page_results_fx"))
def _(spark, sf):
    return X.export_txt(results(spark, sf))


_BOX = T.StructType([T.StructField(n, T.IntegerType()) for n in ("x", "y", "width", "height")])
_PAGE_JSON = T.StructType([
    T.StructField("page_number", T.IntegerType()), T.StructField("full_text", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("num_regions", T.LongType()),
    T.StructField("text_regions", T.ArrayType(T.StructType([
        T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()),
        T.StructField("bounding_box", _BOX),
        T.StructField("points", T.ArrayType(T.ArrayType(T.DoubleType())))])))])


def _flat_regions(pages, **extra):
    """Parsed page objects, one row per region, every field; page texts and corners as digest and list."""
    named = [c.alias(n) for n, c in extra.items()]
    page = pages.select("doc_id", *named, "p.page_number", F.md5("p.full_text").alias("text_md5"),
                        r9("p.confidence").alias("page_confidence"), "p.num_regions", F.col("p.text_regions").alias("regions"))
    head = ["doc_id", *extra, "page_number", "text_md5", "page_confidence", "num_regions"]
    corners = F.array_join(F.flatten("r.points").cast("array<long>").cast("array<string>"), ",")
    return page.select(*head, F.posexplode_outer("regions").alias("place", "r")).select(
        *head, F.col("place").cast("bigint").alias("place"), "r.text", "r.confidence", "r.bounding_box.*",
        corners.alias("corners"))


_FLAT = """
  SELECT p.doc_id, p.page_number, p.text_md5, p.page_confidence, p.num_regions,
         row_number() OVER (PARTITION BY p.doc_id, p.page_number ORDER BY k.region_ord) - 1 AS place,
         k.text, k.confidence, k.x, k.y, k.w AS width, k.h AS height,
         CASE WHEN k.x IS NOT NULL THEN concat_ws(',', x, y, x + w, y, x + w, y + h, x, y + h) END AS corners
  FROM (SELECT doc_id, page_number, md5(full_text) AS text_md5, round(confidence, 9) AS page_confidence, num_regions
        FROM page_results_fx) p LEFT JOIN kept_fx k USING (doc_id, page_number)"""
_FLAT = f"SELECT * EXCLUDE (place), CASE WHEN text IS NOT NULL THEN place END AS place FROM ({_FLAT})"

_TOTALS = "(SELECT doc_id, count(*) AS total_pages FROM page_base_fx GROUP BY 1) USING (doc_id)"


@query("f2_export_json", with_views(f"SELECT * FROM ({_FLAT}) JOIN {_TOTALS}", "page_results_fx"))
def _(spark, sf):
    doc = T.StructType([T.StructField("total_pages", T.LongType()),
                        T.StructField("pages", T.ArrayType(_PAGE_JSON))])
    parsed = X.export_json(results(spark, sf), kept(spark, sf)).select(
        "doc_id", F.from_json("document", doc).alias("d"))
    pages = parsed.select("doc_id", "d.total_pages", F.explode("d.pages").alias("p"))
    return _flat_regions(pages, total_pages=F.col("total_pages"))


@query("f2_json_pages", with_views(f"SELECT * FROM ({_FLAT})", "page_results_fx"))
def _(spark, sf):
    pages = X.json_pages(results(spark, sf), kept(spark, sf))
    return _flat_regions(pages.select("doc_id", F.from_json("page_json", _PAGE_JSON).alias("p")))


@query("f3_export_csv", with_views("""
  SELECT doc_id, page_number AS "Page",
         row_number() OVER (PARTITION BY doc_id, page_number ORDER BY region_ord) AS "Region_ID",
         text AS "Text", printf('%.3f', confidence) AS "Confidence", x AS "X", y AS "Y",
         w AS "Width", h AS "Height" FROM kept_fx""", "kept_fx"))
def _(spark, sf):
    return X.export_csv(kept(spark, sf))


@query("f4_word_blocks", with_views("""
  , r AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, round(confidence, 9) * 100 AS pct FROM page_results_fx)
  SELECT doc_id, 0 AS page_number, 1 AS block_no, 'title' AS kind, 'OCR Document' AS text
    FROM (SELECT DISTINCT doc_id FROM r)
  UNION ALL SELECT doc_id, 0, 2, 'paragraph', 'Total Pages: ' || count(*) FROM r GROUP BY doc_id
  UNION ALL SELECT DISTINCT doc_id, 0, 3, 'paragraph', '' FROM r
  UNION ALL SELECT doc_id, page_number, 1, 'heading', 'Page ' || page_number FROM r WHERE n > 1
  UNION ALL SELECT doc_id, page_number, 2, 'measures', 'Detected Regions: ' || num_regions || '  |  Confidence: '
    || printf('%.2f', round_even(pct * 100, 0) / 100) || '%' FROM r WHERE n > 1
  UNION ALL SELECT doc_id, page_number, 3, CASE WHEN full_text <> '' THEN 'text' ELSE 'no_text' END,
    CASE WHEN full_text <> '' THEN full_text ELSE '[No text detected]' END FROM r
  UNION ALL SELECT doc_id, page_number, 4, 'page_break', '' FROM r WHERE page_number < n""", "page_results_fx"))
def _(spark, sf):
    return X.word_blocks(_steady(results(spark, sf)))


_LAID = """
  SELECT doc_id, page_number, CAST(k // 49 AS INTEGER) AS sheet, CAST(k AS INTEGER) AS line_no, text,
         50 AS x, CAST(80 + 15 * (k % 49) AS INTEGER) AS y, 11 AS font_size, k >= 49 AS overflow
  FROM (SELECT doc_id, page_number, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS k
        FROM (SELECT *, string_split(full_text, chr(10)) AS l FROM page_results_fx))
  UNION ALL SELECT doc_id, page_number, 0, -1, 'Page ' || page_number, 50, 50, 16, false FROM page_results_fx"""


@query("f5_pdf_text_layout", with_views(f"SELECT * FROM ({_LAID})", "page_results_fx"))
def _(spark, sf):
    return X.pdf_text_layout(results(spark, sf))


@query("f5_pdf_line_layout", with_views(f"SELECT * FROM ({_LAID})", "page_results_fx"))
def _(spark, sf):
    return X.pdf_line_layout(fx.page_base_fx(spark, sf), R.line_texts(kept(spark, sf)))


def _sheets(spark, sf):
    d = F.col("doc_id")
    return fx.page_base_fx(spark, sf).select(
        *R.PAGE, (1000 + d % 7 * 100).alias("image_width"), (1500 + d % 3 * 100).alias("image_height"),
        F.lit(X.SHEET_WIDTH).alias("sheet_width"), F.lit(X.SHEET_HEIGHT).alias("sheet_height"))


@query("f6_searchable_layer", with_views("""
  SELECT doc_id, page_number, region_ord, text, round(x * sx, 6) AS x0, round(y * sy, 6) AS y0,
         round((x + w) * sx, 6) AS x1, round((y + h) * sy, 6) AS y1, round(h * sy * 0.8::DOUBLE, 6) AS font_size
  FROM (SELECT *, 595.0::DOUBLE / (1000 + doc_id % 7 * 100) AS sx,
                  842.0::DOUBLE / (1500 + doc_id % 3 * 100) AS sy FROM kept_fx)""", "kept_fx"))
def _(spark, sf):
    layer = X.searchable_layer(_sheets(spark, sf), kept(spark, sf))
    return layer.select(*R.PAGE, "region_ord", "text",
                        *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1", "font_size")])


@query("f7_overlay_labels", with_views("""
  SELECT doc_id, page_number, region_ord,
         substr(text, 1, 20) || '... (' || printf('%.2f', confidence) || ')' AS label,
         x AS anchor_x, y - 5 AS anchor_y, x + w AS right_x, y + h AS bottom_y FROM kept_fx""", "kept_fx"))
def _(spark, sf):
    corner = F.element_at("outline", 3)
    return X.overlay_labels(kept(spark, sf)).select(
        *R.PAGE, "region_ord", "label", "anchor_x", "anchor_y",
        corner["x"].alias("right_x"), corner["y"].alias("bottom_y"))


@query("f8_infer_export_format", with_views("""
  SELECT file_id, CASE WHEN substr(ext, 2) IN ('txt','json','csv','docx','pdf','searchable_pdf')
                       THEN substr(ext, 2) ELSE 'txt' END AS format,
         substr(ext, 2) NOT IN ('txt','json','csv','docx','pdf','searchable_pdf') AS warned
  FROM files_fx""", "files_fx"))
def _(spark, sf):
    return fx.files_fx(spark, sf).select("file_id", X.infer_export_format("path").alias("f")).select(
        "file_id", "f.format", "f.warned")


@query("f9_output_names", with_views("""
  SELECT file_id, '/in/f' || file_id // 2 || '_ocr.txt' AS single, 'f' || file_id // 2 || '.txt' AS batch,
         count(*) OVER (PARTITION BY file_id // 2) > 1 AS collides FROM files_fx""", "files_fx"))
def _(spark, sf):
    named = fx.files_fx(spark, sf).select(
        "file_id", X.output_name("path", F.lit("txt"), "single").alias("single"),
        X.output_name("path", F.lit("txt"), "batch").alias("batch"))
    clashes = X.output_collisions(named, "batch")
    return named.join(clashes, "batch", "left").select(
        "file_id", "single", "batch", F.col("files").isNotNull().alias("collides"))


@query("f10_fan_out_formats", with_views("""
  SELECT file_id, format, 'f' || file_id // 2 || '.' || format AS output
  FROM files_fx, (VALUES ('txt'), ('json'), ('csv')) f(format)""", "files_fx"))
def _(spark, sf):
    fanned = X.fan_out_formats(fx.files_fx(spark, sf), ("txt", "json", "csv"))
    return fanned.select("file_id", "format", X.output_name("path", F.col("format")).alias("output"))


_API_SQL = f"""
  SELECT * EXCLUDE (corners), CAST(NULL AS VARCHAR) AS corners, 'job-' || doc_id AS job_id, 'completed' AS status,
         '/download/job-' || doc_id || '/job-' || doc_id || '.txt' AS download_url
  FROM ({_FLAT}) JOIN {_TOTALS}"""
_ANSWER = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("status", T.StringType()),
                        T.StructField("total_pages", T.LongType()),
                        T.StructField("pages", T.ArrayType(_PAGE_JSON)),
                        T.StructField("download_url", T.StringType())])


def _jobs(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("job-"), F.col("doc_id").cast("string")).alias("job_id"))


def _flat_answers(parsed):
    pages = parsed.select("doc_id", "a", F.explode("a.pages").alias("p"))
    return _flat_regions(pages, **{n: F.col(f"a.{n}") for n in ("job_id", "status", "total_pages", "download_url")})


@query("f11_api_response", with_views(_API_SQL, "page_results_fx"))
def _(spark, sf):
    return _flat_answers(X.api_response(results(spark, sf), kept(spark, sf), _jobs(spark, sf), "txt").select(
        "doc_id", F.from_json("response", _ANSWER).alias("a")))


@query("f12_export", with_views(f"""
  SELECT line, count(*) AS n FROM (
    SELECT unnest(string_split(substr(content, 1, length(content) - 1), chr(10))) AS line FROM ({_TXT})
    UNION ALL SELECT '=== ' || doc_id || ' ===' FROM (SELECT DISTINCT doc_id FROM page_results_fx))
  GROUP BY line""", "page_results_fx"))
def _(spark, sf):
    """The text export written by the format dispatcher and read back, line by line."""
    path = sinks.export(results(spark, sf), kept(spark, sf), scratch_path(spark, "export"), "txt")
    return spark.read.option("lineSep", "\n").text(path).groupBy(F.col("value").alias("line")).agg(
        F.count("*").alias("n"))


@query("f12_document_files", with_views(f"""
  SELECT 'doc' || doc_id || '.txt' AS file, string_agg(content, '' ORDER BY page_number) AS content
  FROM ({_TXT}) GROUP BY doc_id""", "page_results_fx"))
def _(spark, sf):
    """One real file per document, written with commit and abort and read back whole."""
    pages = results(spark, sf)
    names = pages.select("doc_id").distinct().select("doc_id", F.format_string("doc%d.txt", "doc_id").alias("output"))
    path = sinks.export_files(pages, kept(spark, sf), names, scratch_path(spark, "files"), "txt")
    files = _whole_files(spark, path)
    return files.select("file", F.col("value").alias("content"))


def _whole_files(spark, path):
    """(file, value) of every document file of a folder."""
    return read_document_files(spark, path).select(F.col("output").alias("file"), "value")


_DOC_JSON = T.StructType([T.StructField("total_pages", T.LongType()), T.StructField("pages", T.ArrayType(_PAGE_JSON))])
_doc_id = lambda: F.regexp_extract("file", r"^doc(\d+)\.", 1).cast("long").alias("doc_id")


@query("f2_json_files", with_views(f"SELECT * FROM ({_FLAT}) JOIN {_TOTALS}", "page_results_fx"))
def _(spark, sf):
    """Every document's JSON file, written from ordered fragments, read back and parsed."""
    pages = results(spark, sf)
    names = pages.select("doc_id").distinct().select("doc_id", F.format_string("doc%d.json", "doc_id").alias("output"))
    path = sinks.export_files(pages, kept(spark, sf), names, scratch_path(spark, "files"), "json")
    parsed = _whole_files(spark, path).select(_doc_id(), F.from_json("value", _DOC_JSON).alias("d"))
    return _flat_regions(parsed.select("doc_id", "d.total_pages", F.explode("d.pages").alias("p")),
                         total_pages=F.col("total_pages"))


@query("f11_api_files", with_views(_API_SQL, "page_results_fx"))
def _(spark, sf):
    """Every answer's body, written from ordered fragments, read back and parsed."""
    pages, jobs = results(spark, sf), _jobs(spark, sf)
    body = X.api_fragments(pages, kept(spark, sf), jobs, "txt").withColumn(
        "output", F.format_string("doc%d.json", "doc_id")).withColumnRenamed("text", "value")
    path = write_document_files(body, scratch_path(spark, "files"), ["page_number", "part", "ord"],
                                key=("doc_id", "output"))
    parsed = _whole_files(spark, path).select(_doc_id(), F.from_json("value", _ANSWER).alias("a"))
    return _flat_answers(parsed)


def _csv_rows(spark, path, kinds):
    """The records of every CSV file of a folder below its header, with their file."""
    records = F.regexp_extract_all("value", F.lit(_CSV_RECORD), F.lit(0))
    parsed = F.from_csv(F.expr("substring(record, 1, length(record) - 1)"), kinds, {"escape": "\\", "multiLine": "true", "lineSep": "\n"})
    return (_whole_files(spark, path).select("file", F.posexplode(records).alias("place", "record"))
            .filter("place > 0").select("file", parsed.alias("r")).select("file", "r.*"))


#: A record of a CSV file with its line end; quoted values may hold line ends, and quotes after a backslash.
_CSV_RECORD = r'''(?:[^"\n]++|"(?:[^"\\]++|\\(?s:.))*+")*+\n'''


@query("f3_csv_files", with_views("""
  SELECT 'doc' || doc_id || '.csv' AS file, CAST(count(*) + 1 AS BIGINT) AS lines,
         sum(region_id)::BIGINT AS region_ids, sum(x)::BIGINT AS xs, sum(length(text))::BIGINT AS chars FROM (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY region_ord) AS region_id, x, text FROM kept_fx)
  GROUP BY doc_id""", "kept_fx"))
def _(spark, sf):
    """Every document's CSV file with its header, read back by a CSV reader."""
    boxes = kept(spark, sf)
    names = boxes.select("doc_id").distinct().select("doc_id", F.format_string("doc%d.csv", "doc_id").alias("output"))
    path = sinks.export_files(results(spark, sf), boxes, names, scratch_path(spark, "files"), "csv")
    kinds = "Page int, Region_ID long, Text string, Confidence string, X int, Y int, Width int, Height int"
    return _csv_rows(spark, path, kinds).groupBy("file").agg(
        (F.count("*") + 1).alias("lines"), F.sum("Region_ID").alias("region_ids"), F.sum("X").alias("xs"),
        F.sum(F.length("Text")).alias("chars"))
