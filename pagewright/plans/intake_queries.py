"""Queries on file intake (A), image rules (B) and failure handling (E7, G11, G12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions.errors import GROUPS, ROOT
from pagewright.functions.text import message_with_details
from pagewright.operators import imagestats as I, intake as A, reading as R
from pagewright.plans import fixtures as fx
from pagewright.plans.fixtures import with_views
from pagewright.plans.registry import query

EXTS = "('.pdf','.png','.jpg','.jpeg','.tiff','.bmp','.webp')"
IMAGES = "('.png','.jpg','.jpeg','.tiff','.bmp','.webp')"
r9 = lambda c: F.round(c, 9)


@query("a2_route_format", with_views(f"""
  SELECT file_id, path, CASE WHEN ext = '.pdf' THEN 'pdf' WHEN ext IN {IMAGES} THEN 'image'
         ELSE 'unsupported' END AS route FROM files_fx""", "files_fx"))
def _(spark, sf):
    return fx.files_fx(spark, sf).select("file_id", "path", A.route_format("path").alias("route"))


@query("a3_check_size", with_views("""
  SELECT file_id, length <= 104857600 AS size_ok,
         CASE WHEN length > 104857600
              THEN printf('File size (%.1fMB) exceeds limit (100MB)', length / 1048576.0) END AS size_message
  FROM files_fx""", "files_fx"))
def _(spark, sf):
    return A.check_size(fx.files_fx(spark, sf)).select("file_id", "size_ok", "size_message")


@query("a4_check_extension", with_views(f"""
  SELECT file_id, ext IN {EXTS} AS format_ok,
         CASE WHEN ext NOT IN {EXTS} THEN 'Unsupported file format: ' || ext END AS format_message,
         true AS off_ok FROM files_fx""", "files_fx"))
def _(spark, sf):
    on = A.check_extension(fx.files_fx(spark, sf))
    off = A.check_extension(on.withColumnsRenamed({"format_ok": "on_ok", "format_message": "on_message"}), False)
    return off.select("file_id", F.col("on_ok").alias("format_ok"),
                      F.col("on_message").alias("format_message"), F.col("format_ok").alias("off_ok"))


@query("a4_extension_list", with_views(f"SELECT file_id, ext IN {EXTS} AS listed FROM files_fx", "files_fx"))
def _(spark, sf):
    """The allow-list as a table: files on it and files off it."""
    files = fx.files_fx(spark, sf)
    allowed = files.select(A.suffix("path").alias("ext")).filter(F.col("ext").isin(*A.SUPPORTED_EXTENSIONS))
    side = lambda keep: A.with_extensions(files, allowed, keep).select("file_id", F.lit(keep).alias("listed"))
    return side(True).unionByName(side(False))


@query("a5_from_bytes", """
  SELECT page_id, CASE WHEN page_id % 5 > 0 THEN 'document.' || t END AS file_name,
         CASE WHEN page_id % 5 > 0 THEN t END AS file_type,
         CASE WHEN page_id % 5 > 0 THEN CASE WHEN t = 'pdf' THEN 'pdf' ELSE 'image' END END AS source_type,
         CASE WHEN page_id % 5 = 0 THEN 'file_type must be specified for byte sources' END AS error,
         CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes
  FROM (SELECT *, CASE WHEN page_id % 2 = 0 THEN 'pdf' ELSE 'png' END AS t FROM pages)""")
def _(spark, sf):
    pages = fx.table(spark, sf, "pages")
    kind = F.when(F.col("page_id") % 5 > 0, F.when(F.col("page_id") % 2 == 0, "pdf").otherwise("png"))
    contents = pages.select("page_id", F.encode("html", "utf-8").alias("content"))
    return A.from_bytes(contents, kind).select(
        "page_id", "file_name", "file_type", "source_type", "error",
        F.octet_length("content").cast("bigint").alias("n_bytes"))


_PAGES = f"""
  SELECT file_id, path, CAST(unnest(range(1, page_count + 1)) AS INTEGER) AS page_number, width, height,
         CASE WHEN ext = '.pdf' THEN 300 ELSE 72 END AS dpi,
         CASE WHEN ext = '.pdf' THEN 'pdf' ELSE 'image' END AS source_type, ext
  FROM files_fx WHERE ext IN {EXTS}"""


@query("a6_explode_pages", with_views(f"SELECT * EXCLUDE (ext) FROM ({_PAGES})", "files_fx"))
def _(spark, sf):
    return A.explode_pages(fx.files_fx(spark, sf))


@query("a7_document_info", with_views(f"""
  SELECT file_id, regexp_extract(any_value(path), '[^/]+$') AS file_name, any_value(ext) AS file_type,
         count(*) AS total_pages, string_agg(width || 'x' || height, ',' ORDER BY page_number) AS page_sizes,
         CASE WHEN any_value(ext) <> '.pdf' THEN upper(any_value(ext)) END AS format,
         CASE WHEN any_value(ext) <> '.pdf' THEN any_value(width || 'x' || height) END AS size
  FROM ({_PAGES}) GROUP BY file_id""", "files_fx"))
def _(spark, sf):
    info = A.document_info(A.explode_pages(fx.files_fx(spark, sf)))
    return info.select("file_id", "file_name", "file_type", "total_pages", "page_sizes",
                       F.try_element_at("metadata", F.lit("format")).alias("format"),
                       F.try_element_at("metadata", F.lit("size")).alias("size"))


_REASON = """CASE WHEN page_count < 1 THEN 'Document has no pages'
       WHEN width = 0 OR height = 0 THEN 'Page 1 has invalid image'
       WHEN width < 10 OR height < 10 THEN 'Page 1 is too small: ' || width || 'x' || height END"""


@query("a8_validate_documents", with_views(f"""
  SELECT file_id, reason IS NULL AS valid, reason,
         CASE WHEN reason LIKE 'Page%' THEN 1 END AS bad_page
  FROM (SELECT *, {_REASON} AS reason FROM files_fx WHERE ext IN {EXTS})""", "files_fx"))
def _(spark, sf):
    files = fx.files_fx(spark, sf).filter(A.is_supported_format("path"))
    valid, quarantine = A.validate_documents(files.select("file_id"), A.explode_pages(files))
    return valid.select("file_id", F.lit(True).alias("valid"), F.lit(None).cast("string").alias("reason"),
                        F.lit(None).cast("int").alias("bad_page")).unionByName(
        quarantine.select("file_id", F.lit(False).alias("valid"), "reason", "bad_page"))


@query("a9_is_supported_format", with_views(
    f"SELECT file_id, ext IN {EXTS} AS supported FROM files_fx", "files_fx"))
def _(spark, sf):
    return fx.files_fx(spark, sf).select("file_id", A.is_supported_format("path").alias("supported"))


_CLASSIFIED = f"""
  SELECT *, CASE WHEN length > 104857600 THEN 'FileSizeException'
                 WHEN ext NOT IN {EXTS} THEN 'UnsupportedFormatException'
                 WHEN {_REASON} IS NOT NULL THEN 'InvalidDocumentException' END AS error_class,
            CASE WHEN length > 104857600 THEN
                   printf('File size (%.1fMB) exceeds limit (100MB)', length / 1048576.0)
                 WHEN ext NOT IN {EXTS} THEN 'Unsupported file format: ' || ext
                 ELSE {_REASON} END AS error_message
  FROM files_fx"""


@query("a10_intake_report", with_views(f"""
  SELECT CASE error_class WHEN 'FileSizeException' THEN 'size' WHEN 'UnsupportedFormatException' THEN 'format'
              WHEN 'InvalidDocumentException' THEN 'invalid' ELSE 'accepted' END AS outcome,
         count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes
  FROM ({_CLASSIFIED}) GROUP BY 1""", "files_fx"))
def _(spark, sf):
    return A.intake_report(fx.files_fx(spark, sf))


@query("b1_resize_plan", with_views("""
  SELECT file_id,
         CASE WHEN greatest(width, height) <= 2048 THEN width WHEN width >= height THEN 2048
              ELSE CAST(trunc(width * (2048.0::DOUBLE / height)) AS INTEGER) END AS new_width,
         CASE WHEN greatest(width, height) <= 2048 THEN height WHEN height >= width THEN 2048
              ELSE CAST(trunc(height * (2048.0::DOUBLE / width)) AS INTEGER) END AS new_height
  FROM files_fx""", "files_fx"))
def _(spark, sf):
    plan = G.resize_plan(F.col("width"), F.col("height"))
    return fx.files_fx(spark, sf).select("file_id", plan.alias("p")).select(
        "file_id", F.col("p.width").alias("new_width"), F.col("p.height").alias("new_height"))


@query("b2_detector_resize_plan", with_views("""
  SELECT file_id, w32 AS new_width, h32 AS new_height, round(ratio, 9) AS ratio,
         round(w32::DOUBLE / nullif(width, 0), 9) AS ratio_w, round(h32::DOUBLE / nullif(height, 0), 9) AS ratio_h
  FROM (SELECT *, CAST(trunc(width * ratio) AS INTEGER) // 32 * 32 AS w32,
                  CAST(trunc(height * ratio) AS INTEGER) // 32 * 32 AS h32
        FROM (SELECT *, least(1.5::DOUBLE * nullif(greatest(width, height), 0), 1280)
                        / nullif(greatest(width, height), 0) AS ratio FROM files_fx))""", "files_fx"))
def _(spark, sf):
    plan = G.detector_resize_plan(F.col("width"), F.col("height"))
    return fx.files_fx(spark, sf).select("file_id", plan.alias("p")).select(
        "file_id", F.col("p.width").alias("new_width"), F.col("p.height").alias("new_height"),
        r9("p.ratio").alias("ratio"), r9("p.ratio_w").alias("ratio_w"), r9("p.ratio_h").alias("ratio_h"))


@query("b3_recognizer_resize_plan", with_views("""
  SELECT file_id, CAST(nw AS INTEGER) AS new_width, CAST(100 - nw AS INTEGER) AS pad
  FROM (SELECT file_id, CASE WHEN height > 0 THEN least(trunc(32 * (width::DOUBLE / height)), 100)
                             ELSE 100 END AS nw FROM files_fx)""", "files_fx"))
def _(spark, sf):
    plan = G.recognizer_resize_plan(F.col("width"), F.col("height"))
    return fx.files_fx(spark, sf).select("file_id", plan.alias("p")).select(
        "file_id", F.col("p.width").alias("new_width"), F.col("p.pad").alias("pad"))


_OTSU = """
  SELECT image_id, CAST(CASE WHEN count(*) > 1 THEN arg_min(level, struct_pack(s := -score, l := level))
                             ELSE 0 END AS INTEGER) AS threshold
  FROM (SELECT a.image_id, a.level,
               coalesce(max(CASE WHEN b.n1 > 0 THEN power(b.s0 * b.n1 - b.s1 * b.n0, 2) / (b.n0 * b.n1) END), 0) AS score
        FROM (SELECT DISTINCT image_id, value AS level FROM pixels_fx) a
        JOIN (SELECT l.image_id, l.level,
                     sum(CASE WHEN p.value <= l.level THEN 1.0::DOUBLE ELSE 0 END) AS n0,
                     sum(CASE WHEN p.value > l.level THEN 1.0::DOUBLE ELSE 0 END) AS n1,
                     sum(CASE WHEN p.value <= l.level THEN p.value ELSE 0 END)::DOUBLE AS s0,
                     sum(CASE WHEN p.value > l.level THEN p.value ELSE 0 END)::DOUBLE AS s1
              FROM (SELECT DISTINCT image_id, value AS level FROM pixels_fx) l
              JOIN pixels_fx p USING (image_id) GROUP BY ALL) b USING (image_id, level)
        GROUP BY ALL) GROUP BY image_id"""


@query("b4_otsu_threshold", with_views(_OTSU, "pixels_fx"))
def _(spark, sf):
    return I.otsu_threshold(fx.pixels_fx(spark, sf))


@query("b5_binarize", with_views(f"""
  SELECT image_id, x, y, CASE WHEN value > threshold THEN 255 ELSE 0 END AS bit,
         CASE WHEN value > threshold THEN 0 ELSE 255 END AS ink
  FROM pixels_fx JOIN ({_OTSU}) USING (image_id)""", "pixels_fx"))
def _(spark, sf):
    pixels = fx.pixels_fx(spark, sf)
    thresholds = I.otsu_threshold(pixels)
    return I.binarize(pixels, thresholds).select(
        "image_id", "x", "y", "bit", (255 - F.col("bit")).alias("ink"))


@query("b6_projection_profiles", with_views("""
  SELECT image_id, 'row' AS axis, y AS pos, CAST(sum(value) AS BIGINT) AS total FROM pixels_fx GROUP BY ALL
  UNION ALL
  SELECT image_id, 'col', x, CAST(sum(value) AS BIGINT) FROM pixels_fx GROUP BY ALL""", "pixels_fx"))
def _(spark, sf):
    return I.projection_profiles(fx.pixels_fx(spark, sf)).select("image_id", "axis", "pos", "total")


_STDS = """
  SELECT image_id, max(rs) AS row_std, max(cs) AS col_std FROM (
    SELECT image_id, stddev_pop(t) AS rs, NULL AS cs
    FROM (SELECT image_id, y, sum(value)::DOUBLE AS t FROM pixels_fx GROUP BY ALL) GROUP BY ALL
    UNION ALL
    SELECT image_id, NULL, stddev_pop(t)
    FROM (SELECT image_id, x, sum(value)::DOUBLE AS t FROM pixels_fx GROUP BY ALL) GROUP BY ALL)
  GROUP BY ALL"""


@query("b6_profile_spread", with_views(
    f"SELECT image_id, round(row_std, 6) AS row_std, round(col_std, 6) AS col_std FROM ({_STDS})", "pixels_fx"))
def _(spark, sf):
    spread = I.profile_spread(fx.pixels_fx(spark, sf))
    return spread.select("image_id", F.round("row_std", 6).alias("row_std"),
                         F.round("col_std", 6).alias("col_std"))


@query("b7_needs_rotation", with_views(f"""
  SELECT image_id, width, height, height > 1.5 * width AND col_std > 1.5 * row_std AS rotate_90
  FROM (SELECT *, CAST(image_id * 37 % 4000 AS INTEGER) AS width, CAST(image_id * 53 % 4000 AS INTEGER) AS height
        FROM ({_STDS}))""", "pixels_fx"))
def _(spark, sf):
    i = F.col("vec_id")
    sizes = fx.table(spark, sf, "embeddings").select(
        i.alias("image_id"), (i * 37 % 4000).cast("int").alias("width"), (i * 53 % 4000).cast("int").alias("height"))
    return I.needs_rotation(I.profile_spread(fx.pixels_fx(spark, sf)), sizes).select(
        "image_id", "width", "height", "rotate_90")


_SKEW = """CASE WHEN n_points < 100 OR abs(folded) < 0.5 THEN 0.0::DOUBLE ELSE folded END"""
_FOLDED = """(SELECT *, CASE WHEN angle < -45 THEN 90 + angle WHEN angle > 45 THEN angle - 90
              ELSE angle END AS folded FROM files_fx)"""


@query("b8_normalize_skew", with_views(f"SELECT file_id, {_SKEW} AS skew FROM {_FOLDED}", "files_fx"))
def _(spark, sf):
    skew = G.normalized_skew(F.col("angle"), F.col("n_points"))
    return fx.files_fx(spark, sf).select("file_id", skew.alias("skew"))


@query("b9_transformation_log", with_views(f"""
  SELECT file_id, concat_ws(' -> ',
           CASE WHEN file_id % 2 = 0 THEN 'grayscale_conversion' END,
           CASE WHEN greatest(width, height) > 2048 THEN 'resize_to_2048' END,
           CASE WHEN file_id % 3 > 0 THEN 'denoising' END,
           CASE WHEN file_id % 5 > 0 THEN printf('deskew_%.2fdeg', {_SKEW}) END,
           CASE WHEN file_id % 7 > 0 THEN 'contrast_enhancement' END,
           'binarization', 'morphological_ops') AS steps
  FROM {_FOLDED}""", "files_fx"))
def _(spark, sf):
    i = F.col("file_id")
    target = F.when(F.greatest("width", "height") > 2048, 2048)
    steps = I.transformation_log(
        i % 2 == 0, target, i % 3 > 0, i % 5 > 0,
        G.normalized_skew(F.col("angle"), F.col("n_points")), i % 7 > 0)
    return fx.files_fx(spark, sf).select("file_id", F.array_join(steps, " -> ").alias("steps"))


@query("e7_with_failures", with_views(f"""
  SELECT file_id, CASE WHEN error_class IS NULL THEN 'ok' ELSE 'failed' END AS status,
         CASE WHEN error_class IS NULL THEN '' ELSE 'failed' END AS page_steps,
         CASE WHEN error_class IS NULL THEN '' ELSE 'failed_fallback' END AS preprocess_steps,
         CASE WHEN error_class IS NULL THEN 'read' ELSE '' END AS full_text,
         CASE WHEN error_class IS NULL THEN 0.9::DOUBLE ELSE 0.0 END AS confidence,
         CASE WHEN error_class IS NULL THEN 'read' END AS document_text
  FROM ({_CLASSIFIED})""", "files_fx"))
def _(spark, sf):
    classified = A.classify_files(fx.files_fx(spark, sf))
    results = classified.filter(F.col("error_class").isNull()).select(
        "file_id", F.lit("read").alias("full_text"), F.lit(0.9).alias("confidence"))
    sources = classified.select("file_id")
    page = R.with_failures(sources, results, ["file_id"], "page")
    pre = R.with_failures(sources, results.select("file_id"), ["file_id"], "preprocess")
    doc = R.with_failures(sources, results.select("file_id", F.col("full_text").alias("document_text")),
                          ["file_id"], "document")
    return (page.select("file_id", "status", F.array_join("steps", ",").alias("page_steps"),
                        "full_text", "confidence")
            .join(pre.select("file_id", F.array_join("steps", ",").alias("preprocess_steps")), "file_id")
            .join(doc.select("file_id", "document_text"), "file_id"))


def _taxonomy_sql() -> str:
    rows = [(ROOT, ROOT)] + [(g, a) for g in GROUPS for a in (g, ROOT)]
    rows += [(m, a) for g, ms in GROUPS.items() for m in ms for a in (m, g, ROOT)]
    return "(VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in rows) + ") t(error_class, ancestor)"


@query("g11_error_taxonomy", with_views(f"""
  SELECT ancestor, count(*) AS failures
  FROM ({_CLASSIFIED}) JOIN {_taxonomy_sql()} USING (error_class) GROUP BY ancestor""", "files_fx"))
def _(spark, sf):
    failed = A.classify_files(fx.files_fx(spark, sf)).filter(F.col("error_class").isNotNull())
    return A.failures_by_ancestor(failed).select("ancestor", "failures")


@query("g12_error_message", with_views(f"""
  SELECT file_id, error_message || CASE WHEN length > 104857600
           THEN ' (path=' || path || ', length=' || length || ')' ELSE '' END AS shown
  FROM ({_CLASSIFIED}) WHERE error_class IS NOT NULL""", "files_fx"))
def _(spark, sf):
    failed = A.classify_files(fx.files_fx(spark, sf)).filter(F.col("error_class").isNotNull())
    details = F.when(F.col("error_class") == "FileSizeException", F.create_map(
        F.lit("path"), F.col("path"), F.lit("length"), F.col("length").cast("string")))
    return failed.select("file_id", message_with_details(F.col("error_message"), details).alias("shown"))
