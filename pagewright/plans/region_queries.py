"""Queries on region extraction (C) and sequence decoding (D)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions.decoding import CHARSETS, ctc_encode
from pagewright.operators import components as C, decode as D, reading as R
from pagewright.plans import fixtures as fx
from pagewright.plans.fixtures import with_views
from pagewright.plans.registry import query

#: The 8 x 8 grids need lower bounds than real score maps.
LOW_TEXT, MIN_AREA = 0.6, 3
r9 = lambda c: F.round(c, 9)


def _mask(spark, sf):
    return C.mask_cells(fx.cells_fx(spark, sf), LOW_TEXT)


_MASK = """SELECT * FROM cells_fx
           WHERE least(greatest(region_score + affinity_score, 0), 1) > 0.6"""


@query("c1_mask_cells", with_views(
    f"SELECT page_id, x, y, round(region_score, 9) AS region_score FROM ({_MASK})", "cells_fx"))
def _(spark, sf):
    return _mask(spark, sf).select("page_id", "x", "y", r9("region_score").alias("region_score"))


def _components_sql(body: str) -> str:
    """Reachability by a recursive walk: every cell, from every cell it touches."""
    walk = f"""mask AS ({_MASK}),
      walk AS (
        SELECT page_id, x AS fx, y AS fy, x, y FROM mask
        UNION
        SELECT w.page_id, w.fx, w.fy, m.x, m.y FROM walk w JOIN mask m
          ON m.page_id = w.page_id AND abs(m.x - w.x) + abs(m.y - w.y) = 1),
      labelled AS (
        SELECT m.page_id, m.x, m.y, m.region_score, l.label_y, l.label_x FROM mask m JOIN (
          SELECT page_id, fx, fy, min(y * 8 + x) // 8 AS label_y, min(y * 8 + x) % 8 AS label_x
          FROM walk GROUP BY ALL) l ON l.page_id = m.page_id AND l.fx = m.x AND l.fy = m.y),
      stats AS (
        SELECT page_id, CAST(label_y AS INTEGER) AS label_y, CAST(label_x AS INTEGER) AS label_x,
               count(*) AS area, avg(region_score) AS mean_score, min(x) AS x, min(y) AS y,
               max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h
        FROM labelled GROUP BY ALL)"""
    return with_views("", "cells_fx", recursive=True).rstrip() + f", {walk} {body}"


@query("c2_connected_components", _components_sql("""
  SELECT page_id, x, y, CAST(label_y AS INTEGER) AS label_y, CAST(label_x AS INTEGER) AS label_x
  FROM labelled"""))
def _(spark, sf):
    return C.connected_components(_mask(spark, sf)).select("page_id", "x", "y", "label_y", "label_x")


@query("c3_component_boxes", _components_sql("""
  SELECT page_id, label_y, label_x, area, round(mean_score, 9) AS mean_score, x, y, w, h,
         CAST(x + w AS DOUBLE) AS right_x, CAST(y + h AS DOUBLE) AS bottom_y
  FROM stats WHERE area >= 3 AND mean_score >= 0.7"""))
def _(spark, sf):
    boxes = C.component_boxes(_mask(spark, sf), MIN_AREA)
    corner = F.element_at("points", 3)
    return boxes.select("page_id", "label_y", "label_x", "area", r9("mean_score").alias("mean_score"),
                        "x", "y", "w", "h", corner["x"].alias("right_x"), corner["y"].alias("bottom_y"))


@query("c4_rescale_boxes", with_views("""
  SELECT doc_id, page_number, region_ord, round(x / 1.5::DOUBLE, 9) AS left_x, round(y / 0.75::DOUBLE, 9) AS top_y,
         round((x + w) / 1.5::DOUBLE, 9) AS right_x, round((y + h) / 0.75::DOUBLE, 9) AS bottom_y
  FROM regions_fx""", "regions_fx"))
def _(spark, sf):
    boxes = fx.regions_fx(spark, sf)
    boxes = boxes.withColumn("points", G.corner_points(*map(F.col, ("x", "y", "w", "h"))))
    scaled = C.rescale_boxes(boxes, F.lit(1.5), F.lit(0.75))
    first, third = F.element_at("points", 1), F.element_at("points", 3)
    return scaled.select(*R.PAGE, "region_ord", r9(first["x"]).alias("left_x"), r9(first["y"]).alias("top_y"),
                         r9(third["x"]).alias("right_x"), r9(third["y"]).alias("bottom_y"))


def _tilted(spark, sf):
    """Regions as quadrilaterals with corners off the grid and in mixed order."""
    x, y, w, h = map(F.col, ("x", "y", "w", "h"))
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return fx.regions_fx(spark, sf).withColumn("points", F.array(
        point(x + w + 0.75, y + h + 0.25), point(x + 0.25, y + 0.5),
        point(x - 0.5, y + h + 0.5), point(x + w + 0.5, y + 0.25)))


@query("c5_bbox", with_views("""
  SELECT doc_id, page_number, region_ord, bx, by_, bw, bh, bw * bh AS area
  FROM (SELECT *, x + w - bx AS bw, y + h - by_ AS bh
        FROM (SELECT *, CAST(trunc(x - 0.5::DOUBLE) AS INTEGER) AS bx, y AS by_ FROM regions_fx))""",
    "regions_fx"))
def _(spark, sf):
    box = G.bbox(F.col("points"))
    return _tilted(spark, sf).select(*R.PAGE, "region_ord", box.alias("b")).select(
        *R.PAGE, "region_ord", F.col("b.x").alias("bx"), F.col("b.y").alias("by_"),
        F.col("b.w").alias("bw"), F.col("b.h").alias("bh"), F.col("b.area").alias("area"))


@query("c6_order_points", with_views("""
  SELECT doc_id, page_number, region_ord, x + 0.25::DOUBLE AS tl_x, y + 0.5::DOUBLE AS tl_y,
         x + w + 0.5::DOUBLE AS tr_x, y + 0.25::DOUBLE AS tr_y,
         x + w + 0.75::DOUBLE AS br_x, y + h + 0.25::DOUBLE AS br_y,
         x - 0.5::DOUBLE AS bl_x, y + h + 0.5::DOUBLE AS bl_y FROM regions_fx""", "regions_fx"))
def _(spark, sf):
    ordered = _tilted(spark, sf).withColumn("p", G.order_points(F.col("points")))
    corner = lambda i, n: [F.element_at("p", i)[a].alias(f"{n}_{a}") for a in ("x", "y")]
    return ordered.select(*R.PAGE, "region_ord", *corner(1, "tl"), *corner(2, "tr"),
                          *corner(3, "br"), *corner(4, "bl"))


@query("c7_crop_size", with_views("""
  SELECT doc_id, page_number, region_ord,
         CASE WHEN greatest(w, h) < 10 OR least(w, h) < 5 THEN 100 ELSE greatest(w, h) END AS width,
         CASE WHEN greatest(w, h) < 10 OR least(w, h) < 5 THEN 32 ELSE least(w, h) END AS height,
         greatest(w, h) < 10 OR least(w, h) < 5 AS blank
  FROM (SELECT * EXCLUDE (h), h // 2 AS h FROM regions_fx)""", "regions_fx"))
def _(spark, sf):
    size = G.crop_size(F.col("w"), F.floor(F.col("h") / 2))
    return fx.regions_fx(spark, sf).select(*R.PAGE, "region_ord", size.alias("s")).select(
        *R.PAGE, "region_ord", "s.width", "s.height", "s.blank")


@query("c8_detect_regions", _components_sql("""
  SELECT p.page_id, round(s.mean_score, 9) AS confidence,
         round(s.x / 0.5::DOUBLE, 9) AS x0, round(s.y / 0.25::DOUBLE, 9) AS y0,
         round((s.x + s.w) / 0.5::DOUBLE, 9) AS x1, round(s.y / 0.25::DOUBLE, 9) AS y1,
         round((s.x + s.w) / 0.5::DOUBLE, 9) AS x2, round((s.y + s.h) / 0.25::DOUBLE, 9) AS y2,
         round(s.x / 0.5::DOUBLE, 9) AS x3, round((s.y + s.h) / 0.25::DOUBLE, 9) AS y3
  FROM (SELECT DISTINCT page_id FROM cells_fx) p
  LEFT JOIN (SELECT * FROM stats WHERE area >= 3 AND mean_score >= 0.7) s USING (page_id)"""))
def _(spark, sf):
    cells = fx.cells_fx(spark, sf)
    pages = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("page_id"))
    regions = C.detect_regions(pages, cells, F.lit(0.5), F.lit(0.25), LOW_TEXT, MIN_AREA)
    corners = [r9(F.get("points", F.lit(i))[c]).alias(f"{c}{i}") for i in range(4) for c in "xy"]
    return regions.select("page_id", r9("confidence").alias("confidence"), *corners)


_CHARS = "'0123456789abcdefghijklmnopqrstuvwxyz'"


@query("d1_ctc_encode", with_views("""
  SELECT doc_id AS region_id, coalesce(labels, '') AS labels FROM documents LEFT JOIN (
    SELECT region_id, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY t) AS labels
    FROM steps_fx WHERE idx > 0 OR ch = '-' GROUP BY region_id) ON region_id = doc_id""", "steps_fx"))
def _(spark, sf):
    texts = fx.dealt(spark, sf, "documents", "doc_id", "text")
    labels = F.array_join(ctc_encode("text").cast("array<string>"), ",")
    return texts.select(F.col("doc_id").alias("region_id"), labels.alias("labels"))


_BEST = """
  SELECT region_id, t, min(cls) AS idx, any_value(top) AS top FROM (
    SELECT *, max(logit) OVER (PARTITION BY region_id, t) AS top FROM logits_fx)
  WHERE logit = top GROUP BY ALL"""
_STEP_PROBS = f"""
  SELECT b.region_id, b.t, b.idx, 1.0::DOUBLE / sum(exp(l.logit - b.top)) AS prob
  FROM ({_BEST}) b JOIN logits_fx l USING (region_id, t) GROUP BY ALL"""


@query("d2_ctc_best_path", with_views(
    f"SELECT region_id, t, idx, round(prob, 6) AS prob FROM ({_STEP_PROBS})", "logits_fx"))
def _(spark, sf):
    return D.ctc_best_path(fx.logits_fx(spark, sf)).select(
        "region_id", "t", "idx", F.round("prob", 6).alias("prob"))


def _collapse_sql(source: str) -> str:
    return f"""
      SELECT region_id, coalesce(string_agg(CASE WHEN idx <> 0 AND (prev IS NULL OR prev <> idx)
               THEN substr({_CHARS}, idx, 1) END, '' ORDER BY t), '') AS text
      FROM (SELECT *, lag(idx) OVER (PARTITION BY region_id ORDER BY t) AS prev FROM {source})
      GROUP BY region_id"""


@query("d3_ctc_collapse", with_views(_collapse_sql("steps_fx"), "steps_fx"))
def _(spark, sf):
    return D.ctc_collapse(fx.steps_fx(spark, sf))


@query("d3_ctc_keep_repeats", with_views(f"""
  SELECT region_id, coalesce(string_agg(CASE WHEN idx <> 0 THEN substr({_CHARS}, idx, 1) END, ''
         ORDER BY t), '') AS text FROM steps_fx GROUP BY region_id""", "steps_fx"))
def _(spark, sf):
    return D.ctc_collapse(fx.steps_fx(spark, sf), remove_duplicates=False)


@query("d4_ctc_confidence", with_views(f"""
  SELECT region_id, round(coalesce(avg(CASE WHEN idx <> 0 THEN prob END), 0.0), 6) AS confidence,
         string_agg(CAST(CAST(round(prob * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY t) AS char_permille
  FROM ({_STEP_PROBS}) GROUP BY region_id""", "logits_fx"))
def _(spark, sf):
    confidence = D.ctc_confidence(fx.logits_fx(spark, sf))
    permille = F.transform("char_confidences", lambda p: F.round(p * 1000).cast("bigint").cast("string"))
    return confidence.select("region_id", F.round("confidence", 6).alias("confidence"),
                             F.array_join(permille, ",").alias("char_permille"))


@query("d4_recognize", with_views(f"""
  SELECT region_id, text, round(confidence, 6) AS confidence
  FROM ({_collapse_sql(f'({_BEST})')})
  JOIN (SELECT region_id, coalesce(avg(CASE WHEN idx <> 0 THEN prob END), 0.0) AS confidence
        FROM ({_STEP_PROBS}) GROUP BY region_id) USING (region_id)""", "logits_fx"))
def _(spark, sf):
    return D.recognize(fx.logits_fx(spark, sf)).select(
        "region_id", "text", F.round("confidence", 6).alias("confidence"))


@query("d5_gate_recognition", with_views(
    "SELECT doc_id, page_number, region_ord, text FROM kept_fx", "kept_fx"))
def _(spark, sf):
    return R.gate_recognition(fx.regions_fx(spark, sf)).select(*R.PAGE, "region_ord", "text")


@query("d6_slice_batches", with_views("""
  SELECT doc_id, page_number, batch_no, count(*) AS boxes, min(region_ord) AS first_box
  FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY region_ord) - 1) // 8 AS batch_no
        FROM regions_fx) GROUP BY ALL""", "regions_fx"))
def _(spark, sf):
    return R.slice_batches(fx.regions_fx(spark, sf), together=True).groupBy(*R.PAGE, "batch_no").agg(
        F.count("*").alias("boxes"), F.min("region_ord").alias("first_box"))


def _charset_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS name, ch, CAST(instr('{c}', ch) AS INTEGER) AS idx "
        f"FROM (SELECT unnest(string_split('{c}', '')) AS ch)" for n, c in CHARSETS.items())


@query("d7_charset", with_views(f"""
  SELECT name, c.idx, s.ch, count(*) AS uses FROM steps_fx s JOIN ({_charset_sql()}) c ON c.ch = s.ch
  GROUP BY ALL""", "steps_fx"))
def _(spark, sf):
    uses = fx.steps_fx(spark, sf).groupBy("ch").agg(F.count("*").alias("uses"))
    return uses.join(F.broadcast(D.charset(spark)), "ch").select("name", "idx", "ch", "uses")


def _toy_model():
    """Loader of a model that fails on any batch with a word of more than 12 letters."""
    def load():
        def read(batch: pd.DataFrame):
            words = batch["word"].tolist()
            if any(len(w) > 12 for w in words):
                raise ValueError("word too long")
            return [(f"{w}{len(w)}", min(len(w) / 8, 1.0), [1.0] * len(w)) for w in words]
        return read
    return load


@query("d8_apply_recognizer", with_views("""
  SELECT doc_id, page_number, region_ord, CASE WHEN length(text) > 12 THEN '' ELSE text || length(text) END AS text,
         CASE WHEN length(text) > 12 THEN 0.0 ELSE least(length(text) / 8.0::DOUBLE, 1.0) END AS rec_confidence,
         CAST(CASE WHEN length(text) > 12 THEN 0 ELSE length(text) END AS INTEGER) AS steps
  FROM regions_fx""", "regions_fx"))
def _(spark, sf):
    words = fx.regions_fx(spark, sf).select(
        *R.PAGE, "region_ord", F.col("text").alias("word"))
    return D.apply_recognizer(words, _toy_model()).select(
        *R.PAGE, "region_ord", "text", "rec_confidence", F.size("char_confidences").alias("steps"))


@query("d9_decode_with_lengths", with_views(f"""
  SELECT l.region_id, coalesce(c.text, '') AS text FROM step_lengths_fx l LEFT JOIN (
    {_collapse_sql('(SELECT s.* FROM steps_fx s JOIN step_lengths_fx USING (region_id) WHERE t < length)')}
  ) c USING (region_id)""", "steps_fx", "step_lengths_fx"))
def _(spark, sf):
    return D.decode_with_lengths(fx.steps_fx(spark, sf), fx.step_lengths_fx(spark, sf))
