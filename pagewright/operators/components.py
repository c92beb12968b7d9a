"""Text regions from score maps: mask, connected components, boxes.

Cells are first joined into horizontal runs; only runs take part in the component search.
The search contracts edges: each round every run points at the neighbour (or itself) with
the least hashed priority, and edges are rewritten to those targets. Hashed priorities make
the graph shrink by a constant factor per round whatever its shape, so the number of rounds
grows with the logarithm of the largest component, and nothing is gathered per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagewright.functions.geometry import corner_points, rescale_points
from pagewright.session import cut_lineage

LOW_TEXT, TEXT_THRESHOLD, MIN_AREA = 0.4, 0.7, 10
#: Pixels per band in the search for overlapping runs.
STRIP = 64
#: Run identity inside a page: y and first x in one number that sorts as (y, x).
STRIDE = 1 << 31


def mask_cells(cells: DataFrame, low_text: float = LOW_TEXT) -> DataFrame:
    """Cells whose clipped region + affinity score is above ``low_text``."""
    score = F.col("region_score") + F.col("affinity_score")
    return cells.filter(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) > low_text)


def _with_run(cells: DataFrame) -> DataFrame:
    """Add ``run``, the identity of the horizontal run of adjacent cells a cell is in."""
    along = W.partitionBy("page_id", "y").orderBy("x")
    starts = F.coalesce(F.col("x") - F.lag("x").over(along) > 1, F.lit(True))
    upto = along.rowsBetween(W.unboundedPreceding, W.currentRow)
    first = F.last(F.when(F.col("_starts"), F.col("x")), ignorenulls=True).over(upto)
    return (cells.withColumn("_starts", starts)
            .withColumn("run", F.col("y") * F.lit(STRIDE) + first).drop("_starts"))


def _runs(cells: DataFrame) -> DataFrame:
    return _with_run(cells).groupBy("page_id", "y", "run").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("cells"),
        F.sum("region_score").alias("score"))


def _touching(runs: DataFrame) -> DataFrame:
    """Pairs of runs on adjacent rows that share a column.

    Runs meet inside strips of columns; a pair in several strips counts in the first only.
    """
    strip = lambda c: F.floor(F.col(c) / STRIP)
    cut = runs.select("page_id", "y", "run", "x0", "x1",
                      F.explode(F.sequence(strip("x0"), strip("x1"))).alias("strip"))
    below = cut.select("page_id", (F.col("y") - 1).alias("y"), "strip", F.col("run").alias("b"),
                       F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    shared = (F.col("x0") <= F.col("b1")) & (F.col("b0") <= F.col("x1"))
    first_strip = F.col("strip") == F.greatest(strip("x0"), strip("b0"))
    return (cut.join(below, ["page_id", "y", "strip"]).filter(shared & first_strip)
            .select("page_id", F.col("run").alias("a"), "b"))


def _priority(node: str) -> Column:
    return F.struct(F.xxhash64("page_id", node).alias("p"), F.col(node).alias("v"))


def _follow(roots: DataFrame, further: DataFrame) -> DataFrame:
    """Roots replaced by their own root where ``further`` knows one."""
    step = further.select("page_id", F.col("run").alias("root"), F.col("root").alias("top"))
    return roots.join(step, ["page_id", "root"], "left").select(
        "page_id", "run", F.coalesce("top", "root").alias("root"))


def _contract(edges: DataFrame) -> DataFrame | None:
    """(page_id, run, root) for every run that has an edge; None without any edge."""
    levels = []
    edges = cut_lineage(edges)
    while not edges.isEmpty():
        both = edges.select("page_id", F.explode(F.array(
            F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        both = both.select("page_id", "e.a", "e.b")
        nearest = both.groupBy("page_id", "a").agg(F.min(_priority("b")).alias("m"))
        pointed = nearest.select(
            "page_id", F.col("a").alias("run"), F.least(_priority("a"), F.col("m"))["v"].alias("root"))
        target = cut_lineage(_follow(_follow(pointed, pointed), pointed))
        levels.append(target)
        end = lambda side: target.select(
            "page_id", F.col("run").alias(side), F.col("root").alias(f"root_{side}"))
        moved = edges.join(end("a"), ["page_id", "a"]).join(end("b"), ["page_id", "b"])
        low, high = F.least("root_a", "root_b"), F.greatest("root_a", "root_b")
        edges = cut_lineage(moved.filter(F.col("root_a") != F.col("root_b"))
                            .select("page_id", low.alias("a"), high.alias("b")).distinct())
    roots = None
    for level in reversed(levels):  # later levels only know the runs that were still targets
        roots = level if roots is None else _follow(level, roots)
    return roots


def _labelled_runs(cells: DataFrame) -> DataFrame:
    """Runs with ``root``, equal for the runs of one component."""
    runs = cut_lineage(_runs(cells))
    roots = _contract(_touching(runs))
    if roots is None:
        return runs.withColumn("root", F.col("run"))
    return (runs.join(roots, ["page_id", "run"], "left")
            .withColumn("root", F.coalesce("root", "run")))


def connected_components(cells: DataFrame) -> DataFrame:
    """Add the 4-neighbour component to masked cells: its least (y, x) as label_y, label_x."""
    runs = _labelled_runs(cells)
    labels = runs.groupBy("page_id", "root").agg(F.min("run").alias("label"))
    named = runs.select("page_id", "run", "root").join(labels, ["page_id", "root"]).drop("root")
    return (_with_run(cells).join(named, ["page_id", "run"])
            .withColumns({"label_y": F.floor(F.col("label") / STRIDE).cast("int"),
                          "label_x": (F.col("label") % STRIDE).cast("int")})
            .drop("run", "label"))


def component_stats(cells: DataFrame) -> DataFrame:
    """One row per component: area, mean region score and box."""
    stats = _labelled_runs(cells).groupBy("page_id", "root").agg(
        F.min("run").alias("label"), F.sum("cells").alias("area"),
        (F.sum("score") / F.sum("cells")).alias("mean_score"),
        F.min("x0").alias("x"), F.min("y").alias("y"),
        (F.max("x1") - F.min("x0") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    return stats.select(
        "page_id", F.floor(F.col("label") / STRIDE).cast("int").alias("label_y"),
        (F.col("label") % STRIDE).cast("int").alias("label_x"),
        "area", "mean_score", "x", "y", "w", "h")


def component_boxes(cells: DataFrame, min_area: int = MIN_AREA,
                    text_threshold: float = TEXT_THRESHOLD) -> DataFrame:
    """Boxes of components that are large and sure enough, with corner points."""
    kept = component_stats(cells).filter(
        (F.col("area") >= min_area) & (F.col("mean_score") >= text_threshold))
    return kept.withColumn("points", corner_points(*map(F.col, ("x", "y", "w", "h"))))


def rescale_boxes(boxes: DataFrame, ratio_w: Column, ratio_h: Column) -> DataFrame:
    """Points back in source-image coordinates."""
    return boxes.withColumn("points", rescale_points(F.col("points"), ratio_w, ratio_h))


def detect_regions(pages: DataFrame, cells: DataFrame, ratio_w: Column, ratio_h: Column,
                   low_text: float = LOW_TEXT, min_area: int = MIN_AREA,
                   text_threshold: float = TEXT_THRESHOLD) -> DataFrame:
    """Rescaled boxes per page; a page without any keeps one row of nulls."""
    boxes = component_boxes(mask_cells(cells, low_text), min_area, text_threshold)
    scaled = rescale_boxes(boxes, ratio_w, ratio_h).withColumnRenamed("mean_score", "confidence")
    return pages.select("page_id").distinct().join(scaled, "page_id", "left")
