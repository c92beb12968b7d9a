"""Reading order, line assembly and the page and document roll-ups.

Input rows are word boxes keyed by (doc_id, page_number, region_ord). A page may hold a
large share of all rows, so no step gathers a page's boxes: the line rule is folded over
each page's distinct (y, h) pairs, which the pixel grid bounds, and boxes get their line
through a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagewright.operators.ordering import ranked

PAGE = ["doc_id", "page_number"]
#: Width in pixels of the bands that split one row of boxes. Pages are rarely wider.
BAND = 4096


def _band(x: str = "x") -> Column:
    return F.floor(F.col(x) / BAND)


def gate_recognition(regions: DataFrame, threshold: float = 0.5,
                     confidence: str = "rec_confidence") -> DataFrame:
    """Boxes whose text was read with at least ``threshold`` confidence and is not empty."""
    text = F.when(F.col(confidence) >= threshold, F.col("text")).otherwise("")
    return regions.withColumn("text", text).filter(F.col("text") != "")


def reading_order(regions: DataFrame) -> DataFrame:
    """Add ``reading_pos``: 1-based place on the page by y, then x, then input order."""
    banded = regions.withColumn("_xb", _band())
    return ranked(banded, PAGE, ["y", "_xb"], ["x", "region_ord"], "reading_pos").drop("_xb")


def slice_batches(regions: DataFrame, batch_size: int = 8, together: bool = False) -> DataFrame:
    """Add ``batch_no``: 0-based batch of ``batch_size`` boxes in input order on the page. ``together``: see ``ordering.ranked``."""
    banded = regions.withColumn("_ob", F.floor(F.col("region_ord") / BAND))
    placed = ranked(banded, PAGE, ["_ob"], ["region_ord"], "_pos", together)
    return placed.withColumn("batch_no", F.floor((F.col("_pos") - 1) / batch_size)).drop("_ob", "_pos")


def _line_breaks(regions: DataFrame) -> DataFrame:
    """One row per page, y and x band: its line, and the first box of a line that starts there.

    A box opens a line when its y is more than half its own height below the y that opened
    the current line. Boxes are visited in reading order, so only the first box at some y
    that is low enough can open a line there: the least position among heights below twice
    the distance. Hence the fold needs (y, h, first position), not boxes.

    A y further than half of its least height from the y before it opens a line whatever
    the state, so the state has to be carried only between such certain breaks.
    """
    pairs = (regions.groupBy(*PAGE, "y", "h", _band().alias("_xb"))
             .agg(F.min(F.struct("x", "region_ord")).alias("first")))
    rows = pairs.groupBy(*PAGE, "y").agg(
        F.min("h").alias("min_h"),
        F.collect_list(F.struct("h", "first")).alias("firsts"),
        F.collect_set("_xb").alias("bands"))
    down = W.partitionBy(*PAGE).orderBy("y")
    before, upto = (down.rowsBetween(W.unboundedPreceding, end) for end in (-1, W.currentRow))
    gap = F.col("y") - F.lag("y").over(down)
    runs = (rows.withColumn("_certain", gap.isNull() | (gap > 0.5 * F.col("min_h")))
            .withColumn("_run", F.sum(F.col("_certain").cast("int")).over(upto)))

    row = F.struct("y", "min_h", "firsts", "bands")
    def step(state, r):
        opens = state["line_y"].isNull() | (r["y"] - state["line_y"] > 0.5 * r["min_h"])
        return F.struct(
            F.when(opens, r["y"]).otherwise(state["line_y"]).alias("line_y"),
            F.concat(state["done"], F.array(opens)).alias("done"))
    sorted_rows = F.sort_array(F.col("_rows"))
    opens = F.aggregate(
        sorted_rows,
        F.struct(F.lit(None).cast(regions.schema["y"].dataType).alias("line_y"),
                 F.array().cast("array<boolean>").alias("done")),
        step, lambda state: state["done"])
    folded = (runs.groupBy(*PAGE, "_run").agg(F.collect_list(row).alias("_rows"))
              .select(*PAGE, F.explode(F.arrays_zip(
                  sorted_rows.alias("r"), opens.alias("opens"))).alias("z"))
              .select(*PAGE, "z.r.*", "z.opens"))

    line_y = F.when(F.col("opens"), F.col("y"))
    numbered = (folded.withColumn("_prev", F.last(line_y, ignorenulls=True).over(before))
                .withColumn("line_no", F.sum(F.col("opens").cast("int")).over(upto) - 1))
    low_enough = F.filter("firsts", lambda f: F.col("_prev").isNull()
                          | (F.col("y") - F.col("_prev") > 0.5 * f["h"]))
    opener = F.when(F.col("opens"), F.array_min(F.transform(low_enough, lambda f: f["first"])))
    return numbered.select(
        *PAGE, "y", F.explode("bands").alias("_xb"), "line_no",
        F.col("_prev").isNull().alias("_page_top"), opener.alias("_opener"))


def assign_lines(regions: DataFrame, legacy_first_box: bool = False) -> DataFrame:
    """Add ``line_no`` (0-based) to every box.

    ``legacy_first_box`` leaves out the first box of each page, as the original rule did.
    """
    breaks = _line_breaks(regions)
    here = F.struct("x", "region_ord")
    before_opener = F.col("_opener").isNotNull() & (here < F.col("_opener"))
    lined = (regions.withColumn("_xb", _band()).join(breaks, PAGE + ["y", "_xb"])
             .withColumn("line_no", F.col("line_no") - before_opener.cast("int")))
    if legacy_first_box:
        lined = lined.filter(~(F.col("_page_top") & (here == F.col("_opener"))))
    return lined.drop("_xb", "_page_top", "_opener")


def _word_runs(regions: DataFrame, legacy_first_box: bool, *extra: Column) -> DataFrame:
    """Words of one line, y and x band joined: the unit the page text is put together from."""
    lined = assign_lines(regions, legacy_first_box).withColumn("_xb", _band())
    words = F.sort_array(F.collect_list(F.struct("x", "region_ord", "text")))
    return lined.groupBy(*PAGE, "y", "_xb", "line_no").agg(
        F.array_join(words["text"], " ").alias("text"), *extra)


def _page_text(runs: Column) -> Column:
    """Sorted runs of a page as text: a space inside a line, a newline between lines."""
    def lead(run, i):
        same_line = F.get(runs, i - 1)["line_no"] == run["line_no"]
        glue = F.when(i == 0, "").when(same_line, " ").otherwise("\n")
        return F.concat(glue, run["text"])
    return F.array_join(F.transform(runs, lead), "")


def _sorted_runs(*lead: str) -> Column:
    return F.sort_array(F.collect_list(F.struct(*lead, "y", "_xb", "text")))


def line_texts(regions: DataFrame, legacy_first_box: bool = False) -> DataFrame:
    """One row per line: (doc_id, page_number, line_no, line_text)."""
    return (_word_runs(regions, legacy_first_box).groupBy(*PAGE, "line_no")
            .agg(F.array_join(_sorted_runs()["text"], " ").alias("line_text")))


def assemble_text(regions: DataFrame, legacy_first_box: bool = False) -> DataFrame:
    """One row per page that has boxes: (doc_id, page_number, full_text)."""
    joined = _word_runs(regions, legacy_first_box).groupBy(*PAGE).agg(
        _sorted_runs("line_no").alias("_runs"))
    return joined.select(*PAGE, _page_text(F.col("_runs")).alias("full_text"))


def page_confidence(regions: DataFrame) -> DataFrame:
    """Mean detector confidence and number of boxes per page."""
    return regions.groupBy(*PAGE).agg(
        F.avg("confidence").alias("confidence"), F.count("*").alias("num_regions"))


def _recognized_pages(regions: DataFrame, legacy_first_box: bool) -> DataFrame:
    if legacy_first_box:  # the box left out of the text still counts
        return assemble_text(regions, True).join(page_confidence(regions), PAGE, "full")
    runs = _word_runs(regions, False, F.sum("confidence").alias("_sum"), F.count("*").alias("_n"))
    pages = runs.groupBy(*PAGE).agg(
        _sorted_runs("line_no").alias("_runs"),
        (F.sum("_sum") / F.sum("_n")).alias("confidence"), F.sum("_n").alias("num_regions"))
    return pages.select(*PAGE, _page_text(F.col("_runs")).alias("full_text"),
                        "confidence", "num_regions")


def page_results(pages: DataFrame, regions: DataFrame, legacy_first_box: bool = False) -> DataFrame:
    """One row per page, also pages without boxes, which give "", 0.0 and 0.

    ``regions`` are boxes that passed ``gate_recognition``.
    """
    results = pages.select(*PAGE).join(_recognized_pages(regions, legacy_first_box), PAGE, "left")
    return results.select(
        *PAGE,
        F.coalesce("full_text", F.lit("")).alias("full_text"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("num_regions", F.lit(0)).alias("num_regions"))


def page_measures(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """``page_results`` without the text, for roll-ups that never read it."""
    return (pages.select(*PAGE).join(page_confidence(regions), PAGE, "left")
            .select(*PAGE, F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
                    F.coalesce("num_regions", F.lit(0)).alias("num_regions")))


def document_summary(results: DataFrame) -> DataFrame:
    """Pages, boxes and the unweighted mean of page confidence per document."""
    return results.groupBy("doc_id").agg(
        F.count("*").alias("total_pages"),
        F.sum("num_regions").alias("total_regions"),
        F.avg("confidence").alias("avg_confidence"))


def summary_cube(results: DataFrame, documents: DataFrame) -> DataFrame:
    """The summary measures by language and source, with all subtotals."""
    joined = results.join(documents.select("doc_id", "lang", "source"), "doc_id")
    return joined.cube("lang", "source").agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("total_pages"),
        F.sum("num_regions").alias("total_regions"),
        F.avg("confidence").alias("avg_confidence"))


def with_failures(sources: DataFrame, results: DataFrame, keys: list[str], stage: str) -> DataFrame:
    """Every source keeps a row; one without a result is marked by the failing stage's rule.

    ``page`` gives an empty result and the step list ``["failed"]``, ``document`` a null
    result, ``preprocess`` the input itself with ``["failed_fallback"]``.
    """
    steps = {"page": ["failed"], "document": None, "preprocess": ["failed_fallback"]}
    if stage not in steps:
        raise ValueError(f"unknown stage: {stage}")
    joined = sources.join(results.withColumn("_ok", F.lit(True)), keys, "left")
    failed = F.col("_ok").isNull()
    marked = joined.withColumn("status", F.when(failed, "failed").otherwise("ok"))
    if steps[stage] is None:
        return marked.withColumn("steps", F.lit(None).cast("array<string>")).drop("_ok")
    marked = marked.withColumn(
        "steps", F.when(failed, F.array(*map(F.lit, steps[stage]))).otherwise(F.array().cast("array<string>")))
    if stage == "page":
        empty = {"full_text": "", "confidence": 0.0, "num_regions": 0}
        for name, value in empty.items():
            if name in results.columns:
                marked = marked.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return marked.drop("_ok")
