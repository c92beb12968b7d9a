"""Reading order and line assembly against plain-Python folds."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import reading as R

COLUMNS = "doc_id long, page_number int, region_ord long, text string, x int, y int, w int, h int, " \
          "confidence double, rec_confidence double"


def boxes(spark, rows):
    return spark.createDataFrame(
        [(d, p, o, t, x, y, 10, h, 0.5, 0.9) for d, p, o, t, x, y, h in rows], COLUMNS)


def fold(page, legacy=False):
    """{region_ord: line} of one page's boxes, by the rule as written."""
    lines, line, start = {}, 0, None
    for i, (o, x, y, h) in enumerate(sorted(page, key=lambda b: (b[2], b[1], b[0]))):
        if start is None:
            start = y
            if legacy:
                continue
        elif abs(y - start) > 0.5 * h:
            line, start = line + 1, y
        lines[o] = line
    return lines


def lines_of(df):
    return {(r.doc_id, r.page_number, r.region_ord): r.line_no for r in df.collect()}


def test_start_of_line_is_sticky(spark):
    df = boxes(spark, [(1, 1, i, f"w{i}", 0, y, 10) for i, y in enumerate([0, 2, 20, 24, 26])])
    assert sorted(lines_of(R.assign_lines(df)).items()) == [
        ((1, 1, i), n) for i, n in enumerate([0, 0, 1, 1, 2])]


@pytest.mark.parametrize("band", [4096, 7])
def test_random_pages_equal_the_fold(spark, monkeypatch, band):
    monkeypatch.setattr(R, "BAND", band)
    rng = random.Random(band)
    rows = []
    for page in range(60):
        tall = rng.choice([3, 12, 40])
        for o in range(rng.choice([1, 2, 15, 60])):
            rows.append((page // 7, page % 7, o, f"w{o}", rng.randrange(40),
                         rng.randrange(rng.choice([5, 60])), rng.randrange(0, tall)))
    rng.shuffle(rows)
    by_page = {}
    for d, p, o, _, x, y, h in rows:
        by_page.setdefault((d, p), []).append((o, x, y, h))
    df = boxes(spark, rows).repartition(5)
    for legacy in (False, True):
        want = {(d, p, o): n for (d, p), b in by_page.items() for o, n in fold(b, legacy).items()}
        assert lines_of(R.assign_lines(df, legacy)) == want
    text = {(r.doc_id, r.page_number): r.full_text for r in R.assemble_text(df).collect()}
    for (d, p), page in by_page.items():
        lines = fold(page)
        words = {}
        for o, x, y, h in sorted(page, key=lambda b: (b[2], b[1], b[0])):
            words.setdefault(lines[o], []).append(f"w{o}")
        assert text[d, p] == "\n".join(" ".join(words[n]) for n in sorted(words))
    order = {(r.doc_id, r.page_number, r.region_ord): r.reading_pos for r in R.reading_order(df).collect()}
    for (d, p), page in by_page.items():
        ranked = sorted(page, key=lambda b: (b[2], b[1], b[0]))
        assert [order[d, p, b[0]] for b in ranked] == list(range(1, len(page) + 1))


def test_one_box_page(spark):
    df = boxes(spark, [(1, 1, 0, "only", 5, 5, 10)])
    pages = spark.createDataFrame([(1, 1), (1, 2)], "doc_id long, page_number int")
    now = {r.page_number: r for r in R.page_results(pages, df).collect()}
    assert (now[1].full_text, now[1].num_regions) == ("only", 1)
    assert (now[2].full_text, now[2].confidence, now[2].num_regions) == ("", 0.0, 0)
    old = {r.page_number: r for r in R.page_results(pages, df, legacy_first_box=True).collect()}
    assert (old[1].full_text, old[1].num_regions) == ("", 1)


def test_gate_keeps_the_threshold_itself(spark):
    df = spark.createDataFrame(
        [("a", 0.5), ("b", 0.4999), ("", 0.9), (None, 0.9)], "text string, rec_confidence double")
    assert [r.text for r in R.gate_recognition(df).collect()] == ["a"]


def test_batches_keep_every_box_in_order(spark, monkeypatch):
    monkeypatch.setattr(R, "BAND", 5)
    df = boxes(spark, [(1, 1, o, "w", 0, 0, 1) for o in range(19)])
    got = {r.region_ord: r.batch_no for r in R.slice_batches(df).collect()}
    assert got == {o: o // 8 for o in range(19)}


def test_failures_keep_every_source(spark):
    sources = spark.createDataFrame([(1,), (2,)], "file_id long")
    results = spark.createDataFrame([(1, "t", 0.5, 3)], "file_id long, full_text string, confidence double, num_regions long")
    page = {r.file_id: r for r in R.with_failures(sources, results, ["file_id"], "page").collect()}
    assert page[2].steps == ["failed"] and page[2].full_text == "" and page[1].steps == []
    doc = {r.file_id: r for r in R.with_failures(sources, results, ["file_id"], "document").collect()}
    assert doc[2].full_text is None and doc[2].status == "failed"
    with pytest.raises(ValueError):
        R.with_failures(sources, results, ["file_id"], "nowhere")


def test_hot_page_is_split_over_tasks(spark):
    """A page with most of all boxes: its boxes reach the join in many partitions."""
    hot = spark.range(60_000).select(
        F.lit(1).alias("doc_id"), F.lit(1).alias("page_number"), F.col("id").alias("region_ord"),
        F.lit("w").alias("text"), (F.col("id") * 60).cast("int").alias("x"),
        (F.col("id") % 3).cast("int").alias("y"), F.lit(10).alias("w"), F.lit(12).alias("h"),
        F.lit(0.5).alias("confidence"), F.lit(0.9).alias("rec_confidence"))
    lined = R.assign_lines(hot)
    assert lined.filter("line_no <> 0").count() == 0 and lined.count() == 60_000
    bands = hot.select("y", F.floor(F.col("x") / R.BAND)).distinct().count()
    assert bands > 2000
    assert len(R.assemble_text(hot).first().full_text) == 2 * 60_000 - 1
