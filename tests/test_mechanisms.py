"""Boxes without common keys, stored sketches, stored purges, lists as tables, models per worker."""

import datetime as dt
import os
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import intake, layout as L, lists, metering as M
from pagewright.operators.decode import apply_recognizer

BOXES = "doc_id long, page_number int, region_ord long, x int, y int, w int, h int, text string, source string"


def greedy(truth, output):
    """Pairs one by one in falling order of overlap, over all pairs of a page."""
    area = lambda a, b: max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])) * max(0, min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]))
    pairs = sorted((-area(a, b), a[2], b[2], a[:2]) for a in truth for b in output if a[:2] == b[:2] and area(a, b))
    used, out = set(), []
    for overlap, t, o, page in pairs:
        if ("t", page, t) not in used and ("o", page, o) not in used:
            used |= {("t", page, t), ("o", page, o)}
            out.append((*page, t, o, -overlap))
    return sorted(out)


@pytest.mark.parametrize("seed,cell", [(1, 128), (2, 7)])
def test_boxes_are_matched_as_one_by_one(spark, monkeypatch, seed, cell):
    monkeypatch.setattr(L, "CELL", cell)
    rng = random.Random(seed)
    some = lambda start: [(rng.randrange(3), 1, start + i, rng.randrange(-40, 300), rng.randrange(0, 90), rng.randrange(0, 60), rng.randrange(1, 25),
                           f"w{i}", "s") for i in range(120)]
    truth, output = some(0), some(5000)
    truth += [(7, 1, 1, 0, 0, 10, 10, "alone", "s"), (8, 1, 1, 0, 0, 900, 900, "huge", "s"), (8, 1, 2, 0, 0, 10, 10, "same", "s")]
    output += [(8, 1, 3, 0, 0, 10, 10, "same", "s"), (8, 1, 4, 5, 5, 10, 10, "x", "s"), (9, 1, 1, 0, 0, 5, 5, "invented", "s")]
    got = L.match_boxes(spark.createDataFrame(truth, BOXES), spark.createDataFrame(output, BOXES))
    assert sorted(map(tuple, got.collect())) == greedy(truth, output)


def test_accuracy_counts_missed_and_invented(spark):
    truth = [(1, 1, 1, 0, 0, 50, 10, "hello", "a"), (1, 1, 2, 60, 0, 50, 10, "world", "a"), (1, 1, 3, 120, 0, 50, 10, "lost", "a")]
    output = [(1, 1, 8, 2, 1, 50, 10, "hello", "a"), (1, 1, 9, 58, 0, 50, 10, "w0rld", "a"), (1, 1, 7, 500, 0, 50, 10, "ghost", "a"), (2, 1, 7, 0, 0, 5, 5, "x", "b")]
    got = {r["source"]: r for r in L.box_accuracy(spark.createDataFrame(truth, BOXES), spark.createDataFrame(output, BOXES), ["source"]).collect()}
    a = got["a"]
    assert (a.words, a.matched, a.missed, a.invented) == (3, 2, 1, 1)
    assert a.char_accuracy == pytest.approx(1 - 10 / 19) and a.word_accuracy == pytest.approx(1 / 3)
    assert (got["b"].words, got["b"].invented, got["b"].word_accuracy) == (0, 1, None)
    assert L.match_boxes(spark.createDataFrame(truth, BOXES), spark.createDataFrame([], BOXES)).count() == 0


def test_boxes_without_a_number_are_in_no_pair(spark):
    truth = spark.createDataFrame([(1, 1, None, 0, 0, 9, 9, "a", "s"), (1, 1, 2, 0, 0, 9, 9, "b", "s")], BOXES)
    output = spark.createDataFrame([(1, 1, 5, 0, 0, 9, 9, "b", "s")], BOXES)
    assert [tuple(r) for r in L.match_boxes(truth, output).collect()] == [(1, 1, 2, 5, 81)]
    assert L.match_boxes(truth.filter("region_ord is null"), output).count() == 0
    got = L.box_accuracy(truth, output, ["source"]).first()
    assert (got.words, got.matched, got.missed, got.invented) == (2, 1, 1, 0)


def test_a_dense_page_makes_few_pairs(spark):
    """A page with a third of all boxes: pairs met grow with the boxes, not with their square."""
    boxes = [(1, 1, i, 60 * (i % 100), 20 * (i // 100), 50, 12, "t", "s") for i in range(4000)]
    truth = spark.createDataFrame(boxes, BOXES)
    output = truth.withColumns({"region_ord": F.col("region_ord") + 9000, "x": F.col("x") + 2})
    met = L._in_cells(truth, "t").join(L._in_cells(output, "o"), ["doc_id", "page_number", "_cx", "_cy"]).count()
    assert met < 150 * len(boxes) and L.match_boxes(truth, output).count() == len(boxes)


def test_sketches_of_days_merge_to_any_range(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, dt.datetime(2024, 1, 1 + i % 9, 5), rng.lognormvariate(0, 2)) for i in range(20_000) for k in ("a", "b") if k == "a" or i % 10 == 0]
    rows += [("a", dt.datetime(2024, 1, 2), None), ("none", dt.datetime(2024, 1, 2), None)]
    events = spark.createDataFrame(rows, "kind string, ts timestamp, latency double").repartition(5)
    M.latency_sketches(events, ["kind"], k=200).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert stored.count() == 18
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    got = {r["kind"]: r for r in M.sketch_percentiles(stored, ["kind"], shares, "2024-01-03", "2024-01-07").collect()}
    exact = {r["kind"]: r for r in M.exact_percentiles(events.filter("ts BETWEEN '2024-01-03' AND '2024-01-08'"), ["kind"], "latency", shares).collect()}
    for kind in ("a", "b"):
        values = sorted(v for k, t, v in rows if k == kind and 3 <= t.day <= 7)
        assert got[kind]["n"] == len(values)
        for name, share in shares.items():
            for one in (got, exact):
                rank = sum(v <= one[kind][name] for v in values) / len(values)
                assert abs(rank - share) < (0.02 if one is got else 0.002)
    plan = M.sketch_percentiles(stored, ["kind"], shares)._jdf.queryExecution().executedPlan().toString()
    assert "latency" not in plan and plan.count("FileScan") == 1


def test_purge_leaves_untouched_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "jobs")
    rows = [(i, f"d{i % 5}" if i % 11 else None, f"job {i}") for i in range(100)] + [(500, "only one", "x"), (501, "a=b/c", "y")]
    spark.createDataFrame(rows, "job_id long, day string, note string").write.partitionBy("day").parquet(path)
    files = lambda: {str(p.relative_to(path)): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*.parquet")}
    before = files()
    ids = spark.createDataFrame([(1,), (6,), (0,), (500,), (501,), (7777,), (None,), (6,)], "job_id long")
    report = {r["job_id"]: r["found"] for r in M.purge_stored(spark, path, ids).collect()}
    assert report == {1: True, 6: True, 0: True, 500: True, 501: True, 7777: False}
    left = {tuple(r) for r in spark.read.parquet(path).select("job_id", "day", "note").collect()}
    assert left == {r for r in rows if r[0] not in (0, 1, 6, 500, 501)}
    after = files()
    same = [f for f in before if f.startswith(("day=d0", "day=d2", "day=d3", "day=d4"))]
    assert same and all(after[f] == before[f] for f in same)
    assert not [f for f in after if "only one" in f or "a%3D" in f]
    again = M.purge_stored(spark, path, ids)
    assert not again.filter("found").count() and files() == after


def test_lists_as_tables(spark):
    files = spark.createDataFrame([(1, "a.pdf"), (2, "b.xyz"), (3, "c.PDF"), (4, None), (5, "noext")], "file_id long, path string")
    allowed = spark.createDataFrame([(".pdf",), (".pdf",), (None,)], "ext string")
    ids = lambda df: sorted(r["file_id"] for r in df.collect())
    assert ids(intake.with_extensions(files, allowed)) == [1, 3]
    assert ids(intake.with_extensions(files, allowed, keep=False)) == [2, 4, 5]
    assert ids(intake.with_extensions(files, allowed.limit(0))) == [] and ids(intake.with_extensions(files, allowed.limit(0), False)) == [1, 2, 3, 4, 5]


def test_a_long_list_is_not_broadcast(spark):
    rows = spark.range(1000).withColumn("_listed", F.lit("own")).withColumn("code", F.when(F.col("id") % 3 > 0, F.col("id") * 1000))
    listed = spark.range(0, 1_000_000).select(F.col("id").alias("code"))
    for keep, want in ((True, 666), (False, 334)):
        df = lists.by_list(rows, "code", listed, keep)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert df.columns == rows.columns and df.count() == want
    small = lists.by_list(rows, "code", listed.limit(10))
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()


def test_a_model_is_loaded_once_per_worker_and_batches_are_full(spark, tmp_path):
    log = str(tmp_path)

    def load():
        with open(f"{log}/loads", "a") as f:
            f.write(f"{os.getpid()}\n")

        def model(batch):
            with open(f"{log}/sizes", "a") as f:
                f.write(f"{len(batch)}\n")
            if (batch["id"] == 77).any():
                raise ValueError("one bad row")
            return [(f"r{i}", 0.5, []) for i in batch["id"]]
        return model

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = apply_recognizer(spark.range(0, 400, 1, 16), load, 8).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["id"]: r["text"] for r in rows} == {i: "" if i == 77 else f"r{i}" for i in range(400)}
    loads = (tmp_path / "loads").read_text().split()
    assert len(loads) == len(set(loads)) < 16  # 16 tasks
    sizes = list(map(int, (tmp_path / "sizes").read_text().split()))
    assert sizes.count(8) >= 16 * 3 and max(sizes) == 8  # 25 rows a task, arriving by fives


def test_wide_rows_and_the_rest(spark):
    pairs = [(1, 1, 0, "Total", "10"), (1, 1, 3, "Total", "later"), (1, 2, 0, "Rare `one`", "x"), (2, 1, 0, "Total", "20"), (2, 1, 1, "Tax", "2"),
             (3, 1, 0, "Tax", "3"), (3, 1, 1, "rest", "own"), (3, 1, 2, "DOC_ID", "7"), (3, 1, 4, "total", "30")]
    table = spark.createDataFrame(pairs, "doc_id long, page_number int, line_no int, key string, value string").repartition(3)
    assert L.wide_keys(table, 2) == ["Tax", "Total"]
    rows = {r["doc_id"]: r for r in L.wide_key_values(table, most=2).withColumn("rest", F.col("rest").cast("string")).collect()}
    assert {d: (r["Total"], r["Tax"], r["rest"]) for d, r in rows.items()} == {
        1: ("10", None, '{"Rare `one`":"x"}'), 2: ("20", "2", None), 3: (None, "3", '{"DOC_ID":"7","rest":"own","total":"30"}')}
    every = L.wide_key_values(table)
    assert set(every.columns) == {"doc_id", "Total", "Tax", "Rare `one`", "rest"}
    assert L.wide_key_values(table.limit(0)).count() == 0
