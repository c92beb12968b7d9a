"""Connected components against a plain flood fill."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry
from pagewright.operators import components as C


def cells(spark, grids):
    rows = [(page, x, y, 0.9, 0.0) for page, grid in grids.items()
            for y, line in enumerate(grid) for x, c in enumerate(line) if c == "#"]
    return spark.createDataFrame(
        rows, "page_id long, x int, y int, region_score double, affinity_score double").repartition(3)


def flood(grid):
    todo = {(y, x) for y, line in enumerate(grid) for x, c in enumerate(line) if c == "#"}
    labels = {}
    while todo:
        start = min(todo)
        stack = [start]
        todo.discard(start)
        while stack:
            y, x = stack.pop()
            labels[x, y] = start
            for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if n in todo:
                    todo.discard(n)
                    stack.append(n)
    return labels


SPIRAL = ["#########", "#.......#", "#.#####.#", "#.#...#.#", "#.#.###.#", "#.#.....#", "#.#######"]
SNAKE = ["######", ".....#", "######", "#.....", "######", ".....#", "######"]
CORNER = ["#.", ".#"]


@pytest.mark.parametrize("strip", [64, 3])
def test_labels_equal_flood_fill(spark, monkeypatch, strip):
    monkeypatch.setattr(C, "STRIP", strip)
    rng = random.Random(strip)
    grids = {1: SPIRAL, 2: SNAKE, 3: CORNER, 4: ["#"]}
    for page in range(5, 12):
        grids[page] = ["".join(rng.choice(".##") for _ in range(20)) for _ in range(15)]
    got = {(r.page_id, r.x, r.y): (r.label_y, r.label_x)
           for r in C.connected_components(cells(spark, grids)).collect()}
    want = {(page, x, y): label for page, grid in grids.items() for (x, y), label in flood(grid).items()}
    assert got == want


def test_no_edges_at_all(spark):
    boxes = C.component_boxes(cells(spark, {1: CORNER}), min_area=1, text_threshold=0.5).collect()
    assert sorted((b.x, b.y, b.w, b.h) for b in boxes) == [(0, 0, 1, 1), (1, 1, 1, 1)]


def test_bounds_of_mask_area_and_score(spark):
    df = spark.createDataFrame(
        [(1, 0, 0, 0.4, 0.0), (1, 5, 0, 0.4, 0.0001), (1, 9, 0, -1.0, 0.2)],
        "page_id long, x int, y int, region_score double, affinity_score double")
    assert [r.x for r in C.mask_cells(df).collect()] == [5]
    ten = cells(spark, {1: ["##########"], 2: ["#########"]})
    assert [r.page_id for r in C.component_boxes(ten).collect()] == [1]
    kept = [C.component_boxes(ten, text_threshold=t).count() for t in (0.5, 0.9, 0.95)]
    assert kept == [1, 1, 0]


def test_pages_without_regions_are_kept(spark):
    pages = spark.createDataFrame([(1,), (2,)], "page_id long")
    from pyspark.sql import functions as F
    got = C.detect_regions(pages, cells(spark, {1: ["##########"]}), F.lit(2.0), F.lit(0.5)).collect()
    by_page = {r.page_id: r for r in got}
    assert by_page[2].points is None
    assert (by_page[1].points[2].x, by_page[1].points[2].y) == (5.0, 2.0)


def test_points_are_ordered_by_compiled_code(spark):
    """No lambda, which Spark interprets for every row; and the order of points with ties, nulls, too few or too many of them."""
    rng = random.Random(4)
    coordinate = lambda: rng.choice([None, 0.0, 1.0, 2.0, 3.5, -1.0])
    some = [[(coordinate(), coordinate()) for _ in range(n)] for n in [4] * 60 + [0, 1, 2, 3, 5, 6]] + [None]
    rows = spark.createDataFrame(list(enumerate(some)), "n long, points array<struct<x: double, y: double>>")
    ordered = rows.select("n", geometry.order_points(F.col("points")).alias("p"))
    assert "lambda" not in ordered._sc._jvm.PythonSQLUtils.explainString(ordered._jdf.queryExecution(), "simple")
    nulls_first = lambda values: [(v is not None, v or 0.0) for v in values]
    for n, got in ordered.collect():
        if some[n] is None:
            assert got is None
            continue
        by_y = sorted(some[n], key=lambda p: nulls_first((p[1], p[0])))
        top, bottom = (sorted(part, key=nulls_first) for part in (by_y[:2], by_y[2:4]))
        assert [tuple(p) for p in got] == top + bottom[::-1]
