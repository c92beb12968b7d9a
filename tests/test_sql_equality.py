"""Every registered query against its SQL, on whole tables."""

import datetime
import math
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry_points
from pagewright.plans import catalog

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def sql(sf, tmp_path_factory):
    con = duckdb.connect(config={"temp_directory": str(tmp_path_factory.mktemp("duckdb"))})
    con.execute("SET TimeZone = 'UTC'")
    for file in pathlib.Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, (bool, str)):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value) + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, sql, sf, name):
    got = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in got.collect()]
    if name not in ORACLES:
        assert got.columns
        return
    want = sql.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert _rows(got.columns, rows) == _rows(columns, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries()) >= set(QUERIES)


def test_flagship(spark):
    pages = entry_points.entry(spark)
    assert pages.columns == ["doc_id", "page_number", "full_text", "confidence", "num_regions"]
    assert pages.count() >= 200
    assert "array_join" in pages._jdf.queryExecution().executedPlan().toString()  # the text is put together
