"""Each op query with SQL against that SQL; the others run and give one row per input row."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry_points
from pagewright.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for file in pathlib.Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    want = con.execute(queries.ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    rows = sorted(repr([r[[d[0] for d in want.description].index(c)] for c in columns]) for r in want.fetchall())
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == columns
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == rows


def test_all_are_registered():
    names = entry_points.queries()
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op1_quality", "op2_token_files", "op8_token_counts", "op10_source_mix"])
def test_one_row_a_document(spark, sf, name):
    ids = sorted(r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    assert sorted(r["doc_id"] for r in queries.QUERIES[name](spark, sf).collect()) == ids
