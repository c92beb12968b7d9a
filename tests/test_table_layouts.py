"""Queries give the same rows whether a table is one file or a folder of part files."""

import pytest

import __spark_entry__ as entry_points

TABLES = ["documents", "events", "pages"]
STREAMS = sorted(n for n in entry_points.queries() if n.startswith("h"))


@pytest.fixture(scope="module")
def parts(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("parts"))
    for name in TABLES:
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(4).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", STREAMS)
def test_streams_read_folder_tables(spark, sf, parts, name):
    query = entry_points.queries()[name]
    rows = lambda folder: sorted(map(repr, query(spark, folder).collect()))
    assert rows(parts) == rows(sf) != []
