"""Rows dealt out by their document are moved once, whatever is made of them."""

import pathlib

import pytest
from pyspark.sql import functions as F

from pagewright.plans import catalog, fixtures as fx
from pagewright.session import ensure_checkpoint_dir
from pagewright.sources import sinks
from pagewright.sources.document_files import document_rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("dealt"))
    texts = [(d, "\n".join(f"w{d} a{i} some more{i} words" for i in range(60 + d)), "en", "web", 1) for d in range(12)]
    spark.createDataFrame(texts + texts[:2] + [(50, None, "en", "web", 0)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(o, n, o * 7 + n, n, 1.0 * n, 2.0) for o in range(20) for n in range(4)],
                          "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double"
                          ).write.parquet(f"{path}/lineitem.parquet")
    return path


def exchanges(df):
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    return [line.strip(" :+-") for line in plan.splitlines() if "Exchange " in line and "Reused" not in line and "Broadcast" not in line]


@pytest.mark.parametrize("name", [
    "f2_export_json", "f2_json_pages", "f11_api_response", "d9_decode_with_lengths", "d3_ctc_collapse", "d3_ctc_keep_repeats",
    "i7_merge_regions", "i9_apply_corrections", "d6_slice_batches", "f5_pdf_line_layout", "f1_export_txt", "f4_word_blocks",
    "i1_detect_columns", "i2_detect_tables"])
def test_only_dealt_rows_are_moved(spark, folder, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = exchanges(catalog.QUERIES[name](spark, folder))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moved and all("REPARTITION_BY_NUM" in m or "documents" in m or "ENSURE" in m and name == "f11_api_response" for m in moved), moved


@pytest.mark.parametrize("name,joins", [("i1_detect_columns", 1), ("d6_slice_batches", 0)])
def test_dealt_rows_are_ranked_in_place(spark, folder, name, joins):
    df = catalog.QUERIES[name](spark, folder)
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert plan.count("Join [") == joins, plan


def test_box_matching_moves_only_dealt_rows(spark, folder):
    """Pairs of the first round are neither moved nor written."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    kept = pathlib.Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    tables = set(kept.glob("step-*"))
    try:
        df = catalog.QUERIES["i10_box_accuracy"](spark, folder)
        moved = exchanges(df)
        assert moved and all("REPARTITION_BY_NUM" in m or "hashpartitioning(source" in m for m in moved), moved
        got = {r["source"]: r["invented"] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    written = [spark.read.parquet(str(t)).count() for t in set(kept.glob("step-*")) - tables]
    assert written == [0], written
    assert got == {"web": 15}  # one a row of the table


def test_parts_grow_with_the_files(spark, folder, monkeypatch):
    least = fx.dealt(spark, folder, "documents", "doc_id", "text").rdd.getNumPartitions()
    monkeypatch.setattr(fx, "PART_BYTES", 100)
    assert fx.dealt(spark, folder, "documents", "doc_id", "text").rdd.getNumPartitions() > least


def test_document_lines_stay_with_their_document(spark):
    rows = spark.range(40).select((F.col("id") % 4).alias("doc_id"), F.col("id").alias("n"), F.col("id").cast("string").alias("value"))
    rows = rows.repartition(3, "doc_id").withColumn("output", F.format_string("doc%d", "doc_id"))
    assert len(exchanges(document_rows(rows, ["n"], ("doc_id", "output")))) == 1
    for key in (("output",), ("doc_id", "output")):
        got = {}
        for r in document_rows(rows, ["n"], key).collect():
            got.setdefault(r["output"], []).append(int(r["value"]))
        assert got == {f"doc{d}": list(range(d, 40, 4)) for d in range(4)}


def test_documents_that_share_a_name(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, "one", 0.5, 1), (2, 1, "two", 0.5, 1), (3, 1, "three", 0.5, 1)],
                                  "doc_id long, page_number int, full_text string, confidence double, num_regions long")
    names = spark.createDataFrame([(1, "a.txt"), (2, "a.txt"), (3, "b.txt")], "doc_id long, output string")
    sinks.export_files(pages, None, names, str(tmp_path / "out"), "txt")
    assert "one" in (tmp_path / "out/a.txt").read_text() and "two" in (tmp_path / "out/a.txt").read_text()
    assert "three" in (tmp_path / "out/b.txt").read_text()
