"""One file per document: whole, in order, all or none."""

import csv
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from pagewright.functions.errors import ExportError
from pagewright.operators import reading as R
from pagewright.plans import fixtures as fx
from pagewright.plans.reading_queries import kept, results
from pagewright.sources import document_files as D, sinks


def files(path):
    return sorted(p.name for p in pathlib.Path(path).iterdir() if not p.name.startswith("."))


def test_lines_in_order_one_file_each(spark, tmp_path):
    rows = spark.range(5000).select(F.concat(F.lit("d"), (F.col("id") % 40).cast("string"), F.lit(".txt")).alias("output"),
                                    F.col("id").alias("n"), F.concat(F.lit("line é "), F.col("id").cast("string")).alias("value"))
    rows = rows.union(spark.createDataFrame([("empty.txt", 0, None)], "output string, n long, value string"))
    path = D.write_document_files(rows.repartition(7), str(tmp_path / "out"), ["n"])
    assert files(path) == sorted(["_SUCCESS", "empty.txt", *[f"d{i}.txt" for i in range(40)]])
    for i in range(40):
        assert (tmp_path / f"out/d{i}.txt").read_text() == "".join(f"line é {n}\n" for n in range(i, 5000, 40))
    assert (tmp_path / "out/empty.txt").read_text() == ""
    D.write_document_files(rows.filter("output = 'd1.txt'"), path, ["n"])  # overwrites the folder
    assert files(path) == ["_SUCCESS", "d1.txt"]
    D.write_document_files(rows.filter("output = 'd2.txt'"), path, ["n"], overwrite=False)
    assert files(path) == ["_SUCCESS", "d1.txt", "d2.txt"]


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    fail = F.when(F.col("id") == 900, F.raise_error(F.lit("broken row"))).otherwise("x")
    rows = spark.range(1000).repartition(4).select(F.concat(F.lit("d"), (F.col("id") % 9).cast("string")).alias("output"),
                                                   F.col("id").alias("n"), F.concat(fail, F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="broken row"):
        D.write_document_files(rows, str(tmp_path / "out"), ["n"])
    assert not (tmp_path / "out").exists() or files(tmp_path / "out") == []


@pytest.mark.parametrize("name", ["../up.txt", "a/b", "", ".hidden", None])
def test_names_stay_in_the_folder(spark, tmp_path, name):
    rows = spark.createDataFrame([(name, 1, "x")], "output string, n int, value string")
    with pytest.raises(Exception, match="not a file name"):
        D.write_document_files(rows, str(tmp_path / "out"), ["n"])
    assert not list(tmp_path.rglob("*.txt")) and not (tmp_path / "up.txt").exists()


def test_a_document_in_two_tasks_is_refused(spark, tmp_path):
    spark.dataSource.register(D.DocumentFiles)
    rows = spark.createDataFrame([("a", "1"), ("a", "2")], D.SCHEMA).repartition(2)
    with pytest.raises(Exception, match="more than one piece"):
        rows.write.format(D.NAME).mode("append").save(str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or files(tmp_path / "out") == []


def test_only_the_reported_attempt_is_moved(tmp_path):
    """A task that ran twice, the first time without being reported."""
    import pyarrow as pa

    writer = D.DocumentWriter(str(tmp_path / "out"), False, "\n")
    batch = lambda v: iter([pa.RecordBatch.from_pydict({"output": ["a", "a"], "value": [v, "end"]})])
    lost = writer.write(batch("first"))
    pathlib.Path(lost.folder).rename(lost.folder + "-lost")
    again = writer.write(batch("second"))
    writer.commit([again, None])
    assert files(tmp_path / "out") == ["_SUCCESS", "a"] and (tmp_path / "out/a").read_text() == "second\nend\n"


@pytest.mark.parametrize("fmt", ["txt", "json", "csv"])
def test_exports_of_the_given_tables(spark, sf, tmp_path, fmt):
    pages, boxes = results(spark, sf).filter("doc_id < 12"), kept(spark, sf).filter("doc_id < 12")
    names = pages.select("doc_id").distinct().select("doc_id", F.format_string(f"doc%d.{fmt}", "doc_id").alias("output"))
    path = sinks.export_files(pages, boxes, names, str(tmp_path / fmt), fmt)
    want = {r["doc_id"]: r["n"] for r in pages.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert files(path) == sorted(["_SUCCESS", *[f"doc{d}.{fmt}" for d in want]])
    texts = {r["doc_id"]: r["full_text"] for r in pages.filter("page_number = 1").collect()}
    regions = {r["doc_id"]: r["n"] for r in boxes.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for d, n in want.items():
        text = (tmp_path / fmt / f"doc{d}.{fmt}").read_text()
        if fmt == "json":
            whole = json.loads(text)
            assert len(whole["pages"]) == n and whole["pages"][0]["full_text"] == texts[d]
        elif fmt == "csv":
            rows = list(csv.reader(text.splitlines()))
            assert rows[0][:3] == ["Page", "Region_ID", "Text"] and len(rows) == 1 + regions.get(d, 0)
        else:
            assert texts[d] in text


def test_registers_as_a_format(spark, sf, tmp_path):
    """A user's exporter over the data source takes part in the dispatcher."""
    def write(pages, boxes, path):
        names = pages.select("doc_id").distinct().select("doc_id", F.format_string("%d.md", "doc_id").alias("output"))
        D.write_document_files(pages.join(names, "doc_id").select(
            "output", "page_number", F.concat(F.lit("# "), F.col("full_text")).alias("value")), path, ["page_number"])

    sinks.register_writer("md", write)
    try:
        pages = results(spark, sf).filter("doc_id < 3")
        sinks.export(pages, kept(spark, sf), str(tmp_path / "md"), "md")
    finally:
        del sinks.WRITERS["md"]
    assert files(tmp_path / "md") == ["0.md", "1.md", "2.md", "_SUCCESS"]


def test_files_are_read_back_by_their_lists(spark, tmp_path, monkeypatch):
    """Every file whole, over several writes of one folder; the driver takes a few names at a time and lists no folder of documents."""
    monkeypatch.setattr(D, "STEP", 3)
    rows = lambda lo, hi, text: spark.range(lo, hi).select(
        F.format_string("d%d.txt", F.col("id")).alias("output"), F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), F.lit(text).alias("value"))
    path = D.write_document_files(rows(0, 40, "é one").repartition(5), str(tmp_path / "out"), ["n"])
    D.write_document_files(rows(30, 50, "two"), path, ["n"], overwrite=False)  # ten are replaced, ten are new
    (tmp_path / "out" / "notes.md").write_text("not of the writer's")
    got = D.read_document_files(spark, path).collect()
    assert {r["output"]: r["value"] for r in got} == {f"d{i}.txt": "é one\né one\n" if i < 30 else "two\ntwo\n" for i in range(50)}
    assert len(got) == 50
    D.write_document_files(rows(7, 9, "three"), path, ["n"])
    assert files(path) == ["_SUCCESS", "d7.txt", "d8.txt"]
    assert sorted(tuple(r) for r in D.read_document_files(spark, path).collect()) == [(f"d{i}.txt", "three\nthree\n") for i in (7, 8)]
    (tmp_path / "out" / "d7.txt").unlink()
    with pytest.raises(Exception, match="d7.txt"):
        D.read_document_files(spark, path).collect()


def test_the_driver_is_told_of_no_names(tmp_path):
    import pickle

    import pyarrow as pa

    writer = D.DocumentWriter(str(tmp_path / "out"), True, "\n")
    batch = pa.RecordBatch.from_pydict({"output": [f"document-{i}" for i in range(3000)], "value": ["x"] * 3000})
    told = writer.write(iter([batch]))
    assert len(pickle.dumps(told)) < 1000
    writer.commit([told])
    assert len(files(tmp_path / "out")) == 3001


def test_runs_of_lines_in_sliced_batches(tmp_path):
    import pyarrow as pa

    writer = D.DocumentWriter(str(tmp_path / "out"), True, "|")
    whole = pa.RecordBatch.from_pydict({"output": ["a", "a", "b", "b", "c"], "value": ["é", None, "", "2", "3"]})
    writer.commit([writer.write(iter([whole.slice(0, 1), whole.slice(1, 2), whole.slice(3, 0), whole.slice(3, 2)]))])
    assert {n: (tmp_path / "out" / n).read_text() for n in "abc"} == {"a": "é|", "b": "|2|", "c": "3|"}


def test_records_of_csv_files_with_odd_words(spark, tmp_path):
    """Read back by their lists as a reader of CSV files finds them."""
    from pagewright.plans.reading_queries import _csv_rows

    odd = ['a,b', 'say "x"', 'back\\slash', 'end\\', '"', '\\"', 'two\nlines', 'a\rb', ' space ', "é", '"q", \\ "r"\n\n"', "#x", "plain"]
    boxes = spark.createDataFrame([(d, 1, i, t, 0.5, 1, 2, 3, 4) for d in (1, 2) for i, t in enumerate(odd * d)],
                                  "doc_id long, page_number int, region_ord long, text string, confidence double, x int, y int, w int, h int")
    names = boxes.select("doc_id").distinct().select("doc_id", F.format_string("doc%d.csv", "doc_id").alias("output"))
    path = sinks.export_files(None, boxes, names, str(tmp_path / "out"), "csv")
    kinds = "Page int, Region_ID long, Text string, Confidence string, X int, Y int, Width int, Height int"
    plain = spark.read.schema(kinds).csv(path, header=True, multiLine=True, escape="\\", pathGlobFilter="doc*").select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "*")
    want = sorted(map(str, plain.collect()))
    assert sorted(map(str, _csv_rows(spark, path, kinds).collect())) == want and len(want) == 3 * len(odd)
