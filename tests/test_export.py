"""Export shapes, writers, the facade and the command line."""

import datetime as dt
import json
import os
import pathlib

import pytest
from pyspark.sql import functions as F

from pagewright import Engine
from pagewright import __main__ as cli
from pagewright.config import Config
from pagewright.functions.errors import ExportError
from pagewright.operators import export_shapes as X
from pagewright.sources import sinks
from pagewright.sources.guarded import file_detector, file_reader

RESULT = "doc_id long, page_number int, full_text string, confidence double, num_regions long"


def lines(folder):
    return "".join(p.read_text() for p in sorted(pathlib.Path(folder).glob("part-*")))


@pytest.fixture(scope="module")
def tables(spark):
    results = spark.createDataFrame(
        [(1, 1, "a\nb", 0.5, 2), (1, 2, "", 0.0, 0), (2, 1, 'say "c"', 0.25, 1)], RESULT)
    regions = spark.createDataFrame(
        [(1, 1, 0, "a", 1, 2, 3, 4, 0.5), (1, 1, 1, "b", 1, 30, 3, 4, 0.5), (2, 1, 0, 'say "c"', 0, 0, 9, 9, 0.25)],
        "doc_id long, page_number int, region_ord long, text string, x int, y int, w int, h int, confidence double")
    return results, regions


def test_txt(tables, tmp_path):
    sinks.export(*tables, str(tmp_path / "t"), "txt")
    assert lines(tmp_path / "t") == "=== 1 ===\n--- Page 1 ---\na\nb\n\n--- Page 2 ---\n\n\n=== 2 ===\n" + 'say "c"\n\n'
    whole = {r.doc_id: r.content for r in X.export_txt(tables[0]).collect()}
    assert whole[2] == 'say "c"\n\n' and whole[1].startswith("--- Page 1 ---\n")
    sinks.write_txt(*tables, str(tmp_path / "d"), per_document=True)
    assert lines(tmp_path / "d" / "doc_id=2") == 'say "c"\n\n'


def test_json(tables, tmp_path):
    sinks.export(*tables, str(tmp_path / "j"), "json")
    rows = [json.loads(line) for line in lines(tmp_path / "j").splitlines()]
    assert [(r["document"], r["page"]["page_number"]) for r in rows] == [("1", 1), ("1", 2), ("2", 1)]
    assert rows[0]["page"]["text_regions"][1] == {
        "text": "b", "confidence": 0.5, "bounding_box": {"x": 1, "y": 30, "width": 3, "height": 4},
        "points": [[1.0, 30.0], [4.0, 30.0], [4.0, 34.0], [1.0, 34.0]]}
    whole = {r.doc_id: json.loads(r.document) for r in X.export_json(*tables).collect()}
    assert whole[1]["total_pages"] == 2 and whole[2]["pages"][0]["full_text"] == 'say "c"'


def test_api_response_links_only_other_formats(spark, tables):
    jobs = spark.createDataFrame([(1, "j1"), (2, "j2")], "doc_id long, job_id string")
    plain = json.loads(X.api_response(*tables, jobs).filter("doc_id = 2").first().response)
    assert plain["download_url"] is None and "points" not in plain["pages"][0]["text_regions"][0]
    linked = json.loads(X.api_response(*tables, jobs, "txt").filter("doc_id = 2").first().response)
    assert linked["download_url"] == "/download/j2/j2.txt"


def test_csv(spark, tables, tmp_path):
    sinks.export(*tables, str(tmp_path / "c"), "csv")
    rows = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "c"))
    assert rows.columns == ["doc_id", "Page", "Region_ID", "Text", "Confidence", "X", "Y", "Width", "Height"]
    assert {(r.doc_id, r.Region_ID, r.Confidence) for r in rows.collect()} == {
        ("1", "1", "0.500"), ("1", "2", "0.500"), ("2", "1", "0.250")}


def test_layout_rows(spark, tables, tmp_path):
    for fmt in ("docx", "pdf"):
        sinks.export(*tables, str(tmp_path / fmt), fmt)
        assert spark.read.parquet(str(tmp_path / fmt)).count() > 0
    kinds = [r.kind for r in X.word_blocks(tables[0]).filter("doc_id = 1").orderBy("page_number", "block_no").collect()]
    assert kinds == ["title", "paragraph", "paragraph", "heading", "measures", "text", "page_break",
                     "heading", "measures", "no_text"]


@pytest.mark.parametrize("n, over", [(49, 0), (50, 1)])
def test_sheet_holds_49_lines(spark, n, over):
    results = spark.createDataFrame([(1, 1, "\n".join("x" * n), 1.0, 1)], RESULT)
    rows = X.pdf_text_layout(results)
    assert rows.filter("overflow").count() == over
    assert rows.filter("line_no = 48").first().y == 800
    assert X.pdf_text_layout(results, legacy=True).count() == 50


def test_unknown_format_and_extension_point(tables, tmp_path):
    with pytest.raises(ExportError, match="Unsupported export format"):
        sinks.export(*tables, str(tmp_path), "xls")
    seen = []
    sinks.register_writer("count", lambda results, regions, path: seen.append(results.count()))
    try:
        sinks.export(*tables, "nowhere", "count")
    finally:
        del sinks.WRITERS["count"]
    assert seen == [3]


def test_searchable_needs_sizes(tables, tmp_path):
    with pytest.raises(ExportError, match="page sizes"):
        sinks.export(*tables, str(tmp_path), "searchable_pdf")
    sized = tables[0].withColumns({c: F.lit(100) for c in
                                   ("image_width", "image_height", "sheet_width", "sheet_height")})
    sinks.export(sized, tables[1], str(tmp_path / "s"), "searchable_pdf")


def test_names_and_collisions(spark):
    df = spark.createDataFrame([("/in/a.pdf",), ("/in/a.png",), ("/in/b.pdf",)], "path string")
    named = df.withColumn("output", X.output_name("path", F.lit("txt")))
    assert [(r.output, r.files) for r in X.output_collisions(named).collect()] == [("a.txt", 2)]
    single = df.select(X.output_name("path", F.lit("json"), "single")).first()[0]
    assert single == "/in/a_ocr.json"
    with pytest.raises(ValueError):
        X.output_name("path", F.lit("txt"), "other")


def word_boxes(files):
    """A stand-in for a vision model: the 'image' is text, a form feed ends a page, one box per word."""
    pages = files.select("doc_id", F.posexplode(F.split(F.decode("content", "utf-8"), "\f")).alias("n", "page"))
    lines_ = F.posexplode(F.split("page", "\n")).alias("row", "line")
    words = pages.select("doc_id", (F.col("n") + 1).alias("page_number"), lines_).select(
        "doc_id", "page_number", "row", F.posexplode(F.split("line", " ")).alias("n", "word"))
    return words.select(
        "doc_id", "page_number", (F.col("row") * 1000 + F.col("n")).cast("long").alias("region_ord"),
        (F.col("n") * 60).alias("x"), (F.col("row") * 20).alias("y"), F.lit(50).alias("w"), F.lit(12).alias("h"),
        F.lit(0.75).alias("confidence"), "word")


def reader(files):
    pages = F.size(F.split(F.decode("content", "utf-8"), "\f"))
    return files.withColumns({"page_count": pages, "width": F.lit(100), "height": F.lit(100)})


def models(spark):
    def load_model():  # local, so that tasks need not import this file
        return lambda batch: [(w.upper(), 0.2 if w == "blur" else 0.9, []) for w in batch["word"]]
    return {"detector": word_boxes, "reader": reader, "recognizer": load_model}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "one.png").write_text("hello blur world\nsecond line")
    (tmp_path / "two.pdf").write_text("page")
    (tmp_path / "three.xyz").write_text("no")
    return tmp_path


def test_engine(spark, folder, tmp_path):
    engine = Engine(spark, **models(spark))
    batch = engine.process_batch(str(folder))
    text = {r.doc_id.rsplit("/", 1)[1]: r.full_text for r in batch.results.collect()}
    assert text == {"one.png": "HELLO WORLD\nSECOND LINE", "two.pdf": "PAGE"}
    assert [r.error_class for r in batch.failures.collect()] == ["UnsupportedFormatException"]
    assert {r.total_regions for r in batch.summary().collect()} == {4, 1}
    output = engine.quick(str(folder / "one.png"))
    assert output.endswith("one_ocr.txt") and lines(output) == "HELLO WORLD\nSECOND LINE\n\n"
    assert lines(engine.export(batch, str(tmp_path / "out.weird"))).count("HELLO") == 1
    assert engine.export(batch, str(tmp_path / "layer"), "searchable_pdf")
    with pytest.raises(ValueError, match="UnsupportedFormat"):
        engine.process(str(folder / "three.xyz"))


def test_pages_come_from_the_file_or_its_boxes(spark, tmp_path):
    (tmp_path / "two.pdf").write_text("first page\fsecond")
    handed = []

    def counting(files):
        handed.append(files.columns)
        return word_boxes(files)

    load = models(spark)["recognizer"]
    for kind in (reader, None):
        batch = Engine(spark, detector=counting, reader=kind, recognizer=load).process_batch(str(tmp_path))
        rows = [(r.page_number, r.full_text) for r in batch.results.orderBy("page_number").collect()]
        assert rows == [(1, "FIRST PAGE"), (2, "SECOND")]
        assert batch.files.first().page_count == 2
    assert all("page_number" not in columns and "content" in columns for columns in handed)
    short = lambda files: reader(files).withColumn("page_count", F.lit(1))
    engine = Engine(spark, detector=word_boxes, reader=short, recognizer=load)
    assert [(r.error_class, r.error_message) for r in engine.process_batch(str(tmp_path)).failures.collect()] == [
        ("DetectionException", "boxes on page 2 of 1")]
    with pytest.raises(ValueError, match="boxes on page 2 of 1"):
        engine.process(str(tmp_path))
    none = lambda files: reader(files).withColumn("page_count", F.lit(None).cast("int"))
    failed = Engine(spark, detector=word_boxes, reader=none, recognizer=load).process_batch(str(tmp_path)).failures
    assert failed.first().error_message == "Document has no pages"


def test_a_failing_file_ends_no_batch(spark, tmp_path):
    """Five files: one the reader can't open, one the detector breaks on halfway, one with a stray box, two good ones."""
    for name, text in {"a.png": "hello world", "b.png": "UNREADABLE", "c.png": "fine then broken", "d.png": "stray", "e.png": "last one"}.items():
        (tmp_path / name).write_text(text)

    def read(path, content):
        if content == b"UNREADABLE":
            raise OSError("can't open it")
        return 1, 100, 100

    def detect(content, page_count):
        for n, word in enumerate(content.decode().split()):
            if word == "broken":
                raise RuntimeError("model error")
            yield {"page_number": 2 if word == "stray" else 1, "region_ord": n, "x": 60 * n, "y": 0, "w": 50, "h": 12,
                   "confidence": 0.75, "word": word}

    guarded = dict(reader=file_reader(read), detector=file_detector(detect, "word string"), recognizer=models(spark)["recognizer"])
    batch = Engine(spark, **guarded).process_batch(str(tmp_path))
    name = lambda r: r.doc_id.rsplit("/", 1)[1]
    assert {name(r): r.full_text for r in batch.results.collect()} == {"a.png": "HELLO WORLD", "e.png": "LAST ONE"}
    assert {name(r): (r.error_class, r.error_message) for r in batch.failures.collect()} == {
        "b.png": ("DocumentLoadException", "OSError: can't open it"), "c.png": ("DetectionException", "RuntimeError: model error"),
        "d.png": ("DetectionException", "boxes on page 2 of 1")}
    outcomes = {name(r): (r.status, r.total_regions) for r in batch.outcomes().collect()}
    assert outcomes == {"a.png": ("ok", 2), "b.png": ("failed", None), "c.png": ("failed", None), "d.png": ("failed", None), "e.png": ("ok", 2)}
    plain = Engine(spark, **{**guarded, "recognizer": None, "detector": file_detector(
        lambda c, n: [{**b, "text": b.pop("word"), "rec_confidence": 0.9} for b in detect(c, n)], "text string, rec_confidence double")})
    assert {name(r) for r in plain.process_batch(str(tmp_path)).results.collect()} == {"a.png", "e.png"}
    out = tmp_path / "out"
    Engine(spark, **guarded).export_files(batch, str(out), "txt")
    assert sorted(p.name for p in out.iterdir() if not p.name.startswith(".")) == ["_SUCCESS", "a.txt", "e.txt"]
    assert (out / "a.txt").read_text() == "HELLO WORLD\n\n"


def test_unknown_configuration_is_an_error():
    assert Config.from_dict({}) == Config()
    for bad in ({"debug": True}, {"ocr": {"no_such": 1}}):
        with pytest.raises(TypeError):
            Config.from_dict(bad)


def test_options_reach_their_operators(spark, tmp_path):
    (tmp_path / "t.png").write_text("name: value\nother: thing\na b\nc d")
    (tmp_path / "u.bmp").write_text("x")
    plain = Engine(spark, **models(spark))
    batch = plain.process_batch(str(tmp_path))
    assert plain.tables(batch).count() > 0 and plain.key_values(batch).count() == 2
    off = Config.from_dict({"document": {"enable_table_detection": False, "enable_kv_extraction": False, "dpi_for_pdf_render": 150},
                            "security": {"allowed_extensions": (".png", ".pdf"), "rate_limit_per_minute": 1},
                            "ocr": {"max_image_dimension": 50}})
    engine = Engine(spark, config=off, **models(spark))
    assert engine.tables(batch).count() == 0 and engine.key_values(batch).count() == 0
    (tmp_path / "v.pdf").write_text("p")
    info = {r.path.rsplit("/", 1)[1]: r for r in engine.info(str(tmp_path)).collect()}
    assert info["u.bmp"].error_class == "UnsupportedFormatException"
    assert info["v.pdf"].dpi == 150 and tuple(info["v.pdf"].reduced) == (50, 50)
    events = spark.createDataFrame([(i, 1, dt.datetime(2024, 1, 1, 0, 0, i)) for i in range(3)], "event_id long, user_id long, ts timestamp")
    assert engine.limited(events).filter("limited").count() == 2


def test_memory_and_listed_sources(spark, folder):
    engine = Engine(spark, **models(spark))
    assert [r.full_text for r in engine.process_bytes(b"hello", "png").results.collect()] == ["HELLO"]
    with pytest.raises(Exception, match="file_type must be specified"):
        engine.process_bytes(b"hello", None)
    both = engine.process_batch([str(folder / "one.png"), str(folder / "two.pdf")])
    assert both.files.count() == 2 and both.results.count() == 2
    with pytest.raises(ValueError, match="no sources"):
        engine.process_batch([])


def test_one_output_per_document(spark, folder, tmp_path_factory):
    engine = Engine(spark, **models(spark))
    batch = engine.process_batch(str(folder))
    tmp_path = tmp_path_factory.mktemp("outputs")
    out = tmp_path / "each"
    for fmt in ("txt", "json", "csv"):
        engine.export_documents(batch, str(out / fmt), fmt)
        assert sorted(p.name for p in (out / fmt).iterdir() if p.is_dir()) == [f"output=one.{fmt}", f"output=two.{fmt}"]
    assert lines(str(out / "txt" / "output=two.txt")) == "PAGE\n\n"
    whole = json.loads(lines(str(out / "json" / "output=one.json")))
    assert whole["total_pages"] == 1 and [r["text"] for r in whole["pages"][0]["text_regions"]][0] == "HELLO"
    together = lines(engine.export(batch, str(tmp_path / "all.txt")))
    assert together.index("one.png ===") < together.index("HELLO") < together.index("two.pdf ===") < together.index("PAGE")
    (folder / "one.jpg").write_text("same name")
    with pytest.raises(ValueError, match="would be written as one.txt"):
        engine.export_documents(engine.process_batch(str(folder)), str(out / "clash"), "txt")


def test_fragments_are_the_document(spark):
    pages = [(d, p, f"text {d} {p}", 0.5, 2) for d, n in ((1, 1), (2, 150), (3, 2)) for p in range(1, n + 1)]
    boxes = [(d, p, o, f"w{o}", 0.5, 1, 2, 3, 4) for d, p, *_ in pages if p != 2 for o in (3, 9_000, 20_000)]
    results = spark.createDataFrame(pages, "doc_id long, page_number int, full_text string, confidence double, num_regions long")
    regions = spark.createDataFrame(boxes + [(9, 1, 1, "stray", 0.5, 1, 2, 3, 4)],
                                    "doc_id long, page_number int, region_ord long, text string, confidence double, x int, y int, w int, h int")
    jobs = spark.createDataFrame([(d, f"j{d}") for d in (1, 2, 3)], "doc_id long, job_id string")
    for pieces, whole, column in (
            (X.json_fragments(results, regions), X.export_json(results, regions), "document"),
            (X.api_fragments(results, regions, jobs), X.api_response(results, regions, jobs), "response"),
            (X.api_fragments(results, regions, jobs, "pdf"), X.api_response(results, regions, jobs, "pdf"), "response")):
        joined = {}
        for r in pieces.orderBy("doc_id", "page_number", "part", "ord").collect():
            joined[r.doc_id] = joined.get(r.doc_id, "") + r.text
        assert joined == {r.doc_id: r[column] for r in whole.collect()}
        plan = pieces._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "Aggregate(keys=[doc_id#" in x and "_band" not in x]


def test_command_line(spark, folder, capsys, monkeypatch):
    monkeypatch.syspath_prepend(str(pathlib.Path(__file__).parent))
    where = "test_export:models"
    assert cli.run(spark, ["ocr", str(folder / "one.png"), "-f", "json", "--models", where]) == 0
    assert "Total regions: 4" in capsys.readouterr().out
    assert cli.run(spark, ["ocr", str(folder / "three.xyz"), "--models", where]) == 1
    assert cli.run(spark, ["batch", str(folder), "--models", where]) == 0
    assert "Processed: 2 file(s), failed: 1" in capsys.readouterr().out
    assert (folder / "ocr_output" / "json").is_dir()
    assert cli.run(spark, ["batch", str(folder), "--models", where, "--overlay", "--per-document", "-f", "txt"]) == 0
    assert spark.read.parquet(str(folder / "ocr_output" / "overlay")).count() == 5
    assert (folder / "ocr_output" / "txt" / "one.txt").is_file()
    assert cli.run(spark, ["info", str(folder)]) == 0
    capsys.readouterr()
    assert cli.run(spark, ["info", str(folder), "--models", where]) == 0
    assert "100x100" in capsys.readouterr().out
    (folder / "none").mkdir()
    (folder / "none" / "a.xyz").write_text("x")
    assert cli.run(spark, ["batch", str(folder / "none"), "--models", where]) == 1
    assert "no supported files" in capsys.readouterr().err
    assert cli.run(spark, ["batch", str(folder / "missing"), "--models", where]) == 1


def test_a_watched_folder(spark, folder, tmp_path, monkeypatch):
    """A file that comes between two runs and is old, one that changes, a rejected one, a folder below, and a batch that died."""
    engine, out, state = Engine(spark, **models(spark)), str(tmp_path / "w" / "out"), str(tmp_path / "w" / "state")
    name = lambda r: r.doc_id.rsplit("/", 1)[1]
    texts = lambda: {name(r): r.full_text for r in engine.watched(out).results.collect()}
    (folder / "below").mkdir()
    (folder / "below" / "four.png").write_text("not this one")
    engine.watch(str(folder), out, state, files_per_batch=2).awaitTermination()
    first = engine.process_batch(str(folder))
    same = lambda table: sorted(map(str, table.select(sorted(table.columns)).collect()))
    seen = engine.watched(out)
    for table in ("files", "results", "regions"):
        assert set(getattr(seen, table).columns) == set(getattr(first, table).columns)
        assert same(getattr(seen, table)) == same(getattr(first, table))
    (folder / "five.png").write_text("late")
    os.utime(folder / "five.png", (1_000_000_000, 1_000_000_000))
    (folder / "two.pdf").write_text("another page")
    monkeypatch.syspath_prepend(str(pathlib.Path(__file__).parent))
    assert cli.run(spark, ["watch", str(folder), "-o", out, "--state", state, "--models", "test_export:models"]) == 0
    assert texts() == {"one.png": "HELLO WORLD\nSECOND LINE", "two.pdf": "PAGE", "five.png": "LATE"}
    assert [name(r) for r in engine.watched(out).failures.collect()] == ["three.xyz"]
    # an attempt that died before its files were written does not count
    engine.watched(out).results.withColumn("full_text", F.lit("half done")).write.parquet(f"{out}/results/batch_id=99")
    assert "half done" not in texts().values()
    engine.export_files(engine.watched(out), str(tmp_path / "each"), "txt")
    assert sorted(f for f in os.listdir(tmp_path / "each") if f.endswith(".txt")) == ["five.txt", "one.txt", "two.txt"]
