"""Intake boundaries and file scans."""

import pytest
from pyspark.sql import functions as F

from pagewright.config import Config, OcrConfig
from pagewright.functions import geometry as G
from pagewright.functions.errors import GROUPS, ancestor_pairs
from pagewright.functions.text import message_with_details, stem, suffix
from pagewright.operators import imagestats as I, intake as A
from pagewright.sources.files import scan_documents

MB = 1048576


def test_size_limit_is_exclusive(spark):
    df = spark.createDataFrame([("a.pdf", 100 * MB), ("b.pdf", 100 * MB + 1)], "path string, length long")
    got = {r.path: r for r in A.check_size(df).collect()}
    assert got["a.pdf"].size_ok and got["a.pdf"].size_message is None
    assert got["b.pdf"].size_message == "File size (100.0MB) exceeds limit (100MB)"


def test_first_failing_check_wins(spark):
    rows = [("big.xyz", 200 * MB, 5, 5, 1), ("odd.xyz", 1, 50, 50, 1), ("none.pdf", 1, 50, 50, 0),
            ("flat.png", 1, 9, 10, 1), ("ok.PNG", 1, 10, 10, 1), ("void.png", 1, 0, 10, 1)]
    df = spark.createDataFrame(rows, "path string, length long, width int, height int, page_count int")
    got = {r.path: (r.error_class, r.error_message) for r in A.classify_files(df).collect()}
    assert got["big.xyz"][0] == "FileSizeException"
    assert got["odd.xyz"] == ("UnsupportedFormatException", "Unsupported file format: .xyz")
    assert got["none.pdf"] == ("InvalidDocumentException", "Document has no pages")
    assert got["flat.png"] == ("InvalidDocumentException", "Page 1 is too small: 9x10")
    assert got["void.png"] == ("InvalidDocumentException", "Page 1 has invalid image")
    assert got["ok.PNG"] == (None, None)


def test_validation_names_the_first_bad_page(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "file_id long")
    pages = spark.createDataFrame(
        [(1, 1, 100, 100), (1, 2, 9, 100), (1, 3, 5, 5), (2, 1, 10, 10)],
        "file_id long, page_number int, width int, height int")
    valid, bad = A.validate_documents(docs, pages)
    assert [r.file_id for r in valid.collect()] == [2]
    assert {r.file_id: (r.reason, r.bad_page) for r in bad.collect()} == {
        1: ("Page 2 is too small: 9x100", 2), 3: ("Document has no pages", None)}


def test_bytes_need_a_type(spark):
    df = spark.createDataFrame([(bytearray(b"x"), "pdf"), (bytearray(b"y"), None)], "content binary, t string")
    rows = A.from_bytes(df, F.col("t")).collect()
    assert rows[0].file_name == "document.pdf" and rows[1].error
    with pytest.raises(Exception, match="file_type must be specified"):
        A.from_bytes(df, F.col("t"), strict=True).collect()


def test_names(spark):
    paths = ["/a/b.PDF", "b.tar.gz", ".pdf", "noext", "/x.d/name"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [tuple(r) for r in df.select(suffix("p"), stem("p")).collect()]
    assert got == [(".pdf", "b"), (".gz", "b.tar"), ("", ".pdf"), ("", "noext"), ("", "name")]


def test_error_text(spark):
    df = spark.range(1)
    some = F.create_map(F.lit("key"), F.lit("value"), F.lit("k2"), F.lit("v2"))
    none = F.lit(None).cast("map<string,string>")
    row = df.select(message_with_details(F.lit("Test error"), some),
                    message_with_details(F.lit("Test error"), none)).first()
    assert tuple(row) == ("Test error (key=value, k2=v2)", "Test error")


def test_taxonomy_reaches_the_root():
    pairs = ancestor_pairs()
    assert len({c for c, _, _ in pairs}) == 1 + len(GROUPS) + sum(map(len, GROUPS.values()))
    assert ("FileSizeException", "SecurityException", 1) in pairs


def test_scan_reads_no_bytes_unless_asked(spark, tmp_path):
    for name in ("a.pdf", "B.PNG", "c.JpEg", "d.txt"):
        (tmp_path / name).write_bytes(b"12345")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "e.pdf").write_bytes(b"1")
    files = scan_documents(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.collect()) == ["B.PNG", "a.pdf", "c.JpEg"]
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    everything = scan_documents(spark, str(tmp_path), supported_only=False)
    assert everything.count() == 4


def test_resize_rules(spark):
    df = spark.createDataFrame([(2048, 100), (4096, 1024), (3000, 3000)], "w int, h int")
    sizes = [tuple(r.p) for r in df.select(G.resize_plan(F.col("w"), F.col("h")).alias("p")).collect()]
    assert sizes == [(2048, 100), (2048, 512), (2048, 2048)]
    assert all(max(s) <= 2048 for s in sizes)


def test_skew_edges(spark):
    df = spark.createDataFrame(
        [(-46.0, 100), (46.0, 100), (0.5, 100), (0.49, 100), (20.0, 99)], "a double, n int")
    got = [r.s for r in df.select(G.normalized_skew(F.col("a"), F.col("n")).alias("s")).collect()]
    assert got == [44.0, -44.0, 0.5, 0.0, 0.0]


def test_otsu_by_brute_force(spark):
    import random
    rng = random.Random(4)
    images = {i: [rng.choice([10, 12, 200, 220, rng.randrange(256)]) for _ in range(200)] for i in range(20)}
    images[99] = [7] * 50
    df = spark.createDataFrame([(i, v) for i, vs in images.items() for v in vs], "image_id int, value int")

    def best(values):
        scores = {}
        for t in sorted(set(values))[:-1]:
            low, high = [v for v in values if v <= t], [v for v in values if v > t]
            gap = sum(low) * len(values) - sum(values) * len(low)
            scores[t] = gap * gap / (len(low) * len(high))
        return min(scores, key=lambda t: (-scores[t], t)) if scores else 0
    got = {r.image_id: r.threshold for r in I.otsu_threshold(df).collect()}
    assert got == {i: best(v) for i, v in images.items()}


def test_config_round_trip():
    config = Config.from_dict({"ocr": {"batch_size": 16}, "security": {"rate_limit_per_minute": 3}})
    assert config.ocr.batch_size == 16 and config.ocr.max_image_dimension == 2048
    assert config.security.rate_limit_per_minute == 3
    assert Config.from_dict(config.to_dict()) == config
    assert Config.from_dict({}) == Config()
    with pytest.raises(ValueError):
        OcrConfig(batch_size=0)
    with pytest.raises(TypeError):
        Config.from_dict({"ocr": {"no_such_key": 1}})
