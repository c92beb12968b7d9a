"""Every stage of the pipeline against brute force over its own input."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from pagewright.llm import decontaminate, mixing, quality
from tests.llm import brute
from tests.llm.test_decontaminate import brute as brute_leaks


@pytest.fixture(scope="module")
def stages(spark, sf):
    """[(name, rows in, rows out)]"""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in P.STAGES:
        kept = stage(spark, docs, sf)
        rows = [r.asDict() for r in kept.collect()]
        out.append((name, [r.asDict() for r in docs.collect()], rows, kept.columns))
        if name != "token_files":
            docs = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows], docs.schema)
    return {name: rest for name, *rest in out}


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_columns_and_rows_pass_unchanged(stages):
    for name, (before, after, columns) in stages.items():
        if name != "token_files":
            assert columns == P.COLUMNS
            by = {r["doc_id"]: r for r in before}
            assert all(by[r["doc_id"]] == r for r in after) and 0 < len(after) <= len(before)


def test_quality_stage(stages, spark, sf):
    before, after, _ = stages["quality_filter"]
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    want = [r["doc_id"] for r in quality.classify(docs, labels).collect() if r["score"] >= 0.7]
    assert ids(after) == sorted(want) and len(after) < len(before)


def test_near_duplicate_stage(stages):
    before, after, _ = stages["near_duplicates"]
    groups = brute.near_duplicates([(r["doc_id"], r["text"]) for r in before])
    assert ids(after) == sorted({c for _, _, c in groups}) and len(after) < len(before)


def test_leak_stage(stages, spark, sf):
    before, after, _ = stages["benchmark_leaks"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {k for k, _ in brute_leaks([(r["doc_id"], r["text"]) for r in before], items)}
    hit = {int(k.strip("()").split(",")[0]) for k in hit}
    assert ids(after) == sorted(set(ids(before)) - hit) and hit
    assert decontaminate.THRESHOLD == 0.5


def test_mix_stage(stages, spark):
    before, after, _ = stages["source_mix"]
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in before], "doc_id long, text string, source string")
    assert ids(after) == sorted(r["doc_id"] for r in mixing.mix(docs).collect() if r["in_mix"])


def test_token_stage(stages):
    before, after, columns = stages["token_files"]
    t = Tokenizer.from_file(P.tokenizer_path())
    t.encode_special_tokens = True
    want, start = [], 0
    for r in sorted(before, key=lambda r: r["doc_id"]):
        tokens = t.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want.append((r["doc_id"], start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        start += len(tokens)
    assert sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in after) == want


def test_the_mix_decides_the_places_of_the_token_files(stages, spark, sf, tmp_path):
    """Places are those of the rows as the mix wrote them, also if they are read back from part files of another order."""
    before, after, _ = stages["token_files"]
    place = {r["doc_id"]: r["mix_place"] for r in after}
    assert [r["doc_id"] for r in before] == sorted(place, key=place.get) and sorted(place.values()) == list(range(len(before)))
    assert [r["doc_id"] for r in before] != sorted(place)
    docs = spark.createDataFrame([tuple(r[c] for c in P.COLUMNS) for r in before], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(5, "doc_id").write.parquet(str(tmp_path / "dealt"))
    stored = []
    for part in sorted((tmp_path / "dealt").glob("part-*")):
        stored += [r["doc_id"] for r in spark.read.parquet(str(part)).collect()]
    again = {r["mix_place"]: r["doc_id"] for r in P.token_files(spark, spark.read.parquet(str(tmp_path / "dealt")), sf).collect()}
    assert [again[i] for i in range(len(stored))] == stored


def test_run_chains_the_stages(spark, sf, stages):
    got = sorted(repr(sorted(r.asDict().items())) for r in P.run(spark, sf).collect())
    assert got == sorted(repr(sorted(r.items())) for r in stages["token_files"][1])
