"""The stored index against searching the texts, and what its plans read."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from pagewright.operators import layout as L, search_index as I


def brute(documents, queries, k=10):
    tf = {d: Counter(w for t in [t for x, t in documents if x == d] for w in (t or "").lower().split()) for d, _ in documents if d is not None}
    df = Counter(w for c in tf.values() for w in c)
    out = []
    for q in sorted({q for q, _ in queries}):
        words = {w for x, t in queries if x == q for w in (t or "").lower().split()}
        scored = [(round(sum(c[w] * math.log(len(tf) / df[w]) for w in words & set(c)), 6), d, len(words & set(c))) for d, c in tf.items() if words & set(c)]
        out += [(q, r, d, s, n) for r, (s, d, n) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k], 1)]
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(2)
    words = ["the"] * 40 + [f"w{i}" for i in range(200)]
    documents = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(300)]
    documents += [(900, None), (901, ""), (902, "THE  W1\tw1\nw2 "), (903, "only here é"), (3, "the the w7")]
    queries = [(i, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(25)]
    queries += [(50, "unknown words"), (51, None), (52, "É the"), (0, "w3 w4"), (53, "")]
    path = str(tmp_path_factory.mktemp("index"))
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    for segment in range(3):
        I.add_documents(docs.filter(f"doc_id % 3 = {segment}"), path, segment)
    return documents, spark.createDataFrame(queries, "query_id long, query string"), queries, path


def test_equals_brute_force(spark, tables):
    documents, asked, queries, path = tables
    got = sorted(map(tuple, I.search_index(spark, path, asked, 7).collect()))
    want = brute(documents, queries, 7)
    assert [(*r[:3], r[4]) for r in got] == [(*r[:3], r[4]) for r in want]
    assert all(math.isclose(a[3], b[3], abs_tol=2e-6) for a, b in zip(got, want))


def test_equals_search_over_texts(spark, tables):
    documents, _, _, path = tables
    docs = spark.createDataFrame([d for d in documents if d[0] not in (3,)], "doc_id long, text string")
    I.add_documents(docs, path + "-plain", 0)
    one = spark.createDataFrame([(1, "w1 the w5 w9")], "query_id long, query string")
    got = [(r["key"], r["score"], r["terms"]) for r in I.search_index(spark, path + "-plain", one).orderBy("rank").collect()]
    assert got == [tuple(r) for r in L.search(docs, "w1 the w5 w9").collect()]


def test_a_search_reads_no_text_and_few_buckets(spark, tables):
    _, _, _, path = tables
    one = spark.createDataFrame([(1, "w1")], "query_id long, query string")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = I.search_index(spark, path, one)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("/postings" in s or "/terms" in s for s in scans)
    filters = [s.split("PartitionFilters: ")[1].split("PushedFilters")[0] for s in scans]
    assert all("segment" in f and "bucket" in f for f in filters)


def test_a_segment_again_replaces_itself_and_unfinished_ones_are_not_seen(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "b c")], "query_id long, query string")
    path = str(tmp_path / "i")
    for _ in range(2):
        I.add_documents(docs, path, 4)
    want = sorted(map(tuple, I.search_index(spark, path, asked).collect()))
    assert [r[2] for r in want] == [1, 2] and I.statistics(spark, path).collect()[0]["n_docs"] == 2
    spark.createDataFrame([("b", 7, 1)], "term string, key long, tf long").selectExpr("*", "cast(pmod(xxhash64(term), 64) as int) as bucket").write.partitionBy(
        "bucket").parquet(f"{path}/postings/segment=5")  # a build that died before its commit
    assert sorted(map(tuple, I.search_index(spark, path, asked).collect())) == want


def test_many_words_meet_by_a_shuffled_join(spark, tables, monkeypatch):
    _, asked, _, path = tables
    want = sorted(map(tuple, I.search_index(spark, path, asked, 7).collect()))
    monkeypatch.setattr(I, "SENT_WORDS", 0)
    assert sorted(map(tuple, I.search_index(spark, path, asked, 7).collect())) == want


def test_postings_move_once_and_hits_not_at_all(spark, tables):
    _, asked, _, path = tables
    lines = I.search_index(spark, path, asked)._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [line for line in lines if "Exchange hashpartitioning(" in line]
    assert sum("hashpartitioning(key" in line for line in dealt) == 1
    assert not any("hashpartitioning(query_id" in line and ", key" in line for line in dealt)


@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
def test_blocks_of_any_slice_hold_every_word(monkeypatch, limit):
    rng = random.Random(limit)
    blanks, words = [" ", "  ", "\t", "\n", "\x0b", "\x0c", "\r\n"], ["a", "é", "x\x1cy", " ", "wo", "日本"]
    texts = ["", " ", "\n\t ", "a", " a ", "a" * 300] + [
        "".join(rng.choice(words) + rng.choice(blanks) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    monkeypatch.setattr(I, "SLICE_BYTES", limit)
    batch = pa.RecordBatch.from_arrays([pa.array(range(100, 100 + len(texts))), pa.array(texts)], ["key", "text"])
    got = {}
    for block in I._blocks([batch.slice(0, 10), batch.slice(10), batch.slice(0, 0)]):
        for r in block.to_pylist():
            assert len(r["keys"]) == len(r["tfs"]) == r["docs"] > 0 and r["keys"] == sorted(r["keys"])
            for key, tf in zip(r["keys"], r["tfs"]):
                assert (r["term"], key) not in got
                got[r["term"], key] = tf
    want = Counter((w, 100 + i) for i, t in enumerate(texts) for w in re.split("[ \t-\r]+", t) if w)
    assert got == want


def test_a_hot_shared_key_is_one_document(spark, tmp_path):
    documents = [("hot", f"a a w{i % 7}") for i in range(200)] + [("hot", None), ("x", "a b"), ("y", "w1\x0bw1 \n"), (None, "a b"), ("z", None)]
    I.add_documents(spark.createDataFrame(documents, "name string, body string"), str(tmp_path), 0, "body", "name")
    queries = [(1, "a"), (2, "w1 b"), (3, "w6")]
    got = I.search_index(spark, str(tmp_path), spark.createDataFrame(queries, "query_id long, query string")).collect()
    want = brute([d for d in documents if d[0]], queries)
    assert sorted((r["query_id"], r["rank"], r["key"], r["terms"]) for r in got) == [(*w[:3], w[4]) for w in want]
    kept = {r["key"]: (r["words"], r["copies"]) for r in spark.read.parquet(f"{tmp_path}/documents").collect()}
    assert kept == {"hot": (600, 201), "x": (2, 1), "y": (2, 1), "z": (0, 1)}


def test_segments_without_words_or_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, " "), (2, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "query_id long, query string")
    I.add_documents(docs, str(tmp_path), 0)
    I.add_documents(docs.limit(0), str(tmp_path), 1)
    assert I.search_index(spark, str(tmp_path), asked).collect() == []
    assert sorted(map(tuple, I.statistics(spark, str(tmp_path)).collect())) == [(0, 2, 0), (1, 0, 0)]
    I.add_documents(spark.createDataFrame([(5, "A b"), (6, "b")], docs.schema), str(tmp_path), 2)
    got = I.search_index(spark, str(tmp_path), asked).collect()
    assert [(r["key"], r["score"]) for r in got] == [(5, round(math.log(4), 6))]


def test_parts_of_builds_and_searches_grow(spark, tables, monkeypatch):
    """A task's scores and postings are bounded, so their parts grow with documents, queries and words."""
    documents, asked, queries, path = tables
    dealt = lambda: int(re.search(r"hashpartitioning\(key#\w+, (\d+)\), REPARTITION_BY_NUM",
                                  I.search_index(spark, path, asked, 7)._jdf.queryExecution().toString())[1])
    few = dealt()
    want = sorted(map(tuple, I.search_index(spark, path, asked, 7).collect()))
    monkeypatch.setattr(I, "TASK_PAIRS", 300)
    assert dealt() == -(-304 * 27 // 300) > few  # two queries have no words
    assert sorted(map(tuple, I.search_index(spark, path, asked, 7).collect())) == want
    monkeypatch.setattr(I, "PIECE_WORDS", 30)
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    for segment in range(3):
        I.add_documents(docs.filter(f"doc_id % 3 = {segment}"), path + "-pieces", segment)
    files = lambda at: len(spark.read.parquet(f"{at}/postings/segment=0").inputFiles())
    assert files(path + "-pieces") > files(path)
    assert sorted(map(tuple, I.search_index(spark, path + "-pieces", asked, 7).collect())) == want
