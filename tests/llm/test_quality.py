import pytest
import random
import zlib

import numpy as np

from pagewright.llm import quality

GOOD = "the of and that with from this was are have they will would there their what about which when make".split()


def good_text(rng):
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) if rng.random() < 0.6 else rng.choice(GOOD)
                    for _ in range(rng.randint(30, 300))) + "."


def bad_text(rng):
    kind = rng.random()
    if kind < 0.4:
        return f"{rng.choice(GOOD)} " * rng.randint(40, 200)
    if kind < 0.7:
        return good_text(rng).upper().replace(" ", "!! ")
    return good_text(rng).replace(" ", "### ")


def tables(spark, n=900, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.8)
        docs.append((i, (good_text if y else bad_text)(rng), 0.25, "s"))
        if rng.random() < 0.5:
            labels.append((i, y, 0, "extra"))
    return docs, labels


SCHEMAS = "doc_id long, text string, score double, _id string", "doc_id long, quality int, toxic int, text string"


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, SCHEMAS[0]).repartition(3), spark.createDataFrame(labels, SCHEMAS[1])


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    got = {r["doc_id"]: r for r in quality.classify(*frames(spark, docs, labels)).collect()}
    assert len(got) == len(docs)
    truth = {i: y for i, y, *_ in labels}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [i for i in truth if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.93
    assert np.mean([got[i]["predicted"] for i in held if truth[i]]) > 0.97


def test_held_out_labels_change_nothing(spark):
    docs, labels = tables(spark, 300)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y, *rest) for i, y, *rest in labels]
    scores = lambda ls: sorted((r["doc_id"], r["score"]) for r in quality.classify(*frames(spark, docs, ls)).collect())
    assert scores(labels) == scores(flipped)


def test_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out and quality is not null").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert np.mean([r["predicted"] for r in rows if r["quality"]]) > 0.98


def test_odd_rows(spark):
    docs, labels = tables(spark, 200)
    docs += [(None, "no id", 0.0, "x"), (500, None, 0.0, "x"), (501, "", 0.0, "x"), (7, docs[7][1], 0.0, "x"),
             (502, "word " * 60_000, 0.0, "x"), (503, "\n\t ", None, None)]
    labels += [(None, 1, 0, "x"), (500, None, 0, "x"), (501, 1, 0, "x"), (501, 0, 0, "x"), (9999, 1, 0, "x")]
    got = quality.classify(*frames(spark, docs, labels)).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[500] == by[501]
    kept = quality.keep_good(*frames(spark, docs, labels))
    assert kept.columns == ["doc_id", "text", "score", "_id"]
    assert kept.count() == sum(r["predicted"] for r in got)


def test_without_labels_or_rows(spark):
    docs, labels = tables(spark, 40)
    d, l = frames(spark, docs, labels)
    assert quality.classify(d.limit(0), l).count() == 0
    assert quality.classify(d, l.limit(0)).count() == 40
    assert quality.classify(d, l.filter("quality = 0")).count() == 40


def test_rows_without_or_with_one_id_are_judged_one_by_one(spark):
    docs, labels = tables(spark)
    rng = random.Random(3)
    docs += [(d, make(rng), 0.0, "x") for d in (None, 5_000) for make in (good_text, bad_text) for _ in range(5)]
    d, l = frames(spark, docs, labels)
    odd = lambda rows: sorted(map(repr, (r["doc_id"] for r in rows if r["doc_id"] in (None, 5_000))))
    want = odd(r for r in quality.classify(d, l).collect() if r["predicted"])
    assert odd(quality.keep_good(d, l).collect()) == want and 0 < len(want) < 20


@pytest.mark.parametrize("length", [1_024, 1_030, 2_048, 3_000])
@pytest.mark.parametrize("tail", [1, 40, 255])
def test_every_closing_byte_reaches_the_pieces(length, tail):
    body = b"the quick brown fox jumps over it. " * 200
    with_tail = quality.features(body[:length] + b"#" * tail)
    plain = quality.features(body[:length])
    assert (with_tail[258:] != plain[258:]).any()
    assert len(with_tail) == len(plain)
