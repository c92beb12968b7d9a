"""Sequence decoding against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions.decoding import ALPHANUMERIC, CHARSETS, ctc_encode
from pagewright.operators import decode as D


def collapse(indices, repeats=True):
    out, prev = [], 0
    for i in indices:
        if i != 0 and not (repeats and i == prev):
            out.append(ALPHANUMERIC[i - 1])
        prev = i
    return "".join(out)


def steps(spark, sequences):
    rows = [(r, t, i) for r, seq in sequences.items() for t, i in enumerate(seq)]
    return spark.createDataFrame(rows, "region_id long, t int, idx int").repartition(3)


@pytest.mark.parametrize("band", [4096, 4])
def test_collapse(spark, monkeypatch, band):
    monkeypatch.setattr(D, "BAND", band)
    rng = random.Random(1)
    sequences = {r: [rng.choice([0, 1, 1, 2, 36]) for _ in range(rng.randrange(1, 40))] for r in range(50)}
    sequences[100], sequences[101] = [0, 1, 1, 0, 1, 2, 2], [0] * 9
    df = steps(spark, sequences)
    assert {r.region_id: r.text for r in D.ctc_collapse(df).collect()} == {
        r: collapse(s) for r, s in sequences.items()}
    assert {r.region_id: r.text for r in D.ctc_collapse(df, remove_duplicates=False).collect()} == {
        r: collapse(s, False) for r, s in sequences.items()}
    lengths = spark.createDataFrame([(r, len(s) // 2) for r, s in sequences.items()], "region_id long, length int")
    assert {r.region_id: r.text for r in D.decode_with_lengths(df, lengths).collect()} == {
        r: collapse(s[:len(s) // 2]) for r, s in sequences.items()}


def test_all_blank_has_no_confidence(spark):
    rows = [(1, t, c, 5.0 if c == 0 else 0.0) for t in range(3) for c in range(4)]
    rows += [(2, 0, c, 1.0) for c in range(4)]  # all tied: the lowest label
    logits = spark.createDataFrame(rows, "region_id long, t int, cls int, logit double")
    got = {r.region_id: r for r in D.recognize(logits).collect()}
    assert got[1].text == "" and got[1].confidence == 0.0 and len(got[1].char_confidences) == 3
    assert got[2].text == "" and got[2].char_confidences == [0.25]


def test_encode(spark):
    df = spark.createDataFrame([("Ab-9 é",)], "t string")
    assert df.select(ctc_encode("t")).first()[0] == [11, 12, 0, 10]


def test_encode_with_symbols(spark):
    text = "A]^b\\-z \u0130`"
    df = spark.createDataFrame([(text,)], "t string")
    for name, chars in CHARSETS.items():
        labels = {c: i for i, c in enumerate("-" + chars)}
        want = [labels[c.lower()] for c in text if c.lower() in labels]
        assert df.select(ctc_encode("t", chars)).first()[0] == want, name


def test_charsets(spark):
    assert D.charset(spark, "digits").count() == 10
    assert D.charset(spark).count() == sum(map(len, CHARSETS.values()))
    with pytest.raises(ValueError):
        D.charset(spark, "klingon")


def test_recognizer_falls_back_row_by_row(spark):
    def load():
        def read(batch):
            if (batch["n"] == 5).any():
                raise RuntimeError("cannot read five")
            return [(f"n{n}", 0.5, [0.5]) for n in batch["n"]]
        return read
    df = spark.range(20).select(F.col("id").alias("n")).coalesce(1)
    got = {r.n: r for r in D.apply_recognizer(df, load, batch_size=8).collect()}
    assert len(got) == 20 and all(0.0 <= r.rec_confidence <= 1.0 for r in got.values())
    assert got[5].text == "" and got[5].char_confidences == [] and got[4].text == "n4"
