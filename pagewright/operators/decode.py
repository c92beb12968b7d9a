"""Recogniser scores to text: best path, collapse, confidence, and user models."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pagewright.functions.decoding import ALPHANUMERIC, CHARSETS, index_char

#: Steps per band when a sequence is split over tasks.
BAND = 4096
#: More than any character set has labels.
LABELS = 1 << 20


def charset(spark: SparkSession, name: str | None = None) -> DataFrame:
    """Dimension (name, idx, ch) of one or of all character sets."""
    rows = [(n, i, c) for n, chars in CHARSETS.items() if name in (None, n)
            for i, c in enumerate(chars, start=1)]
    if not rows:
        raise ValueError(f"unknown character set: {name}")
    return spark.createDataFrame(rows, "name string, idx int, ch string")


def ctc_best_path(logits: DataFrame) -> DataFrame:
    """Label of the greatest score per step, the lowest label on ties, with its probability."""
    top = F.max(F.struct("logit", (-F.col("cls")).alias("neg")))
    steps = logits.groupBy("region_id", "t").agg(
        top.alias("top"), F.sort_array(F.collect_list("logit")).alias("all"))
    total = F.aggregate("all", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("top.logit")))
    return steps.select("region_id", "t", (-F.col("top.neg")).alias("idx"), (1.0 / total).alias("prob"))


def _collapsed(steps: DataFrame, remove_duplicates: bool, charset: str, measured: bool) -> DataFrame:
    # Step and label share one number that sorts by step.
    packed = F.col("t").cast("long") * LABELS + F.col("idx")
    label = lambda i: F.get("_s", i) % LABELS
    def shown(step, i):
        idx = step % LABELS
        repeated = (i > 0) & (label(i - 1) == idx) if remove_duplicates else F.lit(False)
        return F.when((idx == 0) | repeated, "").otherwise(index_char(idx.cast("int"), charset))
    seen = F.col("idx") != 0
    measures = [F.sum(F.when(seen, F.col("prob"))).alias("sum"), F.count_if(seen).alias("n"),
                F.transform(F.sort_array(F.collect_list(F.struct("t", "prob"))), lambda s: s["prob"]).alias("probs")]
    names = ["sum", "n", "probs"] if measured else []
    pieces = (steps.groupBy("region_id", F.floor(F.col("t") / BAND).alias("band"))
              .agg(F.sort_array(F.collect_list(packed)).alias("_s"), *(measures if measured else []))
              .select("region_id", "band", label(F.lit(0)).alias("first"),
                      label(F.size("_s") - 1).alias("last"),
                      F.array_join(F.transform("_s", shown), "").alias("piece"), *names))
    bands = F.sort_array(F.collect_list(F.struct("band", "piece", "first", "last", *names)))

    def trimmed(piece, i):
        goes_on = (i > 0) & (piece["first"] != 0) & (F.get("_b", i - 1)["last"] == piece["first"])
        return F.when(goes_on, F.substr(piece["piece"], F.lit(2))).otherwise(piece["piece"])
    joined = F.transform("_b", trimmed if remove_duplicates else lambda p: p["piece"])
    sums = [(F.sum("sum") / F.sum("n")).alias("_mean")] if measured else []
    texts = pieces.groupBy("region_id").agg(bands.alias("_b"), *sums)
    extra = [F.coalesce("_mean", F.lit(0.0)).alias("confidence"),
             F.flatten(F.transform("_b", lambda p: p["probs"])).alias("char_confidences")] if measured else []
    return texts.select("region_id", F.array_join(joined, "").alias("text"), *extra)


def ctc_collapse(steps: DataFrame, remove_duplicates: bool = True,
                 charset: str = ALPHANUMERIC) -> DataFrame:
    """Text per sequence: repeats joined, blanks (0) dropped. Steps count from 0 without gaps.

    Sequences are cut into bands of steps, each collapsed as if it stood alone. Where a band
    starts with the label the band before ended with, its first character goes.
    """
    return _collapsed(steps, remove_duplicates, charset, False)


def decode_with_lengths(steps: DataFrame, lengths: DataFrame, **options) -> DataFrame:
    """``ctc_collapse`` over the first ``length`` steps of each sequence."""
    within = steps.join(lengths, "region_id").filter(F.col("t") < F.col("length"))
    texts = ctc_collapse(within, **options)
    return (lengths.select("region_id").join(texts, "region_id", "left")
            .withColumn("text", F.coalesce("text", F.lit(""))))


def ctc_confidence(logits: DataFrame) -> DataFrame:
    """Mean probability over non-blank steps, 0.0 if all are blank, and each step's value.

    The list has one entry per step of a crop, whose width the recogniser fixes.
    """
    steps = F.sort_array(F.collect_list(F.struct("t", "prob")))
    return ctc_best_path(logits).groupBy("region_id").agg(
        F.coalesce(F.avg(F.when(F.col("idx") != 0, F.col("prob"))), F.lit(0.0)).alias("confidence"),
        F.transform(steps, lambda s: s["prob"]).alias("char_confidences"))


def recognize(logits: DataFrame) -> DataFrame:
    """Text, confidence and per-step confidences of each region's scores."""
    return _collapsed(ctc_best_path(logits), True, ALPHANUMERIC, True)


Recognizer = Callable[[pd.DataFrame], list[tuple[str, float, list[float]]]]


def _loaded(token: str, load: Callable[[], Recognizer]) -> Recognizer:
    """This process's model: worker processes outlive tasks, so the next task of a job finds what one has loaded."""
    held = sys.modules.setdefault("_pagewright_models", types.ModuleType("_pagewright_models")).__dict__
    if held.get("token") != token:
        held.update(token=token, model=load())  # one model at a time
    return held["model"]


def apply_recognizer(regions: DataFrame, load: Callable[[], Recognizer],
                     batch_size: int = 8) -> DataFrame:
    """Add text, rec_confidence and char_confidences from a user model.

    ``load`` runs once per worker process and returns a function from a batch of rows to one
    (text, confidence, char confidences) per row. Batches are full whatever the sizes rows arrive in, but for a task's last. When a
    batch fails its rows are tried one by one, and a row that fails alone gives ("", 0.0, []).
    """
    added = {"text": T.StringType(), "rec_confidence": T.DoubleType(),
             "char_confidences": T.ArrayType(T.DoubleType())}
    kept = [f for f in regions.schema.fields if f.name not in added]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in added.items()])
    names, token = [f.name for f in kept], uuid.uuid4().hex

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _loaded(token, load)

        def attempt(batch: pd.DataFrame):
            results = list(model(batch))
            if len(results) != len(batch):
                raise ValueError("a recognizer must give one result per row")
            return results

        def one(row: pd.DataFrame):
            try:
                return attempt(row)
            except Exception:
                return [("", 0.0, [])]

        def read(rows: pd.DataFrame) -> pd.DataFrame:
            results = []
            for start in range(0, len(rows), batch_size):
                batch = rows.iloc[start:start + batch_size]
                try:
                    results += attempt(batch)
                except Exception:
                    for i in range(len(batch)):
                        results += one(batch.iloc[i:i + 1])
            out = rows[names].copy()
            for name, values in zip(added, zip(*results) if results else ([], [], [])):
                out[name] = list(values)
            return out

        rest = None
        for frame in frames:
            rows = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            full = len(rows) // batch_size * batch_size
            rest = rows.iloc[full:]
            if full:
                yield read(rows.iloc[:full])
        if rest is not None and len(rest):
            yield read(rest)

    return regions.mapInPandas(run, schema)
