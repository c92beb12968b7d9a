"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are rows labelled good; everything without a label is unlabelled web text. With
class prior p the risk p*R_pos(+) + max(0, R_unlabelled(-) - p*R_pos(-)) is minimised; where the second
part turns negative its gradient is followed upwards, which keeps the model from learning the
unlabelled rows by heart.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewright.llm.common import keyed, public_id, row_key, text_slices

#: Bounds of the training sample, in documents: trusted positives and unlabelled texts.
POSITIVES, UNLABELLED = 6_000, 12_000
THRESHOLD, FOLDS, HELD_OUT = 0.7, 4, 2
#: Bytes of a text measured at a time: a text's features are means over its pieces and the worst piece.
PIECE = 1_024


def _piece_features(piece: bytes) -> np.ndarray:
    """Length-free measures of a piece of text: letter case, signs, repetition."""
    n = max(1, len(piece))
    counts = np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
    upper, lower = counts[65:91].sum(), counts[97:123].sum() + counts[128:].sum() / 2
    digits, spaces = counts[48:58].sum(), counts[32] + counts[9:14].sum()
    signs = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    stops = counts[[33, 44, 46, 63]].sum()
    words = piece.split()
    m = max(1, len(words))
    return np.array([
        upper / n, lower / n, digits / n, spaces / n, signs / n, (signs - stops) / n, counts[33] / n,
        len(set(words)) / m, sum(map(bytes.__eq__, words, words[1:])) / m, len(piece) / m / 20,
        len(zlib.compress(piece, 1)) / n, counts.max() / n], np.float32)


def features(text: bytes) -> np.ndarray:
    """Fixed-size numbers of a whole text: byte shares, means and extremes of its pieces, length."""
    size = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if size else np.zeros(256)
    cuts = list(range(0, max(1, size), PIECE))
    if len(cuts) > 1 and size - cuts[-1] < PIECE // 4:
        cuts.pop()  # a short end belongs to the piece before it
    pieces = np.stack([_piece_features(text[i:j]) for i, j in zip(cuts, [*cuts[1:], size])])
    whole = np.array([np.log1p(size) / 10, np.log1p(text.count(b"\n")) / 5], np.float32)
    return np.concatenate([np.sqrt(counts / max(1, size)).astype(np.float32), whole,
                           pieces.mean(0), pieces.max(0), pieces.min(0)])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        z = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1) @ w2 + b2
        return 1 / (1 + np.exp(-np.clip(z[:, 0], -30, 30)))


def train_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 32,
               epochs: int = 60, least_steps: int = 600, batch: int = 1_024, rate: float = 5e-3,
               decay: float = 1e-2, seed: int = 7) -> Model:
    """Minimise the non-negative risk (sigmoid loss) over a one-layer network with Adam."""
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(0), both.std(0) + 1e-3
    ready = lambda x: np.clip((x - mean) / scale, -8, 8)
    p, u = ready(positive), ready(unlabelled)
    rng = np.random.default_rng(seed)
    d = p.shape[1]
    layers = [rng.normal(0, d ** -0.5, (d, hidden)), np.zeros(hidden),
              rng.normal(0, hidden ** -0.5, (hidden, 1)), np.zeros(1)]
    first, second = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    batches, step = max(1, len(u) // batch), 0
    for _ in range(max(epochs, -(-least_steps // batches))):
        for bp, bu in zip(np.array_split(rng.permutation(len(p)), batches),
                          np.array_split(rng.permutation(len(u)), batches)):
            if not len(bp) or not len(bu):
                continue
            x = np.concatenate([p[bp], u[bu]])
            h = np.tanh(x @ layers[0] + layers[1])
            z = (h @ layers[2] + layers[3])[:, 0]
            zp, zu = z[:len(bp)], z[len(bp):]
            sp, su = sigmoid(zp), sigmoid(zu)  # sigmoid loss: bounded, so the difference below is a quiet estimate
            negative = su.mean() - prior * sp.mean()
            g_minus = np.concatenate([-prior * sp * (1 - sp) / len(bp), su * (1 - su) / len(bu)])
            if negative >= 0:
                g = g_minus
                g[:len(bp)] -= prior * sp * (1 - sp) / len(bp)
            else:
                g = -g_minus
            g = g[:, None]
            gh = g @ layers[2].T * (1 - h * h)
            grads = [x.T @ gh, gh.sum(0), h.T @ g, g.sum(0)]
            step += 1
            for i, grad in enumerate(grads):
                grad = grad + decay * layers[i]
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad * grad
                layers[i] -= rate * (first[i] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, scale, layers, prior)


def held_out(id_col: str = "doc_id"):
    """True for rows that no label may be learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int):
    """Features of a bounded sample (0: unlabelled, 1: trusted positive), and the class prior.

    Labels that contradict each other for one doc_id count as none. The prior is the share of good rows among
    the judged rows of the training folds, with one row of each added.
    """
    judged = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
              .groupBy(F.col("doc_id").cast("long").alias("_id"))
              .agg(F.min("quality").alias("_lo"), F.max("quality").alias("_hi"))
              .select("_id", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("_q")))
    ids = (docs.select(F.col("doc_id").cast("long").alias("_id")).filter(F.col("_id").isNotNull())
           .filter(~held_out("_id")).distinct().join(judged, "_id", "left"))
    counts = ids.agg(F.count_if(F.col("_q") == 1).alias("good"), F.count_if(F.col("_q") == 0).alias("bad"),
                     F.count_if(F.col("_q").isNull()).alias("none")).first()
    prior = (counts["good"] + 1) / (counts["good"] + counts["bad"] + 2)
    mixed = ids.filter(F.col("_q").isNull()) if counts["none"] else ids
    pick = lambda df, n, y, seed: (df.orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(n)
                                   .select("_id", F.lit(y).alias("y")))
    chosen = pick(ids.filter(F.col("_q") == 1), positives, 1, 1).union(pick(mixed, unlabelled, 0, 2))
    # repeated ids: one text each, so the sample keeps its bound
    texts = (docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
             .join(F.broadcast(chosen), "_id").groupBy("_id", "y").agg(F.min("_text").alias("_text")))

    def measure(batches):
        for batch in batches:
            for first, some in text_slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(first, len(some)), batch.column("y").slice(first, len(some)),
                     pa.array([features(t).astype("<f4").tobytes() for t in some], pa.binary())], ["_id", "y", "x"])

    rows = sorted((r["y"], r["_id"], bytes(r["x"])) for r in  # bounded by the two sample sizes
                  texts.mapInArrow(measure, "_id long, y int, x binary").collect())
    x = lambda y: np.array([np.frombuffer(v, "<f4") for k, _, v in rows if k == y]).reshape(-1, len(features(b"")))
    return x(1), x(0), prior


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, positives: int = POSITIVES,
             unlabelled: int = UNLABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, from the whole text alone.

    The model is fitted on at most ``positives`` trusted and ``unlabelled`` other texts of the training folds, taken
    in hash order of doc_id; every row is scored. Null and empty texts are scored as the empty text. Without any
    trusted or unlabelled text the prior is the score. Repeated rows are all kept; a null doc_id stays null, is
    not held out and never trained on. An empty table gives an empty result. Other columns of either
    table are ignored.
    """
    return _scored(docs, labels, positives, unlabelled).select(public_id().alias("doc_id"), "score").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _scored(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """(_id, _th, score) for every row of ``docs``."""
    good, mixed, prior = _sample(docs, labels, positives, unlabelled)
    model = train_nnpu(good, mixed, prior) if len(good) and len(mixed) else None

    def run(batches):
        for batch in batches:
            for first, some in text_slices(batch, "_text"):
                scores = (model.score(np.stack([features(t) for t in some])) if model
                          else np.full(len(some), prior))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(first, len(some)), batch.column("_th").slice(first, len(some)),
                     pa.array(scores, pa.float64())], ["_id", "_th", "score"])

    return keyed(docs).mapInArrow(run, "_id long, _th long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows the classifier rejects, all columns as they are.

    Every row is judged by its own text, also where a doc_id is null or repeated.
    """
    kept = (_scored(docs, labels).filter(F.col("score") >= threshold)
            .select(F.col("_id").alias("_keep"), F.col("_th").alias("_keep_th")).distinct())
    row_id, text_hash = row_key()
    return docs.join(kept, (row_id == F.col("_keep")) & (text_hash == F.col("_keep_th")), "left_semi")
