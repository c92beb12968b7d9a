"""Hard negatives for embedding anchors, found with score bounds along a spanning tree of anchors.

Anchors stand in blocks of like label; a block's anchors form a minimum spanning tree by distance. For a candidate x and
an anchor a with parent p in the tree, score(a, x) = score(p, x) + (a - p).x, and the last part is at most |a - p| |x|.
So the parent's score, or the bounds it has itself, plus and minus edge length times candidate norm bound the child's
score. Only candidates whose bounds overlap the window asked for are scored again; for these the bounds become the
score. The window's lower end rises as better rows are found.

Candidates stay where they are: a task holds one group of rows of bounded size, reads the blocks of anchors from the shared folder
one after another, and gives on at most k rows per anchor, positive and group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from pagewright.llm.storage import put, store
from pagewright.session import cut_lineage, scratch_path

#: Anchors of a block (a tree), rows scored at a time, and bytes of candidate vectors a task holds.
BLOCK_ANCHORS, STEP_ROWS, GROUP_BYTES = 256, 4_096, 32 << 20
_EXACT, _LEAST, _MOST = 2.0 ** 52, -2 ** 63, 2 ** 63 - 1


def usable(vectors: DataFrame, scale: int = 256, relabel_every: int = 7, labels: int = 10, id_col: str = "vec_id",
           vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v): rows that take part, labels changed where the id is divisible by ``relabel_every``.

    Rows that share an id are one row, that of the largest vector in array order, then the largest label.
    """
    x = F.col(vector_col).cast("array<double>")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    label = F.col(label_col).cast("long")
    moved = F.when(F.col(id_col) % relabel_every == 0, F.pmod(label + 1, F.lit(labels))).otherwise(label)
    rows = (vectors.filter(F.col(id_col).isNotNull() & label.isNotNull() & F.col(vector_col).isNotNull())
            .filter(~F.exists(x, bad))
            .select(F.col(id_col).cast("long").alias("vec_id"),
                    F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"), moved.alias("label")))
    return rows.groupBy("vec_id").agg(F.max(F.struct("v", "label")).alias("m")).select("vec_id", "m.label", "m.v")


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge): minimum spanning tree by distance, parents before children; the first has parent -1."""
    n = len(vectors)
    x = vectors.astype(float)
    norms = (x * x).sum(1)
    far, parent = np.full(n, np.inf), np.full(n, -1)
    left, order, at = np.ones(n, bool), [], 0
    for _ in range(n):
        left[at] = False
        order.append(at)
        d = norms + norms[at] - 2 * (x @ x[at])
        closer = left & (d < far)
        far[closer], parent[closer] = d[closer], at
        if left.any():
            at = int(np.argmin(np.where(left, far, np.inf)))
    edge = np.array([0.0 if p < 0 else float(np.sqrt(((x[i] - x[p]) ** 2).sum())) for i, p in enumerate(parent)])
    return np.array(order, np.int64), parent, edge


class Block:
    """Anchors of one tree with what is asked for each: windows of scores, one per positive."""

    def __init__(self, ids, labels, vectors, windows=None):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.order, self.parent, self.edge = spanning_tree(vectors)
        #: per anchor [(positive_id, lowest, highest score)]; None: the best rows of the same label
        self.windows = windows


def _bounds(lo, hi, edge: float, norms):
    """Bounds of a child's scores from its parent's: a little wider than exact, so rounding loses no row."""
    reach = edge * norms * (1 + 1e-12) + 1e-6 + 1e-12 * np.maximum(np.abs(lo), np.abs(hi))
    return lo - reach, hi + reach


def _kth(lows: np.ndarray, k: int) -> float:
    """A score that k rows reach for certain."""
    return float(np.partition(lows, len(lows) - k)[len(lows) - k]) if len(lows) >= k else float(_LEAST)


class _Best:
    """The k best (score, id) so far; ties go to the smaller id."""

    def __init__(self, k: int, low: int = _LEAST):
        self.k, self.low, self.scores, self.ids = k, low, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores, ids) -> None:
        self.scores, self.ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        best = np.lexsort((self.ids, -self.scores))[:self.k]
        self.scores, self.ids = self.scores[best], self.ids[best]
        if len(best) == self.k:
            self.low = max(self.low, int(self.scores[-1]))  # equal scores may still win by their id


def search(block: Block, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, k: int,
           step: int = STEP_ROWS) -> tuple[list[tuple[int, int, int, int]], int]:
    """[(anchor_id, positive_id or -1, vec_id, score)]: per anchor and window the k best of a group; and rows rescored."""
    number = float if _fits(block.vectors, vectors) else object  # beyond: exact Python integers
    anchors = block.vectors.astype(number)
    best = [[_Best(k)] if block.windows is None else [_Best(k, low) for _, low, _ in block.windows[i]]
            for i in range(len(anchors))]
    scored = 0
    for at in range(0, len(ids), step):
        part = slice(at, at + step)
        x, own, kinds = vectors[part].astype(number), ids[part], labels[part]
        norms = np.sqrt((x.astype(float) ** 2).sum(1))
        lo, hi = np.empty((2, len(anchors), len(own)))
        for i in block.order:
            if block.parent[i] < 0:
                exact = x @ anchors[i]
                scored += len(own)
                lo[i] = hi[i] = exact.astype(float)
                if number is object:
                    lo[i], hi[i] = _bounds(lo[i], hi[i], 0.0, norms)
            else:
                p = block.parent[i]
                lo[i], hi[i] = _bounds(lo[p], hi[p], block.edge[i], norms)
                exact = None
            same = (kinds == block.labels[i]) & (own != block.ids[i]) if block.windows is None else kinds != block.labels[i]
            tops = [_MOST] if block.windows is None else [high for *_, high in block.windows[i]]
            near = np.zeros(len(own), bool)
            for b, top in zip(best[i], tops):
                low = max(b.low, _kth(lo[i][same & (hi[i] <= top)], k))
                near |= (np.maximum(hi[i], _LEAST) >= low) & (np.minimum(lo[i], _MOST) <= top)
            some = np.flatnonzero(near & same)
            if not len(some):
                continue
            scores = x[some] @ anchors[i] if exact is None else exact[some]
            if exact is None:
                scored += len(some)
                if number is float:
                    lo[i, some] = hi[i, some] = scores
            scores = _whole(scores)
            for b, top in zip(best[i], tops):
                fit = (scores >= b.low) & (scores <= top)
                if fit.any():
                    b.add(scores[fit], own[some][fit])
    out = []
    for i, found in enumerate(best):
        for n, b in enumerate(found):
            positive = -1 if block.windows is None else block.windows[i][n][0]
            out += [(int(block.ids[i]), positive, int(v), int(s)) for s, v in zip(b.scores, b.ids)]
    return out, scored


def _whole(scores: np.ndarray) -> np.ndarray:
    if scores.dtype != object:
        return scores.astype(np.int64)
    return np.array([max(_LEAST, min(_MOST, s)) for s in scores], np.int64)


def _fits(a: np.ndarray, b: np.ndarray) -> bool:
    top = lambda m: max(1.0, float(np.abs(m.astype(float)).max(initial=0)))
    return top(a) * top(b) * max(1, a.shape[1]) < _EXACT


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _read_blocks(folder: str, names: list[str]) -> Iterator[Block]:
    fs, top = store(folder)
    for name in names:
        with fs.open_input_file(f"{top}/{name}") as f:
            rows = pa.ipc.open_stream(f).read_all().to_pydict()
        width = max(map(len, rows["v"]), default=0)
        windows = None if "windows" not in rows else [
            [(w["positive"], w["low"], w["high"]) for w in ws] for ws in rows["windows"]]
        yield Block(np.array(rows["vec_id"], np.int64), np.array(rows["label"], np.int64), _matrix(rows["v"], width), windows)


def _write_blocks(anchors: DataFrame) -> tuple[str, list[str]]:
    """Anchors as files of one block each in the shared folder; a block has one label."""
    folder = scratch_path(anchors.sparkSession, "anchors")
    fields = [f for f in anchors.columns if f not in ("part", "block")]

    def save(table: pa.Table) -> pa.Table:
        fs, top = store(folder)
        fs.create_dir(top, recursive=True)
        name = f"{table['label'][0].as_py()}-{table['block'][0].as_py()}.arrow"
        own = table.select(fields)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema) as out:
            out.write_table(own)
        put(fs, f"{top}/{name}", [sink.getvalue()])
        return pa.table({"name": [name]})

    counts = anchors.groupBy("label").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * 4 / (3 * BLOCK_ANCHORS))).alias("parts"))
    dealt = (anchors.join(counts, "label")
             .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("parts"))
    names = dealt.groupBy("label", "block").applyInArrow(save, "name string").collect()  # a file name per block
    return folder, sorted(r["name"] for r in names)


def _scan(rows: DataFrame, folder: str, names: list[str], k: int) -> DataFrame:
    """(anchor_id, positive_id, vec_id, score): what ``search`` finds of every block in every group of ``rows``."""
    fields = ["anchor_id", "positive_id", "vec_id", "score"]

    def run(batches):
        def groups():
            held, size = [], 0
            for batch in batches:
                for at in range(0, len(batch), STEP_ROWS):
                    some = batch.slice(at, STEP_ROWS)
                    held.append(some)
                    size += len(some.column("v").flatten()) * 8 + len(some) * 16
                    if size >= GROUP_BYTES:
                        yield held
                        held, size = [], 0
            if held:
                yield held

        for held in groups():
            table = pa.Table.from_batches(held)
            v = table["v"].to_pylist()
            ids, labels = (table[c].to_numpy() for c in ("vec_id", "label"))
            vectors = _matrix(v, max(map(len, v), default=0))
            for block in _read_blocks(folder, names):
                width = max(vectors.shape[1], block.vectors.shape[1])
                pad = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
                block.vectors = pad(block.vectors)
                found, _ = search(block, ids, labels, pad(vectors), k)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], fields)

    return rows.select("vec_id", "label", "v").mapInArrow(run, ", ".join(f"{c} long" for c in fields))


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor_every: int = 50, positives: int = 5, negatives: int = 3,
                   low_percent: int = 50, high_percent: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its ``positives`` best other rows of its label. Per positive the best ``negatives`` rows of
    other labels with low_percent * positive_score <= 100 * negative_score <= high_percent * positive_score are returned;
    higher scores first, ties by smaller vec_id, all there are if fewer. So a negative positive_score has none.
    Rows with a null id, label or vector or a null or non-finite component take no part; rows of one id are one
    row (see ``usable``); shorter vectors count as padded with zeros. Anchors without a positive or without a fitting negative and empty tables give no
    rows. Scores beyond 64 bits count as the nearest 64-bit number. Other columns are ignored.
    """
    rows = usable(vectors, scale)
    rows = cut_lineage(rows)
    anchors = cut_lineage(rows.filter(F.col("vec_id") % anchor_every == 0))
    found = _scan(rows, *_write_blocks(anchors), positives)
    chosen = cut_lineage(_best(found, ["anchor_id"], positives).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # 100 * score stays inside 64 bits as whole and rest: ends of the windows in whole scores
    whole, rest = F.expr("positive_score div 100"), F.col("positive_score") % 100
    low = whole * low_percent + F.ceil(rest * low_percent / 100)
    high = whole * high_percent + F.floor(rest * high_percent / 100)
    windows = (chosen.select("anchor_id", F.struct(F.col("positive_id").alias("positive"), low.cast("long").alias("low"),
                                                   high.cast("long").alias("high")).alias("w"))
               .filter("w.low <= w.high").groupBy("anchor_id").agg(F.array_sort(F.collect_list("w")).alias("windows")))
    asked = anchors.join(windows, anchors["vec_id"] == windows["anchor_id"]).select("vec_id", "label", "v", "windows")
    found = _scan(rows, *_write_blocks(asked), negatives)
    return (_best(found, ["anchor_id", "positive_id"], negatives)
            .join(chosen, ["anchor_id", "positive_id"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))


__all__ = ["Block", "hard_negatives", "search", "spanning_tree", "usable"]
