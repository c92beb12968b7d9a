"""Prefix trie of conversations, its subtree totals by time-forward processing.

A node is a distinct sequence of first turns. Nodes are cut into shards: a shard root stands at every
``LEVELS``-th depth and below every node with more than ``CROWD`` members, so a shard has at most about
LEVELS * CROWD nodes, whatever the tree looks like. Inside a task the nodes of its shards are read in reverse level order
(Spark's external sort); each node takes its children's messages from a priority queue, adds them up and
sends its own totals forward to its parent's place in the order. The queue spills sorted runs. Shard roots
form a smaller tree; totals pass along it first, by pointers that double their reach each round, and reach the nodes
that shard roots hang from as messages that stand in the queue from the start.

Turn hashes are 128 bits wide, and the hash of a sequence is the exclusive or of the hashes of (depth, turn), so
prefixes of one very long conversation are found in parts. Sequences are told apart by depth and these 128 bits; texts aren't compared again.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagewright.llm.storage import put, store
from pagewright.session import cut_lineage, scratch_path

#: Depths of a shard, and members from which on a node's children are shard roots.
LEVELS, CROWD = 16, 512
#: Messages a queue holds in memory before it spills, and rows it reads back from a run at a time.
QUEUE_ROWS, RUN_ROWS = 200_000, 8_192
#: Bytes of the piece of a list of ids that is hashed at a time.
PIECE_BYTES = 1 << 20
#: Turns a rebuilt conversation may borrow, and whose: of the conversation at the start of its group of ids.
BORROWED, GROUP = 4, 20

_KEY = ["depth", "a", "b"]


def _xor(name: str, over=None) -> Column:
    out = F.bit_xor(name)
    return out if over is None else out.over(over)


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, n, h1, h2, words): every turn with its place (from 1) among the n turns of its conversation.

    The order is made by a range sort, and places are counted inside the sorted parts with the counts of earlier parts added, so one
    conversation may lie in many parts.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit("second"), text, role).alias("h2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("h1"), F.asc("h2")]
    rows = cut_lineage(rows)  # a range sort reads its input twice: texts only once
    parts = cut_lineage(rows.repartitionByRange(F.asc("conv"), *order).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("conv", "part").agg(F.count("*").alias("m"))
    whole = W.partitionBy("conv")
    before = counts.select(
        "conv", "part", (F.sum("m").over(whole.orderBy("part")) - F.col("m")).alias("before"),
        F.sum("m").over(whole).alias("n"))
    placed = parts.withColumn("i", F.row_number().over(W.partitionBy("conv", "part").orderBy(*order)))
    return placed.join(before, ["conv", "part"]).select(
        "conv", "part", (F.col("before") + F.col("i")).alias("pos"), "n", "h1", "h2", "words")


def _rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv, depth, a, b, up_a, up_b, words, last): the prefixes of every rebuilt conversation, depth 0 included."""
    turns = cut_lineage(_turns(conversations))
    convs = turns.filter("pos = 1").select(
        "conv", "n", (F.crc32(F.col("conv").cast("string").cast("binary")) % BORROWED).alias("h"),
        (F.col("conv") - F.col("conv") % GROUP).alias("c0"))
    heads = turns.filter((F.col("pos") < BORROWED) & (F.col("conv") % GROUP == 0)).select(
        F.col("conv").alias("c0"), "pos", "h1", "h2", "words")
    lent = (convs.join(heads, "c0").filter("pos <= h")
            .select("conv", F.col("pos").alias("depth"), "h1", "h2", "words"))
    e1, e2 = F.xxhash64("depth", "h1", "h2").alias("e1"), F.xxhash64(F.lit("second"), "depth", "h2", "h1").alias("e2")
    lent = cut_lineage(lent.select("conv", "depth", "words", e1, e2))
    got = lent.groupBy("conv").agg(F.count("*").alias("k"), _xor("e1").alias("l1"), _xor("e2").alias("l2"))
    convs = cut_lineage(convs.join(got, "conv", "left").select(
        "conv", "h", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("l1", F.lit(0)).alias("l1"),
        F.coalesce("l2", F.lit(0)).alias("l2"),
        (F.coalesce("k", F.lit(0)) + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")))
    own = (turns.join(convs.select("conv", "h", "k", "l1", "l2", "size"), "conv").filter("pos > h")
           .withColumn("depth", F.col("k") + F.col("pos") - F.col("h")).select("*", e1, e2))
    # hashes run inside the parts of the sort; those of earlier parts and of the borrowed turns come on top
    sums = own.groupBy("conv", "part").agg(_xor("e1").alias("s1"), _xor("e2").alias("s2"))
    ahead = W.partitionBy("conv").orderBy("part")
    sums = sums.select("conv", "part", _xor("s1", ahead).bitwiseXOR(F.col("s1")).alias("p1"),
                       _xor("s2", ahead).bitwiseXOR(F.col("s2")).alias("p2"))
    inside = W.partitionBy("conv", "part").orderBy("depth")
    own = own.withColumns({"r1": _xor("e1", inside), "r2": _xor("e2", inside)}).join(sums, ["conv", "part"])
    total = lambda r, p, l: F.col(r).bitwiseXOR(F.col(p)).bitwiseXOR(F.col(l))
    own = own.select("conv", "depth", total("r1", "p1", "l1").alias("a"), total("r2", "p2", "l2").alias("b"),
                     "e1", "e2", "words", "size")
    path = W.partitionBy("conv").orderBy("depth")  # three rows at most
    lent = lent.join(convs.select("conv", "size"), "conv").select(
        "conv", "depth", _xor("e1", path).alias("a"), _xor("e2", path).alias("b"), "e1", "e2", "words", "size")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("e1"),
                         zero.alias("e2"), zero.alias("words"), "size")
    return cut_lineage(own.unionByName(lent).unionByName(roots).select(
        "conv", F.col("depth").cast("long").alias("depth"), "a", "b", F.col("a").bitwiseXOR(F.col("e1")).alias("up_a"),
        F.col("b").bitwiseXOR(F.col("e2")).alias("up_b"), "words", (F.col("depth") == F.col("size")).alias("last")))


def _nodes(rows: DataFrame, levels: int, crowd: int) -> DataFrame:
    """One row a node: its key, its parent's, n_convs, conv_id, words, leaf, and the key of its shard's root (sd, sa, sb)."""
    counts = rows.groupBy(*_KEY).agg(F.count("*").alias("n"))
    crowded = cut_lineage(counts.filter(F.col("n") > crowd).select(*_KEY, F.lit(True).alias("full")))
    band = W.partitionBy("conv", "band").orderBy("depth")
    path = rows.join(crowded, _KEY, "left").withColumn("band", F.expr(f"(depth + {levels - 1}) div {levels}"))
    root = ((F.lag("depth").over(band)).isNull()) | F.coalesce(F.lag("full").over(band), F.lit(False))
    path = path.withColumn("root", F.when(root, F.struct(*_KEY)))
    path = path.withColumn("root", F.last("root", ignorenulls=True).over(band))
    return path.groupBy(*_KEY).agg(
        F.first("up_a").alias("up_a"), F.first("up_b").alias("up_b"), F.count("*").alias("n_convs"),
        F.min("conv").alias("conv_id"), F.first("words").alias("words"),
        (F.count_if(~F.col("last")) == 0).alias("leaf"), F.first("root").alias("root"),
    ).select("*", F.col("root.depth").alias("sd"), F.col("root.a").alias("sa"), F.col("root.b").alias("sb")).drop("root")


def _root_totals(nodes: DataFrame, up: DataFrame) -> DataFrame:
    """(depth, a, b, leaves, saved): totals of the whole subtree of every shard root.

    A root's total is its shard's own sum plus those of the shard roots that hang from the shard. Every round adds
    the sums of all roots one jump below and doubles the jumps, so the rounds grow with the logarithm of the height.
    ``up``: (depth, a, b) of a shard root with the shard (ud, ua, ub) its parent is in.
    """
    own = nodes.groupBy(F.col("sd").alias("depth"), F.col("sa").alias("a"), F.col("sb").alias("b")).agg(
        F.sum(F.col("leaf").cast("long")).alias("leaves"),
        F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    state = cut_lineage(own.join(up, _KEY, "left"))
    jump = ["ud", "ua", "ub"]
    while not state.filter("ud IS NOT NULL").isEmpty():
        below = state.filter("ud IS NOT NULL").groupBy(*[F.col(j).alias(k) for j, k in zip(jump, _KEY)]).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        above = state.select(*[F.col(k).alias(j) for k, j in zip(_KEY, jump)],
                             *[F.col(j).alias("u" + j) for j in jump])
        state = cut_lineage(state.join(below, _KEY, "left").join(above, jump, "left").select(
            *_KEY, (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            *[F.col("u" + j).alias(j) for j in jump]))
    return state.drop(*jump)


class SpillingQueue:
    """Messages in the order of their place; beyond ``rows`` in memory they go to sorted runs in ``folder``."""

    def __init__(self, folder: str, name: str, rows: int = 0):
        self.folder, self.name, self.rows = folder, name, rows or QUEUE_ROWS
        self.heap: list[tuple[int, ...]] = []
        self.runs: list[Iterator[tuple[int, ...]]] = []
        self.heads: list[tuple[tuple[int, ...], int]] = []
        self.paths: list[str] = []

    def push(self, message: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.rows:
            self._spill()

    def _spill(self) -> None:
        fs, top = store(self.folder)
        path = f"{top}/{self.name}-{len(self.paths)}.run"
        fs.create_dir(top, recursive=True)
        put(fs, path, [np.array(sorted(self.heap), "<i8").tobytes()])
        self.heap, width = [], len(self.heap[0])
        self.paths.append(path)
        self.runs.append(self._read(fs, path, width))
        heapq.heappush(self.heads, (next(self.runs[-1]), len(self.runs) - 1))

    @staticmethod
    def _read(fs, path: str, width: int) -> Iterator[tuple[int, ...]]:
        at, step = 0, RUN_ROWS * width * 8
        while True:
            with fs.open_input_file(path) as f:
                some = f.read_at(min(step, f.size() - at), at)
            if not some:
                return
            at += len(some)
            yield from map(tuple, np.frombuffer(some, "<i8").reshape(-1, width).tolist())

    def pop(self, place: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        """Every message for ``place``, each taken out."""
        n = len(place)
        while self.heap and self.heap[0][:n] == place:
            yield heapq.heappop(self.heap)
        while self.heads and self.heads[0][0][:n] == place:
            message, run = self.heads[0]
            after = next(self.runs[run], None)
            if after is None:
                heapq.heappop(self.heads)
            else:
                heapq.heapreplace(self.heads, (after, run))
            yield message

    def close(self) -> None:
        fs, _ = store(self.folder)
        for path in self.paths:
            fs.delete_file(path)


def time_forward(rows: Iterator[tuple[int, ...]], queue: SpillingQueue) -> Iterator[tuple[int, ...]]:
    """(depth, a, b, children, leaves, saved) of nodes that come in reverse level order, deepest first, then by (a, b).

    A row: depth, a, b, up_a, up_b, whether its parent is in the shard, and children, leaves and saved so far: the node's own and those of the
    shard roots hanging from it. Nothing but the queue is kept between rows.
    """
    for depth, a, b, up_a, up_b, inside, children, leaves, saved in rows:
        for *_, c, l, s in queue.pop((-depth, a, b)):
            children, leaves, saved = children + c, leaves + l, saved + s
        yield depth, a, b, children, leaves, saved
        if inside:
            queue.push((1 - depth, up_a, up_b, 1, leaves, saved))


def _in_shards(nodes: DataFrame, queue_rows: int) -> DataFrame:
    """(depth, a, b, n_children, n_leaves, saved_tokens) of all nodes."""
    columns = ["depth", "a", "b", "up_a", "up_b", "inside", "children", "leaves", "saved"]
    folder = scratch_path(nodes.sparkSession, "queues")
    out = [*_KEY, "n_children", "n_leaves", "saved_tokens"]

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        queue = SpillingQueue(folder, f"{context.partitionId()}-{context.taskAttemptId()}", queue_rows)
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in columns)))
        found: list[tuple[int, ...]] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], out)
        try:
            for row in time_forward(rows, queue):
                found.append(row)
                if len(found) >= RUN_ROWS:
                    yield pack()
                    found = []
            if found:
                yield pack()
        finally:
            queue.close()

    dealt = nodes.repartition("sd", "sa", "sb").sortWithinPartitions(F.desc("depth"), "a", "b")
    return dealt.select(*columns).mapInArrow(run, ", ".join(f"{c} long" for c in out))


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of nodes where conversations end.

    Ids are range-sorted by (node, id) and joined to pieces of bounded size where they lie; a node with more than one piece
    has them hashed one after another in their order, streaming.
    """
    order = [*_KEY, "conv"]
    # AQE may not merge sorted parts differently between tasks: a piece says where it starts, so any cut is right
    ends = rows.filter("last").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()),
                       ("ids", pa.string()), ("sha", pa.string())])

    def pieces(batches):
        key, first, ids, size, whole, out = None, None, [], 0, True, []

        def piece(complete):
            text = ",".join(ids)
            out.append((*key, first, None if complete else text,
                        hashlib.sha256(text.encode()).hexdigest() if complete else None))

        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)
        opening = True  # the first node of a part may have begun in the part before
        for batch in batches:
            for d, a, b, conv in zip(*(batch.column(c).to_pylist() for c in order)):
                if (d, a, b) != key:
                    if key is not None:
                        piece(whole and not opening)
                        opening = False
                    key, first, ids, size, whole = (d, a, b), conv, [], 0, True
                elif size > PIECE_BYTES:
                    piece(False)
                    first, ids, size, whole = conv, [], 0, False
                ids.append(str(conv))
                size += len(ids[-1]) + 1
                if len(out) >= RUN_ROWS or size == len(ids[-1]) + 1 and not whole and out:
                    yield pack()
                    out.clear()
        if key is not None:
            piece(False)  # and the last one may go on in the next part
            yield pack()

    found = cut_lineage(ends.mapInArrow(pieces, "depth long, a long, b long, first long, ids string, sha string"))

    def chain(batches):
        key, digest, out = None, None, []
        pack = lambda: pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in list(zip(*out))[:3]), pa.array([r[3] for r in out], pa.string())],
            [*_KEY, "sha"])
        for batch in batches:
            for d, a, b, ids in zip(*(batch.column(c).to_pylist() for c in [*_KEY, "ids"])):
                if (d, a, b) == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (d, a, b), hashlib.sha256()
                digest.update(ids.encode())
            if len(out) >= RUN_ROWS:
                yield pack()
                out.clear()
        if key is not None:
            out.append((*key, digest.hexdigest()))
            yield pack()

    split = found.filter("sha IS NULL").repartition(*_KEY).sortWithinPartitions(*_KEY, "first")
    joined = split.select(*_KEY, "ids").mapInArrow(chain, "depth long, a long, b long, sha string")
    return found.filter("sha IS NOT NULL").select(*_KEY, "sha").union(joined).withColumnRenamed("sha", "ends_sha256")


def prefix_trie(conversations: DataFrame, levels: int = LEVELS, crowd: int = CROWD,
                queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), of one turn number by role and then by hashes of role and text; repeated
    rows are turns of their own. Null roles and texts are empty. A conversation is rebuilt as the first h turns
    of the conversation that opens its group of 20 ids (none if absent) and its own turns after the first h, h from the checksum of
    its id; it may end up without turns and is then a member of the root only. Rows without a conv_id
    belong to no conversation. An empty table has no root. Other columns are ignored, texts may have any length.
    """
    rows = _rebuilt(conversations)
    nodes = cut_lineage(_nodes(rows, levels, crowd))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"),
                         F.col("conv_id").alias("parent_conv_id"), F.col("sd").alias("ud"), F.col("sa").alias("ua"),
                         F.col("sb").alias("ub"))
    nodes = cut_lineage(nodes.join(above, ["depth", "up_a", "up_b"], "left"))
    is_root = (F.col("depth") == F.col("sd")) & (F.col("a") == F.col("sa")) & (F.col("b") == F.col("sb"))
    totals = _root_totals(nodes, nodes.filter(is_root & (F.col("depth") > 0)).select(*_KEY, "ud", "ua", "ub"))
    # what hangs from a node: one message for all shard roots below it, summed before it is sent
    inbox = nodes.filter(is_root & (F.col("depth") > 0)).select(*_KEY, "up_a", "up_b").join(totals, _KEY).groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(
        F.count("*").alias("m_children"), F.sum("leaves").alias("m_leaves"), F.sum("saved").alias("m_saved"))
    more = lambda c: F.coalesce(c, F.lit(0))
    ready = nodes.join(inbox, _KEY, "left").select(
        *_KEY, "up_a", "up_b", "sd", "sa", "sb", (~is_root).cast("long").alias("inside"),
        more("m_children").alias("children"), (F.col("leaf").cast("long") + more("m_leaves")).alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words") + more("m_saved")).alias("saved"))
    done = _in_shards(ready, queue_rows)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (nodes.join(done, _KEY).join(_ends(rows), _KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256")))


__all__ = ["SpillingQueue", "prefix_trie", "time_forward"]
