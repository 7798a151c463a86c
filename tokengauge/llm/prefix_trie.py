"""Prefix trie of conversations with subtree totals by time-forward processing.

A node is named by its depth and the exclusive or of two hashes of (turn, place) over its turns, 128 bits in all, so a prefix of any length is summed
in blocks and two conversations meet in a node if they agree on all turns to its depth.

Totals go from children to parents. Nodes that belong to one conversation only are chains whose totals are known. The others are in
classes by the powers of ``FAN`` in their member counts; counts fall along a path, so the nodes of one class form subtrees
with at most ``FAN`` paths each. These subtrees are dealt to shards. A shard takes its nodes in reverse level order (an external
sort), and every node sends its totals forward to its parent's place in that order, through a priority queue that spills sorted runs.
Totals of shard roots are added up per parent and sent to the next class, so there are as many rounds as the largest count has
digits to the base ``FAN``, and neither a first turn that a third of all conversations share nor the root makes a large shard.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import join_by_share

#: Members of a node of class k: from FAN ** k to FAN ** (k + 1) - 1.
FAN = 1024
#: Turns of a conversation that one window sums up; blocks are chained by their totals.
BLOCK = 4096
#: Messages that a queue holds in memory, and messages read from a run at a time.
QUEUE, READ = 1 << 17, 1 << 12
#: Conversation ids that are joined into one row before they are hashed.
CHUNK = 4096
#: A conversation takes fewer than HEADS turns from the first of its GROUP.
HEADS, GROUP = 9, 5

NODE = ["depth", "p1", "p2"]


class SpillingQueue:
    """Sums by key, taken in increasing order of the keys; runs beyond ``limit`` keys lie in an unnamed scratch file of the task."""

    def __init__(self, limit: int = QUEUE):
        self.limit, self.sums, self.heap, self.runs, self.heads = limit, {}, [], [], []

    def push(self, key: tuple, values: tuple) -> None:
        old = self.sums.get(key)
        if old is None:
            heapq.heappush(self.heap, key)
            self.sums[key] = values
            if len(self.heap) > self.limit:
                self._spill()
        else:
            self.sums[key] = tuple(a + b for a, b in zip(old, values, strict=True))

    def _spill(self) -> None:
        rows = np.array([(*k, *v) for k, v in sorted(self.sums.items())], np.int64)
        self.sums, self.heap = {}, []
        self.runs.append(self._read(rows))
        self._advance(len(self.runs) - 1)

    @staticmethod
    def _read(rows: np.ndarray) -> Iterator[tuple]:
        width = rows.shape[1]
        with tempfile.TemporaryFile() as f:
            f.write(rows.tobytes())
            f.seek(0)
            del rows
            while block := f.read(READ * width * 8):
                yield from map(tuple, np.frombuffer(block, np.int64).reshape(-1, width).tolist())

    def _advance(self, run: int) -> None:
        row = next(self.runs[run], None)
        if row is not None:
            heapq.heappush(self.heads, (row[:3], run, row[3:]))

    def take(self, key: tuple) -> Iterator[tuple]:
        """What was sent to ``key``, which no later call may precede."""
        if self.heap and self.heap[0] == key:
            yield self.sums.pop(heapq.heappop(self.heap))
        while self.heads and self.heads[0][0] == key:
            _, run, values = heapq.heappop(self.heads)
            self._advance(run)
            yield values


def conversation_turns(convs: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), mark (of role and text), bytes. A conversation is spread over several tasks if it is long."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    order = [F.col("turn").asc_nulls_first(), F.col("mark")]
    rows = convs.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", mark.alias("mark"), F.octet_length(text).cast("long").alias("bytes"))
    rows = rows.where("conv_id is not null").repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    rows = materialize(rows, "turns")
    spans = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")
    # a range begins inside one conversation at most, so there are no more of these than tasks
    begun = F.broadcast(spans.withColumn("before", before).where("before > 0").drop("n"))
    local = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    rows = rows.withColumn("local", local).join(begun, ["conv_id", "part"], "left")
    return rows.select("conv_id", (F.col("local") + F.coalesce("before", F.lit(0))).alias("pos"), "mark", "bytes")


def rebuilt(own: DataFrame) -> DataFrame:
    """conv_id, depth (from 0, the root), length, mark, bytes: the first h turns of the first of the group, then the own ones after h."""
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h")
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % GROUP).alias("source"))
    heads = own.where(F.col("pos") < HEADS).groupBy(F.col("conv_id").alias("source"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", "mark", "bytes"))).alias("head"))
    taken = convs.join(heads, "source", "left").withColumn("head", F.expr("slice(coalesce(head, array()), 1, cast(h as int))"))
    rest = F.greatest(F.col("n") - F.col("h"), F.lit(0))
    taken = taken.withColumn("rest", rest).withColumn("length", F.size("head") + F.col("rest"))
    taken = materialize(taken.select("conv_id", "h", "rest", "length", "head"), "heads")
    root = taken.select("conv_id", F.lit(0).cast("long").alias("depth"), "length", F.lit("").alias("mark"), F.lit(0).cast("long").alias("bytes"))
    first = taken.select("conv_id", "length", F.explode("head").alias("t"))
    first = first.select("conv_id", F.col("t.pos").cast("long").alias("depth"), "length", "t.mark", "t.bytes")
    later = own.withColumn("h", h).where("pos > h").drop("h")
    total = taken.agg(F.sum("rest")).collect()[0][0] or 0
    later = join_by_share(later, taken.select("conv_id", "rest", "length", F.size("head").alias("kept"), "h"), ["conv_id"], "rest", total)
    later = later.select("conv_id", (F.col("pos") - F.col("h") + F.col("kept")).cast("long").alias("depth"), "length", "mark", "bytes")
    return root.union(first).union(later)


def paths(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, length, bytes, p1, p2 (the node) and q1, q2 (its parent)."""
    at_root = F.col("depth") == 0
    lane = lambda i: F.when(at_root, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(i), F.col("mark"), F.col("depth")))
    rows = rows.select("conv_id", "depth", "length", "bytes", lane(1).alias("x1"), lane(2).alias("x2"), F.expr(f"depth div {block}").alias("block"))
    rows = materialize(rows, "rebuilt")
    inside = Window.partitionBy("conv_id", "block").orderBy("depth")
    rows = rows.withColumns({f"p{i}": F.bit_xor(f"x{i}").over(inside) for i in (1, 2)})
    sums = rows.where(F.col("length") >= block).groupBy("conv_id", "block").agg(*[F.bit_xor(f"x{i}").alias(f"s{i}") for i in (1, 2)])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "block", *[F.bit_xor(f"s{i}").over(earlier).alias(f"s{i}") for i in (1, 2)])
    names = ["conv_id", "depth", "length", "bytes", "x1", "x2", "p1", "p2"]
    later = rows.where("block > 0").join(sums, ["conv_id", "block"])
    later = later.withColumns({f"p{i}": F.col(f"p{i}").bitwiseXOR(F.col(f"s{i}")) for i in (1, 2)}).select(*names)
    rows = rows.where("block = 0").select(*names).union(later)
    return rows.select("conv_id", "depth", "length", "bytes", "p1", "p2", *[F.col(f"p{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"q{i}") for i in (1, 2)])


_MESSAGE = "depth long, p1 long, p2 long, unit long, class int, leaves long, saved long, children long"
_FORWARD = f"{_MESSAGE}, kind int, conv_id long, n long, parent long"


def _forward(rows: DataFrame, queue: int) -> DataFrame:
    """One round: nodes and the messages to them, dealt by unit. Totals of the nodes (kind 1), and messages to other classes (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = SpillingQueue(queue)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                key = (-r["depth"], r["p1"], r["p2"])
                if not r["kind"]:
                    waiting.push(key, (r["leaves"], r["saved"], r["children"]))
                    continue
                leaves = saved = children = 0
                for a, b, c in waiting.take(key):
                    leaves, saved, children = leaves + a, saved + b, children + c
                saved += (r["n"] - 1) * r["bytes"]
                leaves = leaves or 1
                out.append((r["depth"], r["p1"], r["p2"], r["unit"], r["class"], leaves, saved, children, 1, r["conv_id"], r["n"], r["parent"]))
                if r["up_class"] is None:
                    continue
                if r["up_class"] == r["class"]:
                    waiting.push((1 - r["depth"], r["q1"], r["q2"]), (leaves, saved, 1))
                else:
                    out.append((r["depth"] - 1, r["q1"], r["q2"], r["up_unit"], r["up_class"], leaves, saved, 1, 0, None, None, None))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if i in (4, 8) else pa.int64()) for i, c in enumerate(zip(*out, strict=True))],
                    names=["depth", "p1", "p2", "unit", "class", "leaves", "saved", "children", "kind", "conv_id", "n", "parent"],
                )

    return rows.repartition("unit").sortWithinPartitions(F.desc("depth"), "p1", "p2", "kind").mapInArrow(run, _FORWARD)


def subtree_totals(members: DataFrame, fan: int = FAN, queue: int = QUEUE) -> DataFrame:
    """The nodes: depth, p1, p2, conv_id, parent, n, children, leaves, saved.

    ``members`` has a row per conversation and node on its path: conv_id, depth, length, bytes, p1, p2, q1, q2, n (members), low (the smallest).
    """
    powers = [fan**i for i in range(1, 64) if fan**i < 2**63]
    of_class = F.array_size(F.filter(F.array(*[F.lit(p) for p in powers]), lambda p: p <= F.col("n"))).alias("class")
    columns = ["conv_id", "depth", "length", "bytes", "p1", "p2", "q1", "q2", "n", "low"]
    single = members.where("n = 1")
    tops = single.groupBy("conv_id").agg(F.min(F.struct(*columns[1:])).alias("t")).select("conv_id", "t.*")
    path = members.where("n > 1").select(*columns).union(tops).select("*", of_class)
    same = Window.partitionBy("conv_id", "class").orderBy("depth")
    path = path.withColumn("unit", F.xxhash64(*[F.first(c).over(same) for c in NODE]))
    up = Window.partitionBy("conv_id").orderBy("depth")
    path = path.withColumns({"parent": F.lag("low").over(up), "up_unit": F.lag("unit").over(up), "up_class": F.lag("class").over(up)})
    path = materialize(path.where("conv_id = low"), "nodes")  # one member speaks for a node

    tops = path.where("n = 1").select("conv_id", "depth", F.col("parent").alias("above"))
    chains = single.join(tops, ["conv_id", "depth"], "left").select(
        *NODE, "conv_id", F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent"), "n",
        (F.col("depth") < F.col("length")).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"),
    )
    to = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), F.col("up_unit").alias("unit"), F.col("up_class").alias("class")]
    one = F.lit(1).cast("long")
    messages = path.where("n = 1 and depth > 0").select(*to, one.alias("leaves"), F.lit(0).cast("long").alias("saved"), one.alias("children"))
    nodes = path.where("n > 1")
    done = chains
    for step in range((nodes.agg(F.max("class")).collect()[0][0] or 0) + 1):
        here = messages.where(F.col("class") == step).groupBy(*NODE, "unit", "class").agg(*[F.sum(c).alias(c) for c in ("leaves", "saved", "children")])
        here = here.withColumn("kind", F.lit(0))
        both = nodes.where(F.col("class") == step).withColumn("kind", F.lit(1)).unionByName(here, allowMissingColumns=True)
        sent = materialize(_forward(both, queue), "totals")
        messages = messages.unionByName(sent.where("kind = 0").select(*messages.columns))
        done = done.union(sent.where("kind = 1").select(*NODE, "conv_id", "parent", "n", "children", "leaves", "saved"))
    return done


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, p1, p2, digest: SHA-256 of the ascending ids of the conversations that end in the node, joined by commas.

    Ids are ordered and joined to chunks in tasks that share even the ids of one node. The hash of a node is a
    chain over its chunks, by its nature in one task, which holds one chunk at a time.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = np.stack([batch.column(c).to_numpy() for c in NODE])
            conv = batch.column("conv_id").to_pylist()
            new = np.flatnonzero(np.concatenate([[True], (node[:, 1:] != node[:, :-1]).any(axis=0)]))
            rows = []
            for s, e in zip(new.tolist(), [*new[1:].tolist(), len(conv)], strict=True):
                rows += [(*node[:, i].tolist(), conv[i], ",".join(map(str, conv[i : min(i + CHUNK, e)]))) for i in range(s, e, CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[*NODE, "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = sha = None
        out = []

        def close() -> None:
            if key is not None:
                out.append((*key, sha.hexdigest()))

        for batch in batches:
            for r in batch.to_pylist():
                own = (r["depth"], r["p1"], r["p2"])
                if own == key:
                    sha.update(b",")
                else:
                    close()
                    key, sha = own, hashlib.sha256()
                sha.update(r["ids"].encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*NODE, "digest"])
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*NODE, "digest"])

    node = "depth long, p1 long, p2 long"
    joined = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(nonempty(chunks), f"{node}, first long, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digests, f"{node}, digest string")


def nonempty(f):
    return lambda batches: f(b for b in batches if b.num_rows)


def trie(convs: DataFrame, fan: int = FAN, block: int = BLOCK, queue: int = QUEUE) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, a row per node of the rebuilt conversations.

    ``convs`` has conv_id, turn, role, text. Turns are in order of ``turn``, null first; equal ones in order of the MD5 of
    role and text, so repeated rows are repeated turns. A null role or text is empty. Rows without conv_id belong to no conversation and take no
    part. Remainders have the sign of the id. Other columns are not read. An empty table has no node, not even a root.
    """
    own = materialize(conversation_turns(convs.select("conv_id", "turn", "role", "text")), "own")
    known = materialize(paths(rebuilt(own), block), "paths")
    counts = known.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("conv_id").alias("low")).withColumn("rows", F.col("n"))
    members = materialize(join_by_share(known, materialize(counts, "counts"), NODE, "rows", known.count()), "members")
    nodes = subtree_totals(members, fan, queue)
    ends = end_digests(known.where("depth = length").select(*NODE, "conv_id"))
    none: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(ends, NODE, "left").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("digest", none).alias("ends_sha256"),
    )
