"""Approximate nearest neighbours (largest inner product) by several shifted Hilbert orderings.

Vectors are projected onto a few directions at a time, a different set for each ordering; the projected points, shifted at
random, are numbered along a Hilbert curve. Spark sorts each ordering by range partitioning, the sorted list is cut into blocks,
and a query is compared with the blocks around its place in every ordering. The best of all windows are merged and ranked
on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import local_table, materialize

ORDERINGS, DIRECTIONS, BITS = 16, 4, 12
#: Share of an ordering that lies within a query's window, before or after it each.
REACH = 0.04
#: Rows of a block, and vectors that the projection is fitted to.
BLOCK, SAMPLE = 2048, 20_000


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows, below 2**bits in each coordinate), at most 63 bits in all.

    The usual transposed form: coordinates are exchanged or inverted from the top bit down, then Gray-coded, and their bits interleaved.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _projection(vectors: DataFrame, dims: int, sample: int, orderings: int, directions: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions (ordering, direction, component), lows and widths of the projections, from the first vectors in the order of a hash."""
    table = vectors.select("vector", F.xxhash64("vector").alias("h")).orderBy("h", "vector").limit(sample).select("vector").toArrow()
    x = _matrix(table.column("vector"), dims)
    axes = np.linalg.eigh(np.cov(x.T).reshape(dims, dims) if len(x) > 1 else np.eye(dims))[1][:, ::-1].T
    rng = np.random.default_rng(seed)
    need = orderings * directions
    rows = [axes]
    while sum(map(len, rows)) < need:  # fewer components than directions: turned copies of the axes
        rows.append(np.linalg.qr(rng.normal(size=(dims, dims)))[0])
    planes = np.concatenate(rows)[:need]
    planes = planes[np.arange(need).reshape(directions, orderings).T.ravel()].reshape(orderings, directions, dims)
    seen = np.einsum("odc,nc->nod", planes, x)
    low, high = seen.min(0), seen.max(0)
    wide = np.maximum(high - low, 1e-12)
    shift = rng.uniform(0, 0.5, size=low.shape) * wide
    return planes, low - shift, wide * 1.5


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, orderings: int = ORDERINGS, directions: int = DIRECTIONS, bits: int = BITS,
    reach: float = REACH, block: int = BLOCK, sample: int = SAMPLE, seed: int = 5,
) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found for each row of ``vectors`` (vec_id, vector) with ``is_query`` (of vec_id).

    Nearest first, ties to the smaller vec_id; a row is no neighbour of its own id. Rows with a null id, vectors
    that are null, zero or hold null or non-finite components take no part, nor do vectors whose length is not the most common one. Repeated rows are one.
    Equal vectors are searched once: the ``k + 1`` smallest ids stand for all, which is exact since ties go to smaller ids. An
    empty table gives none.
    """
    out = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["vector"]
    vector = F.col("vector") if kind in ("array<float>", "array<double>") else F.col("vector").cast("array<double>")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where("vec_id is not null").where(usable(F.col("vector")))
    good = materialize(good.distinct(), "vectors")
    sizes = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return local_table(spark, [], out)
    dims = sizes["n"]
    good = good.where(F.size("vector") == dims)
    ranked = good.withColumn("r", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    nodes = materialize(ranked.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    asked = good.where(is_query).select("vec_id", "vector")
    wanted = asked.select("vector").distinct().withColumn("asked", F.lit(True))
    nodes = materialize(nodes.join(wanted, "vector", "left").select(F.col("ids")[0].alias("node"), "ids", "vector", F.coalesce("asked", F.lit(False)).alias("asked")), "nodes")
    planes, low, wide = _projection(nodes, dims, sample, orderings, directions, seed)
    top = (1 << bits) - 1

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), dims)
            for o in range(orderings):
                cell = ((np.einsum("dc,nc->nd", planes[o], x) - low[o]) / wide[o] * (top + 1)).clip(0, top).astype(np.int64)
                keys = pa.array(hilbert(cell, bits))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), o, np.int32)), keys, *batch.columns], names=["ordering", "key", *batch.schema.names])

    schema = T.StructType([T.StructField("ordering", T.IntegerType()), T.StructField("key", T.LongType()), *nodes.schema.fields])
    parts = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = nodes.mapInArrow(number, schema).repartitionByRange(parts, "ordering", "key", "node").sortWithinPartitions("ordering", "key", "node")
    placed = materialize(placed.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    # one row per partition comes to the driver: where in the whole list each partition starts
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    placed = placed.withColumn("p", part).join(local_table(spark, starts, "p long, start long"), "p").withColumn("place", F.col("start") + row)
    # every ordering holds all nodes, one ordering after the other: a block never spans two of them
    each = total // orderings
    half, blocks = max(block // 2, int(reach * each)), each // block + 1
    inside, first_block = F.col("place") % each, F.floor(F.col("place") / each) * blocks
    data = placed.select((first_block + F.floor(inside / block)).cast("long").alias("block"), "ids", "vector")
    ends = [F.floor(F.greatest(inside - half, F.lit(0)) / block), F.floor(F.least(inside + half, F.lit(each - 1)) / block)]
    around = F.sequence(*[(first_block + e).cast("long") for e in ends])
    sent = placed.where("asked").select(F.explode(around).alias("block"), F.col("node").alias("node"), F.col("vector").alias("query"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"node": [], "ids": [], "scores": []})
        x = np.stack(left["vector"].to_numpy()).astype(float)
        found = []
        keep = min(len(x), k + 1)
        for begin in range(0, len(right), 512):
            q = np.stack(right["query"].to_numpy()[begin : begin + 512]).astype(float)
            s = q @ x.T
            limit = np.partition(s, len(x) - keep, axis=1)[:, len(x) - keep]
            for i in range(len(q)):
                at = np.flatnonzero(s[i] >= limit[i] - 1e-9)  # ties at the limit stay
                exact = x[at] @ q[i]
                order = np.argsort(-exact, kind="stable")
                found.append(([left["ids"].iat[j].tolist() for j in at[order]], exact[order].tolist()))
        return pd.DataFrame({"node": right["node"].to_numpy(), "ids": [f[0] for f in found], "scores": [f[1] for f in found]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        best = {ids[0]: (score, ids) for row in group.itertuples() for ids, score in zip(row.ids, row.scores, strict=True)}
        flat = sorted((-score, i) for score, ids in best.values() for i in ids)
        flat = flat[: k + 1]  # one more than asked: the query's own id may be among them
        return pd.DataFrame({"node": [group["node"].iat[0]], "ids": [[i for _, i in flat]], "scores": [[-s for s, _ in flat]]})

    windows = data.groupBy("block").cogroup(sent.groupBy("block")).applyInPandas(compare, "node long, ids array<array<long>>, scores array<double>")
    lists = windows.groupBy("node").applyInPandas(merge, "node long, ids array<long>, scores array<double>")
    owners = asked.join(nodes.select("vector", "node"), "vector").select("vec_id", "node")
    hits = owners.join(lists, "node").select(F.col("vec_id").alias("query_id"), F.posexplode(F.arrays_zip("ids", "scores")).alias("p", "hit"))
    others = hits.where(F.col("hit.ids") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("p"))
    return others.select("query_id", rank.cast("int").alias("rank"), F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score")).where(F.col("rank") <= k)
