"""Training moments that grow by shard: a linear model after every new shard, without reading the older ones again.

Each shard (file) has one row of moments in the store, under its name. A batch that is
run again replaces the rows of its shards instead of adding to them, and moments are merged only when a model is fitted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tokengauge.operators.moments import Moments
from tokengauge.operators.partials import sum_over

#: The store: a row per shard, scatter by rows (its last column is the target).
STORE = "n long, mean array<double>, scatter array<double>, shard string"


def shard_moments(df: DataFrame, columns: Sequence[str], shard: str = "shard") -> DataFrame:
    """``n``, means and centred products of ``columns`` per shard; rows with a null or NaN in one of them take no part."""
    x = [F.col(c).cast("double") for c in columns]
    whole = df.where(~F.exists(F.array(*x), lambda v: v.isNull() | F.isnan(v)))
    pairs = [F.covar_pop(x[max(i, j)], x[min(i, j)]) * F.count("*") for i in range(len(x)) for j in range(len(x))]
    return whole.groupBy(F.col(shard).alias("shard")).agg(
        F.count("*").alias("n"), F.array(*[F.avg(c) for c in x]).alias("mean"), F.array(*pairs).alias("scatter")
    )


def replace_shards(batch: DataFrame, columns: Sequence[str], store: str) -> None:
    """Write the moments of the shards in ``batch``; what the store held of these shards goes, other shards stay."""
    found = shard_moments(batch, columns).select("n", "mean", "scatter", "shard")
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(store)


def keep_moments(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    store: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame],
    columns: Sequence[str],
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Add the moments of the shards under ``source`` that are new since the last run to ``store``.

    ``prepare`` adds ``columns`` (the target last) to the rows of a shard, row by row. A file is always read
    whole within one batch, so its moments are whole too; a batch that ran before its commit was noted
    runs again with the same files and replaces them. No state is kept between batches but the store.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    shards = reader.parquet(source).withColumn("shard", F.col("_metadata.file_path"))
    rows = prepare(shards).select("shard", *columns)
    return (
        rows.writeStream.foreachBatch(lambda batch, _: replace_shards(batch, columns, store))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merged_store(spark: SparkSession, store: str, width: int, shards: Callable[[DataFrame], DataFrame] | None = None) -> Moments:
    """Moments of all shards in the store, or of those ``shards`` selects (leave one out, say).

    Two passes over the rows of the store: the mean, then scatter around it. Partitions send one array each.
    """
    table = spark.read.schema(T.StructType.fromDDL(STORE)).parquet(store)
    table = shards(table) if shards else table

    def first(batch: dict, sums: np.ndarray, peaks: np.ndarray) -> None:
        sums[0] += batch["n"].sum()
        sums[1:] += batch["n"] @ batch["mean"]

    sums, _ = sum_over(table, ["n", "mean"], first, (width + 1,))
    if not sums[0]:
        return Moments(0.0, np.zeros(width), np.zeros((width, width)))
    n, mean = float(sums[0]), sums[1:] / sums[0]

    def second(batch: dict, sums: np.ndarray, peaks: np.ndarray) -> None:
        off = batch["mean"] - mean
        sums += batch["scatter"].sum(axis=0).reshape(width, width) + (off * batch["n"][:, None]).T @ off

    scatter, _ = sum_over(table, ["n", "mean", "scatter"], second, (width, width))
    return Moments(n, mean, scatter)
