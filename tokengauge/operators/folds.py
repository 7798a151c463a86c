"""Cross-validation folds as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokengauge.session import local_table, materialize

FOLDS = 10
SEED = 42


def bucket_of(key: Column, seed: int | str, buckets: int) -> Column:
    """A bucket drawn from a key by MD5: the same in any order, partitioning or engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def kfold(df: DataFrame, key: str, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Shuffled k-fold split: appends ``fold`` in ``0 .. folds-1``; sizes of folds differ by at most one row.

    A row's fold is its place in the order of the MD5 of its key, modulo ``folds``: the same in any partitioning. Hashes
    spread evenly, so their first three digits cut the rows into 4,096 parts of like size without a sample; parts are sorted where
    they land, and a row's place is that within its part plus the rows of the parts before. ``key`` should name a row. Rows
    with the same key, or none, follow each other in the order of their values, so they spread over the folds too. The rows
    are shuffled and stored once: drop texts before.
    """
    columns = df.columns
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    marked = df.withColumns({"__hash": digest, "__tie": F.xxhash64(*[F.col(c) for c in columns])})
    marked = marked.withColumn("__part", F.conv(F.substring("__hash", 1, 3), 16, 10).cast("int"))
    order = ["__part", "__hash", "__tie"]
    sorted_rows = marked.repartition("__part").sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    stored = materialize(sorted_rows.drop("__hash", "__tie"), "ranked")
    starts, total = [], 0
    for r in stored.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("first")).orderBy("__part").collect():
        starts.append((r["__part"], total - r["first"]))
        total += r["n"]
    before = local_table(df.sparkSession, starts, "__part int, __before long")
    place = F.pmod(F.col("__at") + F.col("__before"), F.lit(folds)).cast("int")
    return stored.join(before, "__part").select(*columns, place.alias("fold"))


def group_fold(df: DataFrame, group: str) -> DataFrame:
    """Leave-one-group-out split: the group (a shard, a source) is the fold."""
    return df.withColumn("fold", F.col(group))
