"""Row filters and reshaping: scopes, null drops, outliers, targets in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokengauge.functions.text import gap_word_count
from tokengauge.operators.quantiles import exact_quantiles
from tokengauge.session import materialize

SCOPES = ["all", "english"]
ENGLISH = "English"


def in_scope(df: DataFrame, scope: str, language: str = "language") -> DataFrame:
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}")
    return df.where(F.col(language) == ENGLISH) if scope == "english" else df


def scopes_of(is_english: Column) -> Column:
    """The scopes a row belongs to, as an array."""
    return F.when(is_english, F.array(F.lit("all"), F.lit("english"))).otherwise(F.array(F.lit("all")))


def with_scopes(df: DataFrame, language: str = "language") -> DataFrame:
    """One row per scope: the whole scope grid in one job."""
    english = F.coalesce(F.col(language) == ENGLISH, F.lit(False))
    return df.withColumn("scope", F.explode(scopes_of(english)))


def drop_null(df: DataFrame, *columns: str) -> DataFrame:
    """Drop rows with a null or NaN in any of ``columns``."""
    return df.dropna(subset=list(columns))


def targets_long(df: DataFrame, ids: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Token columns as rows ``(ids..., tokenizer, target)``."""
    return df.unpivot(list(ids), list(targets), "tokenizer", "target")


def token_ratio(target: str, content: str = "content") -> Column:
    return F.col(target) / gap_word_count(content)


def iqr_filter(
    df: DataFrame, value: str, keys: Sequence[str], multiplier: float = 1.5
) -> DataFrame:
    """Keep rows whose ``value`` lies within ``multiplier`` IQRs of the quartiles of its group.

    Bounds are inclusive, null values are dropped. ``df`` is read more than
    once; hand in a stored table where its columns are dear to compute.
    """
    keys = list(keys)
    bounds = exact_quantiles(df, keys, value, {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    bounds = materialize(
        bounds.select(
            *keys,
            (F.col("q1") - F.lit(multiplier) * spread).alias("__lower"),
            (F.col("q3") + F.lit(multiplier) * spread).alias("__upper"),
        ),
        "bounds",
    )
    return (
        df.join(bounds, keys)
        .where(F.col(value).between(F.col("__lower"), F.col("__upper")))
        .drop("__lower", "__upper")
    )
