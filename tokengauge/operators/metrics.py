"""Regression metrics per group of predictions, and their summaries over folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokengauge.operators.quantiles import exact_quantiles_of

METRICS = ["r2", "mae", "mse", "median_ae", "mape", "max_error", "d2_abs", "rmse"]
# machine epsilon of a double: the smallest denominator of MAPE (fixed value)
TINY = 2.220446049250313e-16


def _score(lost, total):
    """1 - lost/total; a constant target scores 1 when matched exactly, else 0."""
    return (
        F.when(F.col("n") < 2, F.lit(float("nan")))
        .when(total > 0, F.lit(1.0) - lost / total)
        .when(lost == 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def regression_metrics(
    predictions: DataFrame, keys: Sequence[str], y: str = "y", yhat: str = "yhat"
) -> DataFrame:
    """``keys`` and one column per metric.

    All sums are combined on the map side; the two medians, and the mean distance from the
    median, come from :func:`exact_quantiles_of`, so no group ever sits in one task. ``predictions``
    is read four times, three of them when this is called: hand in a stored table where it is dear to compute.
    """
    keys = list(keys)
    p = predictions.select(*keys, F.col(y).cast("double").alias("y"), F.col(yhat).cast("double").alias("yhat"))
    error = F.abs(F.col("y") - F.col("yhat"))
    sums = p.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(error * error).alias("mse"),
        F.avg(error).alias("mae"),
        F.avg(error / F.greatest(F.abs("y"), F.lit(TINY))).alias("mape"),
        F.max(error).alias("max_error"),
        F.var_pop("y").alias("__var"),
    )
    middle = exact_quantiles_of(p, keys, {"error": error, "y": F.col("y")}, {"median": 0.5}, deviation="median")
    middle = middle.withColumnsRenamed({"error_median": "median_ae", "y_dev": "__dev"}).drop("error_dev", "y_median")
    same = F.lit(True)
    for k in keys:
        same = same & sums[k].eqNullSafe(middle[k])
    wide = sums.join(middle, same, "left").select(sums["*"], "median_ae", "__dev") if keys else sums.crossJoin(middle)
    return wide.select(
        *keys,
        "n",
        _score(F.col("mse"), F.col("__var")).alias("r2"),
        "mae",
        "mse",
        "median_ae",
        "mape",
        "max_error",
        _score(F.col("mae"), F.col("__dev")).alias("d2_abs"),
        F.sqrt("mse").alias("rmse"),
    )


def to_long(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """``(keys..., metric, value)``, the form in which results are stored."""
    return wide.unpivot(list(keys), list(metrics), "metric", "value")


def report_wide(long: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """One column per metric again, for reading."""
    return long.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first("value"))


def summarize(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and both deviations over folds; failed folds (NaN) are left out."""
    value = F.nanvl(F.col("value"), F.lit(None).cast("double"))
    return long.groupBy(*keys, "metric").agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std_pop"),
        F.stddev_samp(value).alias("std_samp"),
        F.count(value).alias("folds"),
    )
