"""Scaler statistics and training moments per fold, and the fold complement.

One aggregation gives the moments of every (tokenizer, language, fold) part.
Training moments of a fold are the merged moments of the other parts, so no
fold is ever scanned twice and nothing larger than the grid reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokengauge.operators.partials import sum_over
from tokengauge.session import materialize


def scaler_fit(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``(keys..., feature, n, mean, scale)``: population deviation, 1.0 where it is 0."""
    pairs = []
    for c in columns:
        pairs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}")]
    wide = df.groupBy(*keys).agg(F.count("*").alias("n"), *pairs)
    entry = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"m_{c}").alias("mean"),
            F.when(F.col(f"s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"s_{c}")).alias("scale"),
        )
        for c in columns
    ]
    return wide.select(*keys, "n", F.explode(F.array(*entry)).alias("e")).select(
        *keys, "e.feature", "n", "e.mean", "e.scale"
    )


def scaler_transform(df: DataFrame, fitted: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Z-score ``columns`` with the statistics of the row's group (``keys`` may be empty)."""
    if not keys:
        found = {r["feature"]: (r["mean"], r["scale"]) for r in fitted.collect()}  # a row per column
        return df.withColumns({c: (F.col(c) - F.lit(found[c][0])) / F.lit(found[c][1]) for c in columns})
    wide = fitted.groupBy(*keys).pivot("feature", list(columns)).agg(
        F.first("mean").alias("mean"), F.first("scale").alias("scale")
    )
    scaled = {c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_scale") for c in columns}
    return df.join(materialize(wide, "scaler"), list(keys)).withColumns(scaled).select(*df.columns)


def product_name(a: str, b: str) -> str:
    return f"sum_{a}__{b}"


def fold_moments(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], shift: dict[str, float] | None = None
) -> DataFrame:
    """Row count, sums and sums of products of ``columns`` per group.

    ``shift`` is subtracted first; centring near the mean keeps the later
    subtraction of squares accurate.
    """
    shift = shift or {}
    x = {c: F.col(c).cast("double") - F.lit(shift[c]) if c in shift else F.col(c).cast("double") for c in columns}
    sums = [F.sum(x[c]).alias(f"sum_{c}") for c in columns]
    products = [
        F.sum(x[a] * x[b]).alias(product_name(a, b))
        for i, a in enumerate(columns)
        for b in columns[i:]
    ]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *sums, *products)


@dataclass
class Moments:
    """Count, mean vector and centred scatter matrix of a set of rows."""

    n: float
    mean: np.ndarray
    scatter: np.ndarray

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        if n == 0:
            return self
        d = other.mean - self.mean
        return Moments(
            n,
            self.mean + d * (other.n / n),
            self.scatter + other.scatter + np.outer(d, d) * (self.n * other.n / n),
        )

    @property
    def scale(self) -> np.ndarray:
        s = np.sqrt(np.maximum(np.diag(self.scatter), 0) / max(self.n, 1))
        # a column whose spread is rounding noise counts as constant
        flat = s <= 1e-12 * np.maximum(1.0, np.abs(self.mean))
        return np.where(flat, 1.0, s)


def merged(parts: Iterable[Moments]) -> Moments | None:
    total: Moments | None = None
    for part in parts:
        if part.n:
            total = part if total is None else total.merge(part)
    return total


@dataclass
class FoldParts:
    """Moments of each ``(tokenizer, is_english, fold)`` part of the training table."""

    columns: list[str]
    parts: dict[tuple[str, bool, object], Moments]

    def tokenizers(self) -> list[str]:
        return sorted({t for t, _, _ in self.parts})

    def folds(self) -> list:
        return sorted({f for _, _, f in self.parts})

    def training(self, tokenizer: str, scope: str, held_out: object = None) -> Moments | None:
        """Moments of the rows in scope outside ``held_out`` (``None``: of all rows)."""
        return merged(
            m
            for (t, english, fold), m in sorted(self.parts.items(), key=lambda kv: str(kv[0]))
            if t == tokenizer and (scope == "all" or english) and fold != held_out
        )


def collect_fold_parts(table: DataFrame, columns: Sequence[str], targets: Sequence[str]) -> FoldParts:
    """Moments of ``columns`` and one target per (tokenizer, is_english, fold), for all targets in one pass over ``table``.

    A partition multiplies the matrix of its rows of a part once, and once more for each target that is null in some of them: such rows
    take no part in that target's moments. What comes back is tokenizers x 2 x folds matrices, whatever the size of the data.
    """
    columns, targets = list(columns), list(targets)
    names = [*columns, *targets]
    means = table.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in names]).collect()[0].asDict()
    shift = np.array([float(means[c] or 0.0) for c in names])
    folds = sorted(r[0] for r in table.select("fold").distinct().collect())
    k, many = len(columns), len(targets)

    def update(batch: dict, sums: np.ndarray, peaks: np.ndarray) -> None:
        rows = np.column_stack([batch[c] for c in names]) - shift
        missing = np.isnan(rows[:, k:])
        rows[:, k:][missing] = 0.0
        english, fold = batch["is_english"].astype(bool), batch["fold"]
        for i, own in enumerate(folds):
            for j in (0, 1):
                at = np.flatnonzero((fold == own) & (english == bool(j)))
                lost = missing[at].any(axis=0)
                full = _products(rows[at]) if not lost.all() else None
                for t in range(many):
                    one = [*range(k), k + t]
                    if lost[t]:
                        add = _products(rows[at[~missing[at, t]]][:, one])
                    else:
                        add = full[np.ix_([0, *(c + 1 for c in one)], [0, *(c + 1 for c in one)])]
                    sums[i, j, t] += add

    sums, _ = sum_over(table, [*names, "is_english", "fold"], update, (len(folds), 2, many, k + 2, k + 2))
    parts = {}
    for i, fold in enumerate(folds):
        for j in (0, 1):
            for t, target in enumerate(targets):
                n, s, q = sums[i, j, t, 0, 0], sums[i, j, t, 0, 1:], sums[i, j, t, 1:, 1:]
                if n:
                    parts[target, bool(j), fold] = Moments(n, shift[[*range(k), k + t]] + s / n, q - np.outer(s, s) / n)
    return FoldParts([*columns, "y"], parts)


def _products(rows: np.ndarray) -> np.ndarray:
    """Count, sums and products of the columns in one matrix."""
    z = np.column_stack([np.ones(len(rows)), rows])
    return z.T @ z
