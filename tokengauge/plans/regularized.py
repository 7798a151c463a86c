"""Ridge, lasso and elastic net for the whole grid from one pass of fold moments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokengauge.functions.text import REGULARIZED_FEATURES
from tokengauge.operators.metrics import METRICS, regression_metrics, to_long
from tokengauge.operators.moments import FoldParts, Moments, collect_fold_parts
from tokengauge.operators.rows import SCOPES
from tokengauge.plans.training import long_targets, params_schema, predict_linear
from tokengauge.session import local_table, materialize


@dataclass(frozen=True)
class Penalty:
    """``alpha`` and ``l1_ratio`` of a penalized least-squares fit.

    ``ridge``: ||y - Xw||^2 + alpha ||w||^2. Otherwise:
    ||y - Xw||^2 / 2n + alpha l1_ratio ||w||_1 + alpha (1 - l1_ratio) ||w||^2 / 2.
    """

    name: str
    kind: str
    alpha: float
    l1_ratio: float = 1.0


PENALTIES = [
    Penalty("ridge_1", "ridge", 1.0),
    Penalty("ridge_10", "ridge", 10.0),
    Penalty("lasso_0.01", "lasso", 0.01),
    Penalty("lasso_0.1", "lasso", 0.1),
    Penalty("elasticnet_0.01", "elasticnet", 0.01, 0.5),
]
OLS = Penalty("ols", "ridge", 0.0)


def standardized(moments: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram matrix and cross moments of z-scored columns, and the scales; the last column is y."""
    scale = moments.scale[:-1]
    gram = moments.scatter[:-1, :-1] / np.outer(scale, scale) / moments.n
    return gram, moments.scatter[:-1, -1] / scale / moments.n, scale


def solve_ridge(gram: np.ndarray, cross: np.ndarray, n: float, alpha: float) -> np.ndarray:
    if alpha == 0:
        return np.linalg.lstsq(gram, cross, rcond=None)[0]
    return np.linalg.solve(gram + np.eye(len(cross)) * (alpha / n), cross)


def _polish(gram: np.ndarray, cross: np.ndarray, w: np.ndarray, l1: float, l2: float) -> np.ndarray | None:
    """The exact solution on the signs of ``w``, if it meets the optimality conditions."""
    on = w != 0
    out = np.zeros_like(w)
    if on.any():
        try:
            out[on] = np.linalg.solve(gram[np.ix_(on, on)] + l2 * np.eye(on.sum()), cross[on] - l1 * np.sign(w[on]))
        except np.linalg.LinAlgError:
            return None
        if (np.sign(out[on]) != np.sign(w[on])).any():
            return None
    slope = cross - gram @ out
    slack = 1e-9 * max(1.0, float(np.abs(cross).max()))
    return out if (np.abs(slope[~on]) <= l1 + slack).all() else None


def solve_l1(
    grams: np.ndarray, crosses: np.ndarray, l1: np.ndarray, l2: np.ndarray,
    max_iter: int = 20_000, tol: float = 1e-9, polish_every: int = 50,
) -> np.ndarray:
    """Coordinate descent on the Gram matrices of many fits at once (one row per fit).

    Correlated features make plain descent slow; once it has found which
    weights are zero, the rest is a linear system.
    """
    result = np.zeros_like(crosses)
    left = np.arange(len(crosses))
    w, slope = result.copy(), crosses.copy()  # slope = cross - gram @ w
    limit = tol * np.maximum(1.0, np.abs(crosses).max(axis=1))
    for sweep in range(1, max_iter + 1):
        diagonal = np.einsum("bii->bi", grams[left])
        moved = np.zeros(len(left))
        for j in range(w.shape[1]):
            d = diagonal[:, j]
            rho = slope[:, j] + d * w[:, j]
            new = np.sign(rho) * np.maximum(np.abs(rho) - l1[left], 0.0) / np.where(d > 0, d + l2[left], 1.0)
            step = np.where(d > 0, new - w[:, j], 0.0)
            w[:, j] += step
            slope -= grams[left, :, j] * step[:, None]
            np.maximum(moved, np.abs(step), out=moved)
        done = moved <= limit[left]
        if sweep % polish_every == 0:
            for i in np.flatnonzero(~done):
                b = left[i]
                exact = _polish(grams[b], crosses[b], w[i], l1[b], l2[b])
                if exact is not None:
                    w[i], done[i] = exact, True
        if done.any() or sweep == max_iter:
            result[left] = w
            left, w, slope = left[~done], w[~done], slope[~done]
        if not len(left):
            break
    return result


def fit_grid(
    parts: FoldParts,
    penalties: Sequence[Penalty] = tuple(PENALTIES),
    scopes: Sequence[str] = tuple(SCOPES),
    held_out: Sequence | None = None,
) -> list[tuple]:
    """Parameter rows for every penalty, tokenizer, scope and held-out fold.

    A fold without training rows gives no row.
    """
    cells = []
    for tokenizer in parts.tokenizers():
        for scope in scopes:
            for fold in parts.folds() if held_out is None else held_out:
                train = parts.training(tokenizer, scope, fold)
                if train is not None and train.n >= 2:
                    gram, cross, scale = standardized(train)
                    cells += [(p, tokenizer, scope, fold, train, gram, cross, scale) for p in penalties]
    lassos = [i for i, c in enumerate(cells) if c[0].kind != "ridge"]
    weights: dict[int, np.ndarray] = {}
    if lassos:
        alpha = np.array([cells[i][0].alpha for i in lassos])
        ratio = np.array([cells[i][0].l1_ratio for i in lassos])
        found = solve_l1(
            np.array([cells[i][5] for i in lassos]), np.array([cells[i][6] for i in lassos]),
            alpha * ratio, alpha * (1.0 - ratio),
        )
        weights = dict(zip(lassos, found))
    rows = []
    for i, (penalty, tokenizer, scope, fold, train, gram, cross, scale) in enumerate(cells):
        w = weights[i] if i in weights else solve_ridge(gram, cross, train.n, penalty.alpha)
        coefs = w / scale
        intercept = float(train.mean[-1] - coefs @ train.mean[:-1])
        rows.append((penalty.name, tokenizer, scope, fold, intercept, coefs.tolist()))
    return rows


def parameters_of(spark: SparkSession, total: Moments, features: Sequence[str], penalties: Sequence[Penalty]) -> DataFrame:
    """``model, n, feature, value`` of fits on one set of moments (the target last); the intercept is a feature of its own.

    No row for moments of fewer than two rows.
    """
    parts = FoldParts([*features, "y"], {("y", True, 0): total})
    rows = [
        (model, int(total.n), name, float(value))
        for model, _, _, _, intercept, coefs in fit_grid(parts, penalties, ["all"], held_out=[None])
        for name, value in zip(["intercept", *features], [intercept, *coefs])
    ]
    return local_table(spark, rows, "model string, n long, feature string, value double")


def cross_validate(
    table: DataFrame,
    targets: Sequence[str],
    features: Sequence[str] = tuple(REGULARIZED_FEATURES),
    penalties: Sequence[Penalty] = tuple(PENALTIES),
    scopes: Sequence[str] = tuple(SCOPES),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Predictions of held-out rows for the whole grid. ``table`` should be stored."""
    features = list(features)
    long = long_targets(table, targets)
    parts = collect_fold_parts(table, features, targets)
    params = local_table(table.sparkSession, 
        fit_grid(parts, penalties, scopes), params_schema(table.schema["fold"].dataType)
    )
    return predict_linear(long, params, features, keep=keep)


def cv_metrics(predictions: DataFrame, wide: bool = False) -> DataFrame:
    """Metrics per model, tokenizer, scope and fold, in long form unless ``wide``."""
    keys = ["model", "tokenizer", "scope", "fold"]
    out = regression_metrics(materialize(predictions, "predictions"), keys)
    return out if wide else to_long(out, keys, METRICS)


def univariate_search(table: DataFrame, target: str, candidates: Sequence[str], penalty: Penalty = OLS) -> DataFrame:
    """Held-out predictions of one-feature fits; the feature is the configuration."""
    out = None
    for i, feature in enumerate(candidates):
        p = cross_validate(table, [target], [feature], [penalty]).select(
            F.lit(i).alias("config_id"), F.lit(feature).alias("config"), "*"
        )
        out = p if out is None else out.unionByName(p)
    return out


def final_parameters(table: DataFrame, targets: Sequence[str], features: Sequence[str], penalty: Penalty) -> DataFrame:
    """Fit on all rows of each scope: one parameter row per tokenizer and scope."""
    parts = collect_fold_parts(table, list(features), targets)
    return local_table(table.sparkSession, 
        fit_grid(parts, [penalty], held_out=[None]), params_schema(T.IntegerType())
    )
