"""Forests: the kernel against a plain loop, both ways of growth against each other, nesting, refit and storage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokengauge.functions.text import SELECTED_FEATURES
from tokengauge.operators import metrics
from tokengauge.plans import tree_kernel as kernel
from tokengauge.plans import training, trees

TARGET = ["pretoken"]


@pytest.fixture(scope="module")
def table(spark, sf):
    return training.stored_training_table(spark, sf, SELECTED_FEATURES, None, folds=3)


def plain(x, y, w, path, level, leaf, depth, rule):
    """One tree by a loop over nodes, features and cuts."""
    total, weight = (w * y).sum(), w.sum()
    node = {"value": total / weight, "n": len(y), "level": level}
    if len(y) < 2 * leaf or weight * (w * y * y).sum() <= total * total or level >= depth:
        return node
    best = (-np.inf, None, None)
    for f in range(x.shape[1]):
        low, high = x[:, f].min(), x[:, f].max()
        values = np.unique(x[:, f])
        cuts = kernel.midpoint(values[:-1], values[1:]).tolist()
        if rule == trees.RANDOM:
            cuts = [low + (high - low) * kernel.draws(np.array([path], np.uint64), x.shape[1])[0, f]] if low < high else []
        for cut in cuts:
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) >= leaf:
                gain = kernel.score((w * y)[left].sum(), w[left].sum(), total, weight)
                if gain > best[0]:
                    best = (gain, f, cut)
    if best[1] is None:
        return node
    _, f, cut = best
    left = x[:, f] <= cut
    paths = kernel.child_paths(np.array([path], np.uint64)).tolist()
    sides = [plain(x[s], y[s], w[s], p, level + 1, leaf, depth, rule) for s, p in zip((left, ~left), paths, strict=True)]
    return node | {"feature": f, "cut": cut, "sides": sides}


def compare(nodes, i, want):
    assert nodes.value[i] == pytest.approx(want["value"]) and (nodes.n[i], nodes.level[i]) == (want["n"], want["level"])
    assert nodes.feature[i] == want.get("feature", -1)
    if "feature" in want:
        assert nodes.cut[i] == want["cut"]
        for k, side in enumerate(want["sides"]):
            compare(nodes, nodes.left[i] + k, side)


@pytest.mark.parametrize("rule", [trees.BEST, trees.RANDOM])
@pytest.mark.parametrize("leaf, depth", [(1, 99), (5, 99), (5, 3)])
def test_kernel_equals_a_plain_loop(rule, leaf, depth):
    rng, n = np.random.default_rng(0), 250
    x = np.column_stack([rng.integers(0, 50, n), rng.normal(size=n).round(1), rng.random(n), np.ones(n)])
    y = (x[:, 0] * 3 + rng.integers(0, 20, n)).astype(float)
    paths = np.array([kernel.root_path("t", t) for t in range(3)], np.uint64)
    hashes = kernel.mix(np.arange(n, dtype=np.uint64))
    w = [kernel.bootstrap(hashes, int(p)) if rule == trees.BEST else np.ones(n) for p in paths]
    rows = np.concatenate([np.flatnonzero(v) for v in w])
    node = np.repeat(np.arange(3), [(v > 0).sum() for v in w])
    drawn = np.concatenate([v[v > 0] for v in w])
    mixed = rng.permutation(len(rows))
    one = np.ones(3, int)
    grown = kernel.grow(x[rows][mixed], y[rows][mixed], drawn[mixed], node[mixed], paths, 0 * one, leaf * one, depth * one, rule)
    for t in range(3):
        s = w[t] > 0
        compare(grown, t, plain(x[s], y[s], w[t][s], int(paths[t]), 0, leaf, depth, rule))


@pytest.mark.parametrize("rule", [trees.BEST, trees.RANDOM])
def test_items_are_sorted_once_whatever_the_depth(rule, monkeypatch):
    rng, n = np.random.default_rng(1), 400
    x, zero, sorted_items = rng.normal(size=(n, 3)), np.zeros(1, int), []
    for name in ("argsort", "lexsort"):
        monkeypatch.setattr(np, name, lambda a, *rest, own=getattr(np, name), **options: sorted_items.append(np.size(a)) or own(a, *rest, **options))
    grown = kernel.grow(x, x.sum(axis=1), np.ones(n), np.zeros(n, int), np.ones(1, np.uint64), zero, zero + 1, zero + kernel.UNLIMITED, rule)
    assert grown.level.max() > 6 and sum(sorted_items) <= 3 * n


def test_depth_has_no_limit():
    """Values that double: every cut takes one row off, so a tree is far deeper than 31 levels."""
    n = 90
    x = np.arange(n, dtype=float)[:, None]
    y = 2.0 ** np.arange(n)
    zero = np.zeros(1, int)
    grown = kernel.grow(x, y, np.ones(n), np.zeros(n, int), np.ones(1, np.uint64), zero, zero + 1, zero + kernel.UNLIMITED, trees.BEST)
    assert grown.level.max() > 40


def test_bootstrap_is_a_poisson_sample():
    w = kernel.bootstrap(kernel.mix(np.arange(100_000, dtype=np.uint64)), 7)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.01


def test_bound_holds_for_every_cut_of_a_bin():
    rng = np.random.default_rng(4)
    for _ in range(200):
        y, w = rng.integers(0, 30, 12).astype(float), rng.integers(1, 4, 12).astype(float)
        w0, s0, rest, far = 5.0, rng.integers(0, 100), 7.0, rng.integers(0, 200)
        total, weight = s0 + (w * y).sum() + far, w0 + w.sum() + rest
        bound = trees._bound(w0, s0, w.sum(), (w * y).sum(), y.min(), y.max(), total, weight)
        for k in range(13):
            assert kernel.score(s0 + (w * y)[:k].sum(), w0 + w[:k].sum(), total, weight) <= bound * (1 + 1e-12)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same(a, b):
    assert [r[:-1] for r in a] == [r[:-1] for r in b] and a
    np.testing.assert_allclose([r[-1] for r in a], [r[-1] for r in b], rtol=1e-9, atol=1e-9)


GRID = trees.tree_grid([2, 3], [2, None], [5])


@pytest.mark.parametrize("rule", [trees.BEST, trees.RANDOM])
def test_passes_and_blocks_give_the_same_predictions(table, monkeypatch, rule):
    """A small block: the tops grow by passes over the rows. Small sweeps, slots and windows, and another partitioning change nothing."""
    whole = rows_of(trees.cross_validate(table, TARGET, GRID, rule))
    for name, value in (("SWEEP", 11), ("SLOTS", 7), ("WINDOWS", 5), ("BINS", 4)):
        monkeypatch.setattr(trees, name, value)
    same(whole, rows_of(trees.cross_validate(table.repartition(3), TARGET, GRID, rule, scopes=["all", "english"], block=60)))


@pytest.mark.parametrize("rule", [trees.BEST, trees.RANDOM])
def test_nested_growth_equals_separate_fits(table, rule):
    """Scores of a grid are those of each configuration on its own, and of stored trees that did not see the fold."""
    whole = rows_of(trees.cross_validate(table, TARGET, GRID, rule).drop("config_id"))
    assert len(whole) == len(GRID) * (table.count() + table.where("is_english").count())
    for config in GRID:
        alone = rows_of(trees.cross_validate(table, TARGET, [config], rule).drop("config_id"))
        same([r for r in whole if r[0] == config.name], alone)
    model = trees.fit(table, [("pretoken", "all", GRID[0])], rule, fold=1)
    stored = rows_of(trees.predict(table, model).select("config", "tokenizer", "scope", "fold", "doc_id", "y", "yhat"))
    same([r for r in whole if r[0] == GRID[0].name and r[2:4] == ("all", 1)], stored)


@pytest.mark.parametrize("rule", [trees.BEST, trees.RANDOM])
def test_stored_trees_in_pieces_and_slices(table, monkeypatch, rule):
    chosen = [("pretoken", "all", trees.TreeConfig(3, None, 5)), ("pretoken", "english", trees.TreeConfig(2, 3, 10))]
    model = trees.fit(table, chosen, rule)
    whole = rows_of(trees.predict(table, model))
    plan = trees.predict(table, model)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    pieces = trees.fit(table, chosen, rule, block=50)
    assert model.count() == 5 and pieces.count() > 5
    same(whole, rows_of(trees.predict(table, pieces)))
    monkeypatch.setattr(trees, "MODEL_NODES", 40)
    same(whole, rows_of(trees.predict(table, pieces)))


def test_limits_hold(table):
    for r in trees.fit(table, [("pretoken", "all", trees.TreeConfig(2, 4, 7))], trees.RANDOM).collect():
        assert min(r["n"]) >= 7 and max(r["level"]) <= 4 and r["n"][0] == table.count()
        for f, left, n in zip(r["feature"], r["left"], r["n"], strict=True):
            assert f < 0 or r["n"][left] + r["n"][left + 1] == n


def test_missing_targets_and_empty_cells(spark, table):
    some = table.withColumn("pretoken", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("pretoken"))).withColumn("is_english", F.lit(False))
    got = trees.cross_validate(some, TARGET, GRID[:1], trees.BEST)
    assert got.where("scope = 'english'").count() == 0 and got.where("scope = 'all'").count() == some.where("pretoken is not null").count()
    assert trees.cross_validate(table.limit(0), TARGET, GRID, trees.BEST, folds=[0]).count() == 0
    few = table.limit(2).withColumn("fold", F.monotonically_increasing_id() % 2)
    assert trees.cross_validate(few, TARGET, GRID[:1], trees.BEST, scopes=["all"], folds=[0, 1]).count() <= 2


@pytest.mark.parametrize("rule", [trees.BEST, trees.RANDOM])
def test_grid_search_refits_the_winner(table, rule):
    assert len(trees.tree_grid()) == 12
    ranked, model = trees.grid_search(table, TARGET, GRID, rule)
    found = ranked.collect()
    assert len(found) == 2 * len(GRID) and all(r["r2_mean"] > 0.3 for r in found)
    first = {r["scope"]: min((-r["r2_mean"], r["config_id"], r["config"]) for r in found if r["scope"] == s)[2] for s in ("all", "english") for r in found if r["scope"] == s}
    assert {(r["scope"], r["config"]) for r in model.select("scope", "config").distinct().collect()} == set(first.items())
    scored = metrics.regression_metrics(trees.predict(table, model), ["scope"]).collect()
    assert len(scored) == 2 and all(r["r2"] > 0.5 for r in scored)


def test_stored_forests_do_not_store_their_items(spark, table, tmp_path, monkeypatch):
    stored, own = [], trees.materialize
    monkeypatch.setattr(trees, "materialize", lambda df, name="table": stored.append(name) or own(df, name))
    chosen = [("pretoken", "all", trees.TreeConfig(2, 4, 5))]
    by_passes = trees.fit(table, chosen, trees.RANDOM, block=40)
    assert by_passes.where("piece >= 0").count() and "tree-items" not in stored
    assert "tree-rows" in stored


def test_ranges_of_open_nodes(spark, table):
    names = list(SELECTED_FEATURES)
    narrow = trees.narrow_rows(table, TARGET, names, "doc_id")
    forests = [trees.Forest("pretoken", s, f, 5, 1, 9) for s in ("all", "english") for f in (0, trees.NO_FOLD)]
    tops = [trees.Top(i, 0, path=[f.path(trees.RANDOM, 1, 0)]) for i, f in enumerate(forests)]
    sums, low, high = trees._Passes(narrow, names, forests, tops, trees.RANDOM, 1).stats([(i, 0) for i in range(4)])
    rows = narrow.toPandas()
    for i, f in enumerate(forests):
        own = rows[(rows.is_english | (f.scope == "all")) & (rows.fold != f.fold)]
        assert sums[i, 0] == len(own) and (low[i] == own[names].min()).all() and (high[i] == own[names].max()).all()
