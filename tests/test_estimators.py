"""Estimators against NumPy, on invariances, and against the mean predictor."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokengauge.functions.text import REGULARIZED_FEATURES, SELECTED_FEATURES
from tokengauge.operators import folds, metrics, moments
from tokengauge.plans import best_params, boost, final, mlp, regularized, robust, scoring, training, trees
from tokengauge.session import local_table, materialize
from tokengauge.sources import corpus

TARGET = ["pretoken"]
KEYS = ["model", "tokenizer", "scope", "fold"]


@pytest.fixture(scope="module")
def table(spark, sf):
    return training.stored_training_table(
        spark, sf, sorted({*REGULARIZED_FEATURES, *SELECTED_FEATURES}), None, folds=3, gap_words=True
    )


@pytest.fixture(scope="module")
def local(table):
    return table.orderBy("doc_id").toPandas()


def chosen(local, scope, fold, inside=False):
    rows = local if scope == "all" else local[local.is_english]
    if fold is None:
        return rows
    return rows[rows.fold == fold] if inside else rows[rows.fold != fold]


def scaled(rows, features):
    x = rows[features].to_numpy(float)
    mean, std = x.mean(axis=0), x.std(axis=0)
    scale = np.where(std < 1e-9, 1.0, std)
    return (x - mean) / scale, mean, scale


def test_penalized_fits_are_optimal(table, local):
    features = list(REGULARIZED_FEATURES)
    parts = regularized.collect_fold_parts(table, features, TARGET)
    checked = 0
    for name, _, scope, fold, intercept, coefs in regularized.fit_grid(parts):
        penalty = next(p for p in regularized.PENALTIES if p.name == name)
        rows = chosen(local, scope, fold)
        z, mean, scale = scaled(rows, features)
        y = rows.pretoken.to_numpy(float)
        w = np.array(coefs) * scale
        n = len(y)
        if penalty.kind == "ridge":
            want = np.linalg.solve(z.T @ z + penalty.alpha * np.eye(len(w)), z.T @ (y - y.mean()))
            np.testing.assert_allclose(z @ w, z @ want, rtol=1e-6, atol=1e-6)
        else:
            l1, l2 = penalty.alpha * penalty.l1_ratio, penalty.alpha * (1 - penalty.l1_ratio)
            slope = z.T @ (y - y.mean() - z @ w) / n - l2 * w
            on = np.abs(w) > 0
            np.testing.assert_allclose(slope[on], l1 * np.sign(w[on]), atol=1e-5)
            assert (np.abs(slope[~on]) <= l1 + 1e-5).all()
        assert intercept == pytest.approx(y.mean() - mean @ (w / scale), rel=1e-9, abs=1e-6)
        checked += 1
    assert checked == 5 * 2 * 3


def test_predictions_are_of_unseen_rows_only(table, local):
    p = regularized.cross_validate(table, TARGET, ["char_count"], [regularized.OLS], keep=["doc_id"]).collect()
    for scope in ("all", "english"):
        got = sorted((r["doc_id"], r["fold"]) for r in p if r["scope"] == scope)
        rows = chosen(local, scope, None)
        assert got == sorted(zip(rows.doc_id, rows.fold))
    r = p[0]
    rows = chosen(local, r["scope"], r["fold"])
    slope, cut = np.polyfit(rows.char_count, rows.pretoken, 1)
    x = local.set_index("doc_id").char_count[r["doc_id"]]
    assert r["yhat"] == pytest.approx(slope * x + cut, rel=1e-6)


def huber_objective(z, t, beta):
    r = t - z @ beta
    a = np.abs(r)
    loss = np.where(a <= 0.1, 0.5 * r * r, 0.1 * a - 0.005).mean()
    return loss + 0.5 * robust.ALPHA * beta[1:] @ beta[1:]


def test_huber_line(table, local):
    cells = robust.fit(table, robust.make_cells(table, TARGET, [("char_count", 1)], True, with_final=True))
    assert len(cells) == 2 * 4
    for c in cells:
        rows = chosen(local, c.scope, c.fold)
        z, mean, scale = scaled(rows, ["char_count"])
        z = np.column_stack([np.ones(len(z)), z])
        y = rows.pretoken.to_numpy(float)
        t = (y - y.mean()) / y.std()
        r = t - z @ c.beta
        gradient = -np.clip(r, -0.1, 0.1) @ z / len(t) + robust.ALPHA * np.array([0, c.beta[1]])
        assert np.abs(gradient).max() < 1e-5
        best = huber_objective(z, t, c.beta)
        for move in np.eye(2) * 1e-2:
            assert best < huber_objective(z, t, c.beta + move)
            assert best < huber_objective(z, t, c.beta - move)
        # raw parameters undo both scalings: a = a_s sy / sx, b = ym - a xm + b_s sy
        cut, coefs = c.raw()
        a = c.beta[1] * y.std() / scale[0]
        assert coefs[0] == pytest.approx(a) and cut == pytest.approx(y.mean() - a * mean[0] + c.beta[0] * y.std())


def test_polynomial_leaves_groups_out(table, local):
    grouped = folds.group_fold(table, "source").where("source in ('src0', 'src1', 'src2')")
    shapes = [("char_count", 2), ("gap_word_count", 3)]
    cells = robust.fit(grouped, robust.make_cells(grouped, TARGET, shapes, False))
    assert {c.fold for c in cells} == {"src0", "src1", "src2"}
    some = local[local.source.isin(["src0", "src1", "src2"])]
    for c in cells:
        rows = some if c.scope == "all" else some[some.is_english]
        rows = rows[rows.source != c.fold]
        powers = rows[c.feature].to_numpy(float)[:, None] ** np.arange(1, c.degree + 1)
        z = np.column_stack([np.ones(len(rows)), (powers - powers.mean(axis=0)) / powers.std(axis=0)])
        np.testing.assert_allclose(c.design(rows[c.feature].to_numpy(float)), z, rtol=1e-6, atol=1e-8)
        t = rows.pretoken.to_numpy(float)
        best = huber_objective(z, t, c.beta)
        # nearly an absolute loss: the slope can only be small next to epsilon
        assert c.gradient < 0.02
        for j in range(len(c.beta)):
            for move in (1.0, -1.0):
                beta = c.beta.copy()
                beta[j] += move
                assert best < huber_objective(z, t, beta) + 1e-3
    out = metrics.regression_metrics(robust.predictions(grouped, TARGET, cells), KEYS).collect()
    want = sum(len({s}) for s in some.source.unique()) * 2 + sum(some.is_english.groupby(some.source).any()) * 2
    assert len(out) == want


def test_a_group_without_rows_in_scope_gives_no_row(spark):
    data = [(i, "g%d" % (i % 3), i % 3 != 0, i % 3, float(i), i * 2) for i in range(60)]
    df = spark.createDataFrame(
        data, "doc_id long, source string, is_english boolean, fold int, char_count double, pretoken long"
    )
    p = regularized.cross_validate(df, TARGET, ["char_count"], [regularized.OLS])
    got = {(r["scope"], r["fold"]) for r in p.select("scope", "fold").distinct().collect()}
    assert got == {("all", 0), ("all", 1), ("all", 2), ("english", 1), ("english", 2)}


def test_results_do_not_depend_on_partitioning(table):
    def fit(t):
        c = robust.fit(t, robust.make_cells(t, TARGET, [("char_count", 1)], True))
        b = boost.fit(t, TARGET, rounds=3)
        return np.concatenate([x.beta for x in c]), np.array([m.log_odds for m in b])

    one, other = fit(table.repartition(1)), fit(table.orderBy(F.rand(1)).repartition(40))
    np.testing.assert_allclose(one[0], other[0], rtol=1e-6)
    np.testing.assert_allclose(one[1], other[1], rtol=1e-6)


def boosted_by_hand(z, y, rounds):
    w, learners, odds = np.ones(len(y)) / len(y), [], []
    x = np.column_stack([np.ones(len(z)), z])
    for _ in range(rounds):
        a = (x * w[:, None]).T @ x + np.diag([0.0] + [boost.ALPHA] * z.shape[1])
        beta = np.linalg.lstsq(a, (x * w[:, None]).T @ y, rcond=None)[0]
        e = np.abs(y - x @ beta)
        loss = e / e.max()
        mean = w @ loss
        if mean >= 0.5:
            break
        b = mean / (1 - mean)
        learners.append(beta)
        odds.append(np.log(1 / b))
        w = w * b ** ((1 - loss) * boost.LEARNING_RATE)
        w /= w.sum()
    scores = x @ np.array(learners).T
    out = []
    for s in scores:
        order = np.argsort(s)
        total = np.cumsum(np.array(odds)[order])
        out.append(s[order[np.searchsorted(total, 0.5 * total[-1])]])
    return odds, np.array(out)


def test_boost_equals_a_plain_loop(table, local):
    features = list(SELECTED_FEATURES)
    in_tasks = boost.fit(table, TARGET, rounds=7, held_out=[None])
    by_passes = boost.fit(table, TARGET, rounds=7, held_out=[None], block=0)
    assert len(in_tasks) == len(by_passes) == 2
    for m in [*in_tasks, *by_passes]:
        rows = chosen(local, m.scope, None)
        z, _, _ = scaled(rows, features)
        odds, predicted = boosted_by_hand(z, rows.pretoken.to_numpy(float), 7)
        np.testing.assert_allclose(m.log_odds, odds, rtol=1e-6)
        np.testing.assert_allclose(m.predict(rows[features].to_numpy(float)), predicted, rtol=1e-6)


def scores(predictions, keys):
    return {tuple(r[k] for k in keys): r for r in metrics.regression_metrics(materialize(predictions), keys).collect()}


def test_boost_beats_the_mean(table):
    found = scores(boost.predict(table, boost.fit(table, TARGET, rounds=5)), KEYS)
    assert len(found) == 6 and all(r["r2"] > 0.5 for r in found.values())


def test_mlp(table, local):
    config = mlp.MLPConfig((6, 4), "tanh", 0.01)
    net = mlp.Network(0, config, "pretoken", "all", None, 50.0, np.zeros(7), np.ones(7))
    rng = np.random.default_rng(0)
    x, y, w = rng.normal(size=(50, 7)), 300 + 90 * rng.normal(size=50), net.initial(1)
    _, grad = net.gradient(x, y, w)
    for j in rng.integers(0, len(w), 12):
        step = np.zeros(len(w))
        step[j] = 1e-5
        slope = (net.gradient(x, y, w + step)[0] - net.gradient(x, y, w - step)[0]) / 2e-5
        assert grad[j] == pytest.approx(slope, rel=1e-4, abs=1e-3)
    grid = [mlp.MLPConfig((12,)), config]
    quick = mlp.Solver(rate=0.1, batch=20, max_iter=150)
    nets = mlp.fit(table, TARGET, grid, solver=quick)
    assert len(nets) == 2 * 2 * 3 and any(n.stopped for n in nets)
    found = scores(mlp.predict(table, nets), ["config_id", *KEYS])
    assert len(found) == 2 * 2 * 3 and all(r["r2"] > 0.5 for r in found.values() if r["config_id"] == 0)


@pytest.mark.parametrize("early", [True, False])
def test_mlp_by_tasks_by_passes_and_in_a_plain_loop(table, local, early):
    config, solver = mlp.MLPConfig((5, 3), "relu", 0.01), mlp.Solver(rate=0.05, batch=32, max_iter=40, patience=3, dtype="float64", early_stopping=early)
    one = materialize(table.coalesce(1).sortWithinPartitions("doc_id"))
    by_tasks, = mlp.fit(table, TARGET, [config], scopes=["all"], held_out=[0], solver=solver)
    by_passes, = mlp.fit(one, TARGET, [config], scopes=["all"], held_out=[0], solver=solver, block=0, sweep_weights=1)
    np.testing.assert_allclose(by_tasks.weights, by_passes.weights, rtol=1e-9)
    assert (by_tasks.epochs, by_tasks.stopped) == (by_passes.epochs, by_passes.stopped)
    # the plain loop: layer by layer, on the objective as stated
    rows = chosen(local, "all", 0).sort_values("doc_id")
    keep = np.array([int(hashlib.md5(f"valid-42:{k}".encode()).hexdigest()[:8], 16) % 10 == 0 for k in rows.doc_id]) & early
    x, y = rows[list(SELECTED_FEATURES)].to_numpy(float), rows.pretoken.to_numpy(float)
    scale = np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1.0)
    z = (x - x.mean(axis=0)) / scale
    weights = [[w.copy(), b.copy()] for w, b in by_tasks.layers(by_tasks.initial(mlp.SEED))]
    ms, vs = ([[np.zeros_like(p) for p in pair] for pair in weights] for _ in range(2))

    def outputs(inputs):
        acts = [inputs]
        for i, (w, b) in enumerate(weights):
            acts.append(acts[-1] @ w + b if i == 2 else np.maximum(acts[-1] @ w + b, 0))
        return acts

    best, best_weights, low, stale, t = -np.inf, None, np.inf, 0, 0
    zt, yt = z[~keep], y[~keep]
    for epoch in range(40):
        order, loss = np.random.default_rng([mlp.SEED, epoch]).permutation(len(yt)), 0.0
        for start in range(0, len(yt), 32):
            at = order[start : start + 32]
            acts = outputs(zt[at])
            delta = acts[-1] - yt[at][:, None]
            loss += 0.5 * (delta**2).sum() + 0.005 * sum((w**2).sum() for w, _ in weights)
            grads = []
            for i in (2, 1, 0):
                grads.insert(0, [(acts[i].T @ delta + 0.01 * weights[i][0]) / len(at), delta.mean(axis=0)])
                delta = (delta @ weights[i][0].T) * (acts[i] > 0)
            t += 1
            for pair, gs, m, v in zip(weights, grads, ms, vs):
                for j in (0, 1):
                    m[j] = 0.9 * m[j] + 0.1 * gs[j]
                    v[j] = 0.999 * v[j] + 0.001 * gs[j] ** 2
                    pair[j] = pair[j] - 0.05 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m[j] / (np.sqrt(v[j]) + 1e-8)
        flat = np.concatenate([p.ravel() for pair in weights for p in pair])
        if early:
            r2 = 1 - ((outputs(z[keep])[-1][:, 0] - y[keep]) ** 2).sum() / ((y[keep] - y[keep].mean()) ** 2).sum()
            stale = stale + 1 if r2 < best + 1e-4 else 0
            if r2 > best:
                best, best_weights = r2, flat
        else:
            stale = stale + 1 if loss / len(yt) > low - 1e-4 else 0
            low, best_weights = min(low, loss / len(yt)), flat
        if stale > 3:
            break
    assert by_tasks.epochs == epoch + 1
    np.testing.assert_allclose(by_tasks.weights, best_weights, rtol=1e-6, atol=1e-9)


def test_mlp_averaged_over_partitions_learns(table, local):
    solver = mlp.Solver(rate=0.1, batch=8, max_iter=40, early_stopping=False)
    parted = materialize(table.repartition(4, "doc_id"))
    net, = mlp.fit(parted, TARGET, [mlp.MLPConfig((12,))], scopes=["all"], held_out=[0], solver=solver, block=0)
    inside = chosen(local, "all", 0, inside=True)
    errors = net.predict(inside[list(SELECTED_FEATURES)].to_numpy(float)) - inside.pretoken
    assert net.epochs == 40 and float((errors**2).mean()) < 0.5 * float(inside.pretoken.var())


def test_final_models_survive_the_disk(table, spark, tmp_path):
    chosen = {("rf", "all"): (4, 4, 5), ("rf", "english"): (3, 3, 5), ("et", "all"): (4, 4, 5), ("et", "english"): (4, 5, 5)}
    rows = [(m, "pretoken", s, *t, None, None, None) for (m, s), t in chosen.items()]
    rows += [("mlp", "pretoken", s, None, None, None, "relu", 1e-4, hidden) for s, hidden in (("all", "6"), ("english", "5,3"))]
    params = local_table(spark, rows, best_params.DDL)
    out = final.train_and_score(table, TARGET, str(tmp_path), params, rounds=4, solver=mlp.Solver(rate=0.1, batch=20, max_iter=150, early_stopping=False)).collect()
    assert sorted((r["model"], r["scope"]) for r in out) == sorted(
        (m, s) for m in ("linear", "linear_boost", "mlp", "et", "rf") for s in ("all", "english")
    )
    assert all(r["r2"] > 0.5 for r in out)
    configs = {(r["model"], r["scope"]): r["config"] for r in out}
    assert configs["rf", "english"] == "n=3,depth=3,leaf=5" and configs["et", "english"] == "n=4,depth=5,leaf=5"
    assert "(5, 3)" in configs["mlp", "english"] and "(6,)" in configs["mlp", "all"]
    with pytest.raises(KeyError):
        final.chosen_params(table, TARGET, params.where("scope = 'all'"))
    cell = [("pretoken", "all", trees.TreeConfig(4, 4, 5))]
    model = trees.fit(table, cell, trees.BEST)
    again = trees.load(spark, trees.save(model, str(tmp_path / "again")))
    one = trees.predict(table, model).orderBy("doc_id").collect()
    assert one == trees.predict(table, again).orderBy("doc_id").collect() and len(one) == table.count()


def test_search_winners_are_trained_and_scored_in_one_pass(table, spark, tmp_path):
    quick = mlp.Solver(rate=0.1, batch=20, max_iter=30, early_stopping=False)
    networks = [mlp.MLPConfig((4,)), mlp.MLPConfig((10,)), mlp.MLPConfig((3, 2), "tanh")]
    grid = [trees.TreeConfig(3, 1, 40), trees.TreeConfig(3, 6, 5)]
    ranked, refitted = mlp.grid_search(table, TARGET, networks, solver=quick)
    searches = {"mlp": (ranked, networks)}
    for model, rule in (("rf", trees.BEST), ("et", trees.RANDOM)):
        searches[model] = materialize(trees.summarized(trees.cross_validate(table, TARGET, grid, rule))), grid
    params = final.searched_params(table, searches)
    for model, (found, configs) in searches.items():
        for scope in ("all", "english"):
            rows = sorted(found.where(F.col("scope") == scope).collect(), key=lambda r: (-r["r2_mean"], r["config_id"]))
            assert len(rows) == len(configs) and rows[0]["rank"] == 1
            want = params.where((F.col("model") == model) & (F.col("scope") == scope)).first()
            assert (final.network_config(want) if model == "mlp" else final.tree_config(want)) == configs[rows[0]["config_id"]]
    place = str(tmp_path)
    out = final.train_and_score(table, TARGET, place, params, rounds=3, solver=quick).collect()
    assert len(out) == 10
    kept = {(n.tokenizer, n.scope): n for n in mlp.from_table(spark.read.parquet(f"{place}/mlp"))}
    for net in refitted:
        np.testing.assert_allclose(net.weights, kept[net.tokenizer, net.scope].weights)

    scored = scoring.score_stored(table, place)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    got = {}
    for r in scored.collect():
        got[r["model"], r["scope"], r["doc_id"]] = r["yhat"]
    assert len(got) == scored.count()
    for model in ("rf", "et"):
        for r in trees.predict(table, trees.load(spark, f"{place}/{model}")).collect():
            assert got.pop((model, r["scope"], r["doc_id"])) == r["yhat"]
    local = {r["doc_id"]: r for r in table.collect()}
    x = lambda k: np.array([[local[k][f] for f in SELECTED_FEATURES]], float)
    lines = {r["scope"]: r for r in spark.read.parquet(f"{place}/linear").collect()}
    boosters = {b.scope: b for b in boost.from_table(spark.read.parquet(f"{place}/linear_boost"))}
    for (model, scope, k), value in got.items():
        if model == "linear":
            want = lines[scope]["intercept"] + lines[scope]["coef"] * local[k]["char_count"]
        else:
            want = (boosters[scope] if model == "linear_boost" else kept["pretoken", scope]).predict(x(k))[0]
        assert value == pytest.approx(want, rel=1e-9)


def test_scoring_of_forests_beyond_a_slice(table, spark, tmp_path, monkeypatch):
    params = [(m, "pretoken", s, 4, 5, 5, None, None, None) for m in ("rf", "et") for s in ("all", "english")]
    params += [("mlp", "pretoken", s, None, None, None, "relu", 1e-4, "3") for s in ("all", "english")]
    quick = mlp.Solver(max_iter=2, early_stopping=False)
    final.train_and_score(table, TARGET, str(tmp_path), local_table(spark, params, best_params.DDL), rounds=2, solver=quick)
    keys = ["model", "scope", "doc_id"]
    rows = lambda: {tuple(r[k] for k in keys): r["yhat"] for r in scoring.score_stored(table, str(tmp_path)).collect()}
    whole = rows()
    monkeypatch.setattr(trees, "MODEL_NODES", 20)
    assert rows() == pytest.approx(whole, rel=1e-12)


def test_prediction_does_not_shuffle_rows(table):
    p = regularized.cross_validate(table, TARGET, ["char_count"], [regularized.OLS])
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_null_texts(spark):
    data = [(1, "a b", "English", "s"), (2, None, "English", "s"), (3, "", None, "s")]
    docs = spark.createDataFrame(data, "doc_id long, content string, language string, source string")
    kept = training.training_table(docs, ["char_count"], None, gap_words=True)
    got = {r["doc_id"]: (r["char_count"], r["gap_word_count"], r["is_english"]) for r in kept.collect()}
    assert got == {1: (3.0, 2.0, True), 2: (4.0, 1.0, True), 3: (0.0, 1.0, False)}
    assert training.training_table(docs, ["char_count"], None, drop_null_content=True).count() == 2


def test_training_table_has_no_text(spark, sf):
    t = training.training_table(corpus.documents(spark, sf), ["char_count"], None)
    assert t.columns == ["doc_id", "source", "is_english", "fold", "char_count", "pretoken"]


def test_pairs_and_passes_give_the_row_wise_fit(table, local):
    """Compacted rows: by tasks, by passes over the pairs, and all rows in one plain loop give the same lines and polynomials."""
    shapes = [("char_count", 1), ("char_count", 3), ("gap_word_count", 2)]
    make = lambda: robust.make_cells(table, TARGET, shapes, scale_target=True, with_final=True)
    in_tasks, by_passes, by_rows = robust.fit(table, make()), robust.fit(table, make(), block=0), make()
    pairs = robust.compacted(table, [("char_count", "pretoken")])
    assert pairs.count() < table.count() == pairs.agg(F.sum("weight")).collect()[0][0]
    for a, b, c in zip(in_tasks, by_passes, by_rows, strict=True):
        rows = {"x": local[c.feature].to_numpy(), "y": local.pretoken.to_numpy(float), "is_english": local.is_english.to_numpy(), "fold": local.fold.to_numpy(), "weight": np.ones(len(local))}
        robust._solve(robust.block_pass(rows), [c], 500, 1e-6)
        assert a.done and b.done and c.done
        np.testing.assert_allclose(a.beta, c.beta, rtol=1e-5, atol=1e-7)
        np.testing.assert_allclose(b.beta, c.beta, rtol=1e-5, atol=1e-7)
    few = robust.fit(table, make(), max_iter=2)
    assert not any(c.done for c in few)


def test_moments_of_all_targets_in_one_pass(spark, table, local):
    """Targets with nulls in different rows, in some parts only; no target is unpivoted before its moments."""
    two = table.withColumn("other", F.when((F.col("doc_id") % 5 == 1) | (F.col("fold") == 2), F.lit(None)).otherwise(F.col("pretoken") * 2 + F.col("doc_id") % 3))
    columns = ["char_count", "word_count"]
    parts = moments.collect_fold_parts(two.repartition(3), columns, ["pretoken", "other"])
    local = two.toPandas()
    assert parts.columns == [*columns, "y"] and parts.tokenizers() == ["other", "pretoken"]
    for (target, english, fold), m in parts.parts.items():
        rows = local[(local.is_english == english) & (local.fold == fold) & local[target].notna()]
        z = rows[[*columns, target]].to_numpy(float)
        assert m.n == len(rows)
        np.testing.assert_allclose(m.mean, z.mean(axis=0), rtol=1e-9)
        centred = z - z.mean(axis=0)
        np.testing.assert_allclose(m.scatter, centred.T @ centred, rtol=1e-9, atol=1e-6)
    assert not any(t == "other" and f == 2 for t, _, f in parts.parts)
