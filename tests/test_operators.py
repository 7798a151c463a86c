import hashlib
import math
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokengauge.operators import folds, metrics, moments, quantiles, rows, selection
from tokengauge.operators.quantiles import exact_quantiles
from tokengauge.session import checkpoint_root, materialize
from tokengauge.sources import corpus, schemas


def test_quantiles_match_numpy(spark):
    rng = random.Random(1)
    data = [("hot", float(rng.randint(0, 50))) for _ in range(4000)] + [("smooth", rng.random()) for _ in range(1500)]
    data += [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.99}).collect()}
    assert set(got) == {"hot", "smooth", "one"}
    for k in got:
        v = [x for kk, x in data if kk == k]
        for name, q in (("a", 0.25), ("b", 0.5), ("c", 0.99)):
            assert got[k][name] == pytest.approx(np.quantile(v, q), rel=1e-12)


def test_sortable_bits_keep_the_order():
    values = np.array([-math.inf, -1.7e308, -2.0, -1.0, -5e-324, 0.0, 5e-324, 0.1, 1.0, 1.7e308, math.inf, math.nan])
    bits = quantiles.sortable(values)
    assert (bits[1:] > bits[:-1]).all() and quantiles.sortable(np.array([-0.0]))[0] == bits[5]
    np.testing.assert_array_equal(quantiles.unsorted(bits), values)


@pytest.mark.parametrize("digits", [(22, 21, 21), (3, 30, 31)])
def test_quantiles_of_several_columns_and_groups(spark, monkeypatch, digits):
    """Keys with nulls, close and far values, nulls in one column only; the mean distance from the median comes with them."""
    monkeypatch.setattr(quantiles, "DIGITS", digits)
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.choice([1, None]), rng.gauss(0, 1) * 10 ** rng.randint(-9, 9), rng.choice([None, 1.0, 2.0, -7.5])) for _ in range(9000)]
    df = spark.createDataFrame(data, "k string, i int, v double, w double").repartition(7)
    found = quantiles.exact_quantiles_of(df, ["k", "i"], {"v": F.col("v"), "w": F.col("w")}, {"m": 0.5, "t": 0.9}, deviation="m").collect()
    assert len(found) == 6
    for r in found:
        for j, name in ((2, "v"), (3, "w")):
            own = np.array([d[j] for d in data if d[:2] == (r["k"], r["i"]) and d[j] is not None])
            assert r[f"{name}_m"] == pytest.approx(np.median(own), rel=1e-12) and r[f"{name}_t"] == pytest.approx(np.quantile(own, 0.9), rel=1e-12)
            assert r[f"{name}_dev"] == pytest.approx(np.abs(own - np.median(own)).mean(), rel=1e-9)
    (whole,) = quantiles.exact_quantiles_of(df, [], {"v": F.col("v")}, {"m": 0.25}).collect()
    assert whole["v_m"] == pytest.approx(np.quantile([d[2] for d in data], 0.25), rel=1e-12)


def test_quantiles_take_three_passes_and_shuffle_counts_only(spark, monkeypatch):
    plans = []
    counts = quantiles._counts

    def watched(*args):
        out = counts(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(quantiles, "_counts", watched)
    df = spark.range(100_000).selectExpr("id % 3 as k", "double(id * id) as v")
    assert exact_quantiles(df, ["k"], "v", {"m": 0.5, "t": 0.01}).count() == 3
    assert len(plans) == 3 and all(p.count("Exchange") == 1 and "HashAggregate" in p and "Join" not in p for p in plans)


@pytest.mark.parametrize("held", [1 << 20, 100])
def test_a_task_adds_its_counts_up_before_it_sends_them(monkeypatch, held):
    monkeypatch.setattr(quantiles, "HELD", held)
    rng = np.random.default_rng(2)
    counter, sent, data = quantiles._Counter(["v", "w"], 10, 54, None), [], []
    for _ in range(30):
        group, v, w = rng.integers(0, 3, 500), rng.integers(1, 40, 500).astype(float), rng.choice([1.0, np.nan], 500)
        data += zip(group.tolist(), v.tolist(), w.tolist())
        batch = pa.RecordBatch.from_pydict({"k": group, "__group": [f"g{g}" for g in group], "v": v, "w": pa.array(w, from_pandas=True)})
        counter.add(batch, ["k", "__group"])
        if counter.full:
            sent += counter.results()
    sent = pa.Table.from_batches([*sent, *counter.results()]).to_pylist()
    assert len({(r["__group"], r["of"], r["digit"]) for r in sent}) == len(sent) or held == 100
    for g in range(3):
        own = [r for r in sent if r["k"] == g and r["__group"] == f"g{g}"]
        for of, values in ((0, [d[1] for d in data if d[0] == g]), (1, [1.0 for d in data if d[0] == g and d[2] == 1.0])):
            mine = [r for r in own if r["of"] == of]
            assert (sum(r["n"] for r in mine), sum(r["s"] for r in mine)) == (len(values), sum(values))


def test_quantiles_of_odd_values(spark):
    """Infinite values, NaN (above all others) and groups of one value end the narrowing as well."""
    inf, nan = float("inf"), float("nan")
    data = [("inf", x) for x in [-inf, -inf, 1.0, 2.0, 3.0, inf, inf]] + [("nan", x) for x in [1.0, 2.0, nan, nan, nan]]
    data += [("wide", x) for x in [-1.7e308, -1.0, 0.0, 5e-324, 1.7e308]] + [("same", 7.0)] * 3
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5}).collect()}
    assert got["inf"]["b"] == 2.0 and got["nan"]["a"] == 2.0 and math.isnan(got["nan"]["b"])
    assert got["wide"]["a"] == -1.0 and got["wide"]["b"] == 0.0 and got["same"]["a"] == 7.0
    assert exact_quantiles(df.where("false"), ["k"], "v", {"a": 0.5}).count() == 0


def plain_metrics(y, p):
    y, p = np.array(y, float), np.array(p, float)
    e = np.abs(y - p)
    total, dev = ((y - y.mean()) ** 2).sum(), np.abs(y - np.median(y)).sum()

    def score(lost, whole):
        return 1 - lost / whole if whole else (1.0 if lost == 0 else 0.0)

    return {
        "r2": score((e**2).sum(), total), "mae": e.mean(), "mse": (e**2).mean(), "median_ae": np.median(e),
        "mape": (e / np.maximum(np.abs(y), metrics.TINY)).mean(), "max_error": e.max(),
        "d2_abs": score(e.sum(), dev), "rmse": np.sqrt((e**2).mean()),
    }


def test_metrics(spark):
    rng = random.Random(3)
    groups = {
        "noisy": [(rng.gauss(50, 20), rng.gauss(50, 20)) for _ in range(501)],
        "zero_target": [(0.0, 1.0), (2.0, 2.5), (4.0, 4.0)],
        "constant_hit": [(5.0, 5.0)] * 4,
        "constant_missed": [(5.0, 6.0)] * 4,
    }
    data = [(g, y, p) for g, pairs in groups.items() for y, p in pairs]
    df = spark.createDataFrame(data, "g string, y double, yhat double").repartition(3)
    wide = metrics.regression_metrics(df, ["g"])
    for r in wide.collect():
        want = plain_metrics(*zip(*groups[r["g"]]))
        for m in metrics.METRICS:
            assert r[m] == pytest.approx(want[m], rel=1e-9), (r["g"], m)
    back = metrics.report_wide(metrics.to_long(wide, ["g"]), ["g"])
    assert sorted(back.collect()) == sorted(wide.drop("n").collect())


def test_single_row_has_no_score(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "g string, y double, yhat double")
    r = metrics.regression_metrics(df, ["g"]).collect()[0]
    assert np.isnan(r["r2"]) and np.isnan(r["d2_abs"]) and r["mae"] == 1.0


def test_summary_skips_failed_folds(spark):
    df = spark.createDataFrame([("r2", 0.5), ("r2", float("nan")), ("r2", 0.7)], "metric string, value double")
    r = metrics.summarize(df.withColumn("model", F.lit("m")), ["model"]).collect()[0]
    assert r["mean"] == pytest.approx(0.6) and r["folds"] == 2
    assert r["std_pop"] == pytest.approx(0.1) and r["std_samp"] == pytest.approx(np.std([0.5, 0.7], ddof=1))


def test_iqr_filter(spark):
    values = [1.0, 2.0, 2.0, 3.0, 3.0, 4.0, 100.0, None]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0)] * 3, "g string, v double")
    q1, q3 = np.quantile(values[:-1], [0.25, 0.75])
    want = [v for v in values[:-1] if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    got = rows.iqr_filter(df, "v", ["g"]).collect()
    assert sorted(r["v"] for r in got if r["g"] == "a") == want
    assert sum(r["g"] == "b" for r in got) == 3


def test_scopes_and_nulls(spark):
    df = spark.createDataFrame([(1, "English"), (2, "French"), (3, None)], "id long, language string")
    got = sorted((r["scope"], r["id"]) for r in rows.with_scopes(df).collect())
    assert got == [("all", 1), ("all", 2), ("all", 3), ("english", 1)]
    assert rows.in_scope(df, "english").count() == 1 and rows.in_scope(df, "all").count() == 3
    nan = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None)], "id long, v double")
    assert [r["id"] for r in rows.drop_null(nan, "v").collect()] == [1]


def test_kfold_is_stable_and_covers(spark, sf):
    docs = corpus.documents(spark, sf).select("doc_id")
    once = {r["doc_id"]: r["fold"] for r in folds.kfold(docs, "doc_id").collect()}
    again = {r["doc_id"]: r["fold"] for r in folds.kfold(docs.orderBy(F.rand()).repartition(7), "doc_id").collect()}
    assert once == again and set(once.values()) == set(range(10))
    other = {r["doc_id"]: r["fold"] for r in folds.kfold(docs, "doc_id", seed=1).collect()}
    assert other != once
    for count in (1, 7, 193):
        sizes = Counter(r["fold"] for r in folds.kfold(docs.limit(count), "doc_id").collect())
        assert sum(sizes.values()) == count and max(sizes.values()) - min(sizes.get(f, 0) for f in range(10)) <= 1
    plain = sorted(once, key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())
    assert once == {k: i % 10 for i, k in enumerate(plain)}


def test_kfold_with_repeated_and_missing_keys(spark):
    data = [(1, i % 3) for i in range(30)] + [(None, 5)] * 4 + [(2, None)] * 7
    df = spark.createDataFrame(data, "k long, v long")
    split = lambda d: sorted(map(str, folds.kfold(d, "k", 4).collect()))
    assert split(df) == split(df.repartition(5))
    assert sorted(Counter(r["fold"] for r in folds.kfold(df, "k", 4).collect()).values()) == [10, 10, 10, 11]
    assert folds.kfold(df.limit(0), "k").count() == 0


def test_scaler(spark):
    rng = random.Random(4)
    data = [(g, rng.gauss(3, 2), 5.0) for g in "ab" for _ in range(50)]
    df = spark.createDataFrame(data, "g string, x double, c double")
    fitted = moments.scaler_fit(df, ["g"], ["x", "c"])
    for r in fitted.collect():
        v = np.array([d[1] if r["feature"] == "x" else d[2] for d in data if d[0] == r["g"]])
        assert r["mean"] == pytest.approx(v.mean())
        assert r["scale"] == pytest.approx(v.std() or 1.0)
    scaled = moments.scaler_transform(df, fitted, ["g"], ["x", "c"]).groupBy("g").agg(
        F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.max("c").alias("c")
    )
    for r in scaled.collect():
        assert abs(r["m"]) < 1e-9 and r["s"] == pytest.approx(1.0) and r["c"] == 0.0


def test_fold_complement(spark):
    rng = np.random.default_rng(5)
    n = 300
    x = rng.normal(1000, 3, (n, 2))
    y = x @ [1.0, -2.0] + rng.normal(size=n)
    fold, english = rng.integers(0, 4, n), rng.random(n) < 0.5
    data = [("t", bool(english[i]), int(fold[i]), float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(data, "tokenizer string, is_english boolean, fold int, a double, b double, y double")
    for frame in (df.repartition(1), df.repartition(7)):
        parts = moments.collect_fold_parts(frame, ["a", "b"], ["y"])
        for scope, mask in (("all", np.ones(n, bool)), ("english", english)):
            for k in (None, 2):
                keep = mask & (fold != k)
                m = parts.training("y", scope, k)
                z = np.column_stack([x, y])[keep]
                assert m.n == keep.sum()
                np.testing.assert_allclose(m.mean, z.mean(axis=0), rtol=1e-12)
                np.testing.assert_allclose(m.scatter, (z - z.mean(axis=0)).T @ (z - z.mean(axis=0)), rtol=1e-8)


def test_ranking(spark):
    df = spark.createDataFrame(
        [("m", 0, 0.9), ("m", 1, 0.95), ("m", 2, 0.95), ("m", 3, 0.1)], "model string, config_id int, mean_r2 double"
    )
    got = {r["config_id"]: r["rank"] for r in selection.rank_configs(df, ["model"]).collect()}
    assert got == {1: 1, 2: 1, 0: 3, 3: 4}
    best = selection.best_config(df, ["model"]).collect()[0]
    assert best["config_id"] == 1 and best["mean_r2"] == 0.95


def test_failed_configurations_rank_last(spark):
    df = spark.createDataFrame(
        [("m", 0, float("nan")), ("m", 1, 0.9), ("m", 2, 0.5), ("m", 3, None)], "model string, config_id int, mean_r2 double"
    )
    got = {r["config_id"]: r["rank"] for r in selection.rank_configs(df, ["model"]).collect()}
    assert got == {1: 1, 2: 2, 0: 3, 3: 3}
    best = selection.best_config(df, ["model"]).collect()[0]
    assert best["config_id"] == 1 and best["mean_r2"] == 0.9


def test_lost_parameters_fail(spark):
    cells = spark.createDataFrame([("rf", "x")], "model string, tokenizer string")
    params = spark.createDataFrame([("rf", "y", 1)], "model string, tokenizer string, n int")
    with pytest.raises(KeyError):
        selection.require_params(cells, params, ["model", "tokenizer"])


def test_checkpoint_folder_follows_the_session():
    """The folder the cluster names is used; a cluster that names none is an error."""

    def session(master, folder):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default),
            sparkContext=SimpleNamespace(master=master, applicationId="app-1"),
        )

    assert checkpoint_root(session("yarn", "hdfs:///shared")) == "hdfs:///shared"
    assert checkpoint_root(session("local[2]", "/shared")) == "/shared"
    with pytest.raises(RuntimeError):
        checkpoint_root(session("yarn", None))


def test_stages_round_trip(spark, sf, tmp_path):
    docs = corpus.documents(spark, sf)
    path = corpus.write_stage(corpus.build_features(docs), str(tmp_path / "features"))
    stage = spark.read.parquet(path)
    again = corpus.read_shards(spark, path, stage.schema, shard_column="shard")
    assert again.count() == docs.count() and again.where("shard is null").count() == 0
    kept = corpus.read_features(spark, path, stage.schema, ["char_count"], "word_count", "english")
    assert kept.count() == docs.where("language = 'English'").count()
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(language), EqualTo(language,English)" in plan
    assert "content" not in plan


def test_schemas_fit_the_files(spark, sf):
    for name in ("documents", "pages", "conversations", "benchmark", "labels"):
        want = getattr(schemas, name.upper())
        found = spark.read.parquet(f"{sf}/{name}.parquet").schema
        assert [f.name for f in want] == [f.name for f in found]
        assert [f.dataType for f in want] == [f.dataType for f in found]
