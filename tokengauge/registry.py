"""Every query by name: ``(spark, sf_dir) -> DataFrame`` over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokengauge.functions.text import (
    FEATURES, REGULARIZED_FEATURES, SELECTED_FEATURES, add_features, gap_word_count, pretoken_count,
)
from tokengauge.functions.tokens import add_token_counts, default_vocabularies
from tokengauge.operators import folds, metrics, moments, rows, selection
from tokengauge.operators.quantiles import exact_quantiles
from tokengauge.plans import (
    best_params, boost, final, mlp, regularized, robust, training, trees,
)
from tokengauge.session import local_table, materialize, shared_path, ship_package, spread
from tokengauge.sources import corpus, schemas
from tokengauge.streaming.featurize import featurize_new_shards
from tokengauge.streaming.moments import keep_moments, merged_store

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}
ONE = "byte_bpe_50k"  # the vocabulary of the dearer searches
TEXT_KEY = ["origin", "id", "part"]


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    _REGISTRY[f.__name__] = run
    return f


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Sums depend on the order of addition; results are compared after rounding."""
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def one_vocabulary():
    return {ONE: default_vocabularies()[ONE]}


# --- sources --------------------------------------------------------------------------


@query
def scan_project(spark, sf_dir):
    return corpus.read_shards(
        spark, f"{sf_dir}/documents.parquet", schemas.DOCUMENTS, ["doc_id", "lang", "n_chars"]
    )


@query
def shard_union(spark, sf_dir):
    texts = corpus.all_texts(spark, sf_dir)
    return texts.select(*TEXT_KEY, F.length("content").cast("bigint").alias("char_count"))


@query
def features_read(spark, sf_dir):
    labels = spark.read.schema(schemas.LABELS).parquet(f"{sf_dir}/labels.parquet")
    docs = spread(corpus.documents(spark, sf_dir), "doc_id")
    path = shared_path(spark, "features")
    features = add_features(docs, SELECTED_FEATURES).drop("content")
    stage = features.join(labels, "doc_id", "left")
    corpus.write_stage(stage, path)
    return corpus.read_features(
        spark, path, stage.schema, ["doc_id", "char_count", "word_count"], "quality", "english"
    )


@query
def conversation_prompts(spark, sf_dir):
    chosen = ["char_count", "word_count", "whitespace_count", "avg_word_length"]
    prompts = spread(corpus.prompts(spark, sf_dir), "conv_id")
    return add_features(prompts, chosen).drop("content")


@query
def stream_features(spark, sf_dir):
    """New shards of the documents as a stream, each featurized once; what the sink holds when all are done."""
    sink = shared_path(spark, "stream-features")
    source = f"{sf_dir}/document[s].parquet"  # a pattern, since a stream takes no single file by name
    run = featurize_new_shards(
        spark, source, schemas.DOCUMENTS, sink, shared_path(spark, "stream-mark"), SELECTED_FEATURES, content="text"
    )
    run.awaitTermination()
    stored = T.StructType([schemas.DOCUMENTS["doc_id"], *spark.read.parquet(sink).select(*SELECTED_FEATURES).schema.fields])
    return corpus.read_shards(spark, sink, stored)


@query
def stream_fit(spark, sf_dir):
    """Least squares and ridge on moments of the tables that hold texts, taken shard by shard from a stream and merged at the end."""
    store = shared_path(spark, "stream-moments")
    pair = ["char_count", "word_count"]
    source = f"{sf_dir}/{{documents,conversations,benchmark}}.parquet"
    text = T.StructType([schemas.DOCUMENTS["text"]])
    run = keep_moments(
        spark, source, text, store, shared_path(spark, "stream-mark"),
        lambda df: add_features(df.withColumnRenamed("text", "content"), pair).withColumn("pretoken", pretoken_count("content")),
        [*pair, "pretoken"], files_per_batch=1,
    )
    run.awaitTermination()
    total = merged_store(spark, store, len(pair) + 1)
    return rounded(regularized.parameters_of(spark, total, pair, [regularized.OLS, regularized.PENALTIES[1]]))


# --- filters and reshaping ------------------------------------------------------------


@query
def scope_counts(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir, "n_chars")
    return rows.with_scopes(docs).groupBy("scope").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("chars")
    )


@query
def dropna_target(spark, sf_dir):
    labels = spark.read.schema(schemas.LABELS).parquet(f"{sf_dir}/labels.parquet")
    docs = corpus.documents(spark, sf_dir, "n_chars").join(labels, "doc_id", "left")
    return rows.drop_null(docs, "quality", "n_chars").select("doc_id", "quality", "n_chars")


def _ratios(spark, sf_dir):
    docs = spread(corpus.documents(spark, sf_dir), "doc_id")
    counted = docs.withColumn("pretoken", pretoken_count("content"))
    return materialize(
        counted.select(
            "doc_id", "language", "pretoken",
            F.length("content").cast("bigint").alias("char_count"),
            rows.token_ratio("pretoken").alias("ratio"),
        ),
        "ratios",
    )


@query
def iqr_filter(spark, sf_dir):
    ratios = rows.with_scopes(_ratios(spark, sf_dir))
    return rows.iqr_filter(ratios, "ratio", ["scope"]).select("scope", "doc_id", "ratio")


@query
def targets_long(spark, sf_dir):
    docs = spread(corpus.documents(spark, sf_dir), "doc_id")
    wide = docs.select(
        "doc_id", pretoken_count("content").alias("pretoken"), gap_word_count("content").alias("gap_words")
    )
    return rows.targets_long(wide, ["doc_id"], ["pretoken", "gap_words"])


@query
def ratio_profile(spark, sf_dir):
    ratios = _ratios(spark, sf_dir).withColumn("tokenizer", F.lit("pretoken"))
    keys = ["tokenizer", "language"]
    means = ratios.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("ratio").alias("per_word"),
        F.avg(F.try_divide("pretoken", "char_count")).alias("per_char"),
    )
    cuts = exact_quantiles(ratios, keys, "ratio", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return rounded(means.join(cuts, keys), 6)


# --- text features --------------------------------------------------------------------

TEXT_QUERIES = {
    "f_char_count": ["char_count"],
    "f_word_count": ["word_count"],
    "f_whitespace": ["whitespace_count"],
    "f_non_ascii": ["has_non_ascii"],
    "f_avg_word_len": ["avg_word_length"],
    "f_ratios": [
        "whitespace_ratio", "alnum_special_ratio", "digit_proportion", "uppercase_proportion",
        "punctuation_proportion",
    ],
    "f_word_len_minmax": ["max_word_length", "min_word_length"],
    "f_code_markup": ["code_markup_count"],
    "f_url_email": ["url_email_count"],
    "f_social": ["social_media_count"],
    "f_language_count": ["language_count"],
    "f_stopwords": ["stopword_proportion"],
    "features_all": FEATURES,
    "features_selected": SELECTED_FEATURES,
}


def _text_query(features: list[str]) -> Query:
    def run(spark, sf_dir):
        ship_package(spark)
        texts = spread(corpus.all_texts(spark, sf_dir), *TEXT_KEY)
        return add_features(texts, features).drop("content")

    return run


for _name, _features in TEXT_QUERIES.items():
    _REGISTRY[_name] = _text_query(_features)


@query
def f_gap_word_count(spark, sf_dir):
    texts = spread(corpus.all_texts(spark, sf_dir), *TEXT_KEY)
    return texts.select(*TEXT_KEY, gap_word_count("content").alias("gap_word_count"))


# --- token counts ---------------------------------------------------------------------


@query
def token_counts(spark, sf_dir):
    texts = spread(corpus.all_texts(spark, sf_dir), *TEXT_KEY)
    return add_token_counts(texts).drop("content")


@query
def enrich(spark, sf_dir):
    docs = spread(corpus.documents(spark, sf_dir), "doc_id")
    path = corpus.write_stage(corpus.enrich(docs), shared_path(spark, "enriched"))
    schema = spark.read.parquet(path).schema
    return corpus.read_shards(spark, path, schema, ["doc_id", "language", *default_vocabularies()])


@query
def prompt_tokens(spark, sf_dir):
    prompts = spread(corpus.prompts(spark, sf_dir), "conv_id")
    stage = add_token_counts(prompts, missing="skip")
    path = corpus.write_stage(stage, shared_path(spark, "prompts"))
    return corpus.read_shards(spark, path, stage.schema, [c for c in stage.columns if c != "content"])


# --- folds, scalers, moments ----------------------------------------------------------


def _docs_folded(spark, sf_dir):
    docs = spread(corpus.documents(spark, sf_dir), "doc_id")
    narrow = add_features(docs, ["char_count", "word_count"]).withColumn("pretoken", pretoken_count("content")).drop("content")
    return folds.kfold(narrow, "doc_id")


@query
def kfold_assign(spark, sf_dir):
    return folds.kfold(corpus.documents(spark, sf_dir).select("doc_id"), "doc_id")


@query
def group_fold(spark, sf_dir):
    docs = folds.group_fold(corpus.documents(spark, sf_dir, "n_chars"), "source")
    return docs.groupBy("fold").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query
def scaler_fit(spark, sf_dir):
    docs = rows.with_scopes(_docs_folded(spark, sf_dir))
    return rounded(moments.scaler_fit(docs, ["scope", "fold"], ["char_count", "word_count", "pretoken"]))


@query
def fold_moments(spark, sf_dir):
    docs = rows.with_scopes(_docs_folded(spark, sf_dir))
    return moments.fold_moments(docs, ["scope", "fold"], ["char_count", "word_count", "pretoken"])


# --- metrics, reports, selection ------------------------------------------------------

CANDIDATES = ["char_count", "word_count", "avg_word_length"]
MODEL_KEYS = ["model", "tokenizer", "scope", "fold"]
CONFIG_KEYS = ["model", "config_id", "config", "tokenizer", "scope", "fold"]


def _pretoken_table(spark, sf_dir, features=("char_count",)):
    return training.stored_training_table(spark, sf_dir, list(features), None)


def _ols_metrics(spark, sf_dir):
    table = _pretoken_table(spark, sf_dir)
    predictions = regularized.cross_validate(table, ["pretoken"], ["char_count"], [regularized.OLS])
    return regularized.cv_metrics(predictions, wide=True)


@query
def predict_ols(spark, sf_dir):
    table = _pretoken_table(spark, sf_dir)
    predictions = regularized.cross_validate(
        table, ["pretoken"], ["char_count"], [regularized.OLS], keep=["doc_id"]
    )
    return rounded(predictions)


@query
def ridge_univariate_cv(spark, sf_dir):
    table = _pretoken_table(spark, sf_dir)
    predictions = regularized.cross_validate(
        table, ["pretoken"], ["char_count"], [regularized.PENALTIES[1]], keep=["doc_id"]
    )
    return rounded(predictions)


def _univariate_penalty(kind: str) -> Query:
    def run(spark, sf_dir):
        ship_package(spark)
        penalty = next(p for p in regularized.PENALTIES if p.kind == kind)
        table = _pretoken_table(spark, sf_dir)
        return rounded(regularized.cross_validate(table, ["pretoken"], ["char_count"], [penalty], keep=["doc_id"]))

    return run


for _kind in ("lasso", "elasticnet"):
    _REGISTRY[f"{_kind}_univariate_cv"] = _univariate_penalty(_kind)


@query
def ridge_two_feature_cv(spark, sf_dir):
    pair = ["char_count", "word_count"]
    table = _pretoken_table(spark, sf_dir, pair)
    return rounded(regularized.cross_validate(table, ["pretoken"], pair, [regularized.PENALTIES[1]], keep=["doc_id"]))


@query
def penalized_optimality(spark, sf_dir):
    """Ridge, lasso and elastic net of all twelve features on all rows, with the optimality conditions summed over the rows: what is left of each must vanish."""
    names = list(REGULARIZED_FEATURES)
    table = _pretoken_table(spark, sf_dir, names)
    fits = regularized.fit_grid(moments.collect_fold_parts(table, names, ["pretoken"]), regularized.PENALTIES, held_out=[None])
    kinds = {p.name: p for p in regularized.PENALTIES}
    params = [(m, scope, intercept, coefs, kinds[m].kind == "ridge", kinds[m].alpha, kinds[m].l1_ratio) for m, _, scope, _, intercept, coefs in fits]
    params = local_table(spark, params, "model string, scope string, intercept double, coefs array<double>, ridge boolean, alpha double, l1_ratio double")
    scoped = training.explode_scopes(training.long_targets(table, ["pretoken"]))
    scales = moments.scaler_fit(scoped, ["scope"], names).groupBy("scope").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "scale")))).alias("z"))
    rest = F.col("y") - F.col("intercept")
    for i, c in enumerate(names):
        rest = rest - F.col("coefs")[i] * F.col(c)
    z = {c: (F.col(c) - F.col("z")[c]["mean"]) / F.col("z")[c]["scale"] for c in names}
    rows = scoped.join(params, "scope").join(materialize(scales, "scales"), "scope")
    keys = ["model", "scope", "coefs", "ridge", "alpha", "l1_ratio", "z"]
    sums = rows.withColumn("rest", rest).withColumn("z", F.array(*[F.struct(z[c].alias("v"), F.col("z")[c]["scale"].alias("scale")) for c in names]))
    slopes = [F.avg(F.col("rest") * F.col("z")[i]["v"]).alias(f"s{i}") for i in range(len(names))]
    scale = [F.max(F.col("z")[i]["scale"]).alias(f"c{i}") for i in range(len(names))]
    by_fit = sums.groupBy(*keys[:-1]).agg(F.count("*").alias("n"), *slopes, *scale)
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("slope"), (F.col("coefs")[i] * F.col(f"c{i}")).alias("w")) for i, c in enumerate(names)])
    flat = by_fit.select("model", "scope", "n", "ridge", "alpha", "l1_ratio", F.explode(entries).alias("e")).select("*", "e.*")
    l1 = F.col("alpha") * F.col("l1_ratio")
    pull = F.when(F.col("ridge"), F.col("alpha") / F.col("n")).otherwise(F.col("alpha") * (1 - F.col("l1_ratio"))) * F.col("w")
    inside = F.abs(F.col("slope") - pull - F.when(F.col("ridge"), 0.0).otherwise(l1 * F.signum("w")))
    left = F.when(~F.col("ridge") & (F.col("w") == 0), F.greatest(F.abs("slope") - l1, F.lit(0.0))).otherwise(inside)
    return rounded(flat.select("model", "scope", "feature", "n", left.alias("left_over")))


SHARDS = ("documents", "conversations", "benchmark")


@query
def shard_out_cv(spark, sf_dir):
    """Least squares that leaves one shard (file) out; the shards are the tables that hold texts."""
    paths = [f"{sf_dir}/{t}.parquet" for t in SHARDS]
    texts = corpus.read_shards(spark, paths, T.StructType([schemas.DOCUMENTS["text"]]), shard_column="shard")
    table = folds.group_fold(texts, "shard").select(
        "fold", F.lit(False).alias("is_english"), F.length("text").cast("double").alias("char_count"), pretoken_count("text").alias("pretoken")
    )
    predictions = regularized.cross_validate(
        materialize(table, "training"), ["pretoken"], ["char_count"], [regularized.OLS], scopes=["all"]
    )
    return rounded(regularized.cv_metrics(predictions, wide=True))


@query
def metrics_by_fold(spark, sf_dir):
    return rounded(_ols_metrics(spark, sf_dir))


_REGISTRY["metrics"] = _REGISTRY.pop("metrics_by_fold")


@query
def report_wide(spark, sf_dir):
    long = metrics.to_long(_ols_metrics(spark, sf_dir), MODEL_KEYS)
    path = corpus.write_stage(long, shared_path(spark, "report"))
    stored = spark.read.schema(long.schema).parquet(path)
    return rounded(metrics.report_wide(stored, MODEL_KEYS))


@query
def cv_summary(spark, sf_dir):
    long = metrics.to_long(_ols_metrics(spark, sf_dir), MODEL_KEYS)
    return rounded(metrics.summarize(long, ["model", "tokenizer", "scope"]))


def _candidate_summary(spark, sf_dir):
    found = regularized.univariate_search(_pretoken_table(spark, sf_dir, CANDIDATES), "pretoken", CANDIDATES)
    by_fold = metrics.regression_metrics(materialize(found, "predictions"), CONFIG_KEYS)
    return by_fold.groupBy(*CONFIG_KEYS[:-1]).agg(F.avg(F.nanvl("r2", F.lit(None).cast("double"))).alias("mean_r2"))


@query
def rank_configs(spark, sf_dir):
    ranked = selection.rank_configs(_candidate_summary(spark, sf_dir), ["model", "tokenizer", "scope"])
    return rounded(ranked, 6)


@query
def best_config(spark, sf_dir):
    return rounded(selection.best_config(_candidate_summary(spark, sf_dir), ["model", "tokenizer", "scope"]), 6)


@query
def best_params_lookup(spark, sf_dir):
    names = F.array(*[F.lit(t) for t in best_params.TOKENIZERS])
    models = F.array(*[F.lit(m) for m in ("linear", "rf", "et", "mlp")])
    cells = (
        rows.with_scopes(corpus.documents(spark, sf_dir)).groupBy("scope").agg(F.count("*").alias("n_rows"))
        .withColumn("tokenizer", F.explode(names))
        .withColumn("model", F.explode(models))
    )
    return selection.lookup_params(cells, best_params.best_params(spark), ["model", "tokenizer", "scope"])


# --- estimators -----------------------------------------------------------------------


def _token_table(spark, sf_dir, features, vocabularies=None, **options):
    chosen = default_vocabularies() if vocabularies is None else vocabularies
    return training.stored_training_table(spark, sf_dir, features, chosen, **options), list(chosen)


def _huber_cells(spark, sf_dir, with_final):
    table, targets = _token_table(spark, sf_dir, ["char_count"])
    cells = robust.make_cells(table, targets, [("char_count", 1)], scale_target=True, with_final=with_final)
    return table, targets, cells


@query
def linear_huber_cv(spark, sf_dir):
    table, targets, cells = _huber_cells(spark, sf_dir, with_final=False)
    return regularized.cv_metrics(robust.predictions(table, targets, robust.fit(table, cells)))


@query
def linear_params(spark, sf_dir):
    table, _, cells = _huber_cells(spark, sf_dir, with_final=True)
    finals = [c for c in cells if c.fold is None]
    return robust.linear_parameters(table, robust.fit(table, finals))


@query
def huber_optimality(spark, sf_dir):
    """The Huber line on the pre-token count, with the gradient of its objective summed over the rows."""
    table = _pretoken_table(spark, sf_dir)
    cells = robust.make_cells(table, ["pretoken"], [("char_count", 1)], scale_target=True, with_final=True)
    params = robust.linear_parameters(table, robust.fit(table, [c for c in cells if c.fold is None]))
    scored = training.explode_scopes(training.long_targets(table, ["pretoken"])).join(params, ["tokenizer", "scope"])
    z = (F.col("char_count") - F.col("x_mean")) / F.col("x_scale")
    rest = (F.col("y") - F.col("y_mean")) / F.col("y_scale") - F.col("intercept_scaled") - F.col("coef_scaled") * z
    pull = F.least(F.greatest(rest, F.lit(-robust.EPSILON)), F.lit(robust.EPSILON))
    by_cell = scored.groupBy("tokenizer", "scope", "x_mean", "x_scale", "y_mean", "y_scale", "coef_scaled").agg(
        F.count("*").alias("n"), F.avg(pull).alias("g0"), F.avg(pull * z).alias("g1")
    )
    at_rest = (F.abs("g0") < 1e-5) & (F.abs(F.col("g1") - robust.ALPHA * F.col("coef_scaled")) < 1e-5)
    return rounded(by_cell.select("tokenizer", "scope", "n", "x_mean", "x_scale", "y_mean", "y_scale", at_rest.alias("optimal")))


@query
def polynomial_cv(spark, sf_dir):
    table, targets = _token_table(spark, sf_dir, ["char_count"], gap_words=True, drop_null_content=True)
    by_source = folds.group_fold(table, "source")
    shapes = [(f, d) for f in ("char_count", "gap_word_count") for d in (2, 3)]
    cells = robust.fit(by_source, robust.make_cells(by_source, targets, shapes, scale_target=False))
    return regularized.cv_metrics(robust.predictions(by_source, targets, cells))


def _penalized(kind: str) -> Query:
    def run(spark, sf_dir):
        ship_package(spark)
        table, targets = _token_table(spark, sf_dir, REGULARIZED_FEATURES)
        chosen = [p for p in regularized.PENALTIES if p.kind == kind]
        return regularized.cv_metrics(regularized.cross_validate(table, targets, penalties=chosen))

    return run


for _kind in ("ridge", "lasso", "elasticnet"):
    _REGISTRY[f"{_kind}_cv"] = _penalized(_kind)


@query
def linear_boost_cv(spark, sf_dir):
    table, targets = _token_table(spark, sf_dir, SELECTED_FEATURES)
    boosters = boost.fit(table, targets)
    return regularized.cv_metrics(boost.predict(table, boosters))


def _search_metrics(predictions: DataFrame) -> DataFrame:
    by_fold = metrics.regression_metrics(materialize(predictions, "predictions"), CONFIG_KEYS)
    return metrics.to_long(by_fold, CONFIG_KEYS)


def _forest_search(model: str, rule: str) -> Query:
    """All configurations of the grid, ten folds, all vocabularies and scopes."""

    def run(spark, sf_dir):
        ship_package(spark)
        table, targets = _token_table(spark, sf_dir, SELECTED_FEATURES)
        found = trees.cross_validate(table, targets, trees.tree_grid(), rule)
        return _search_metrics(found.withColumn("model", F.lit(model)))

    return run


_REGISTRY["rf_cv"] = _forest_search("rf", trees.BEST)
_REGISTRY["et_cv"] = _forest_search("et", trees.RANDOM)


@query
def grid_search_rf(spark, sf_dir):
    """The whole grid ranked; the winner of each cell is refitted on all rows, and its trees, read back, score them."""
    table, targets = _token_table(spark, sf_dir, SELECTED_FEATURES)
    ranked, model = trees.grid_search(table, targets, trees.tree_grid(), trees.BEST)
    stored = trees.load(spark, trees.save(model, shared_path(spark, "winners")))
    keys = ["tokenizer", "scope", "config"]
    sizes = stored.groupBy(*keys).agg(F.countDistinct("tree").alias("refit_trees"), F.sum(F.size("feature")).cast("long").alias("refit_nodes"))
    scores = metrics.regression_metrics(materialize(trees.predict(table, stored), "predictions"), keys)
    refit = sizes.join(scores.select(*keys, F.col("r2").alias("refit_r2")), keys)
    return ranked.withColumn("model", F.lit("rf")).join(refit, keys, "left")


@query
def mlp_cv(spark, sf_dir):
    """The whole grid and ten folds, all vocabularies and scopes."""
    table, targets = _token_table(spark, sf_dir, SELECTED_FEATURES)
    return _search_metrics(mlp.predict(table, mlp.fit(table, targets, mlp.mlp_grid())))


PLAYS = "r50k"  # the published tokenizer whose choices the vocabulary of the dearer searches takes


@query
def final_models(spark, sf_dir):
    table, targets = _token_table(spark, sf_dir, SELECTED_FEATURES, one_vocabulary())
    params = best_params.best_params(spark).where(F.col("tokenizer") == PLAYS).withColumn("tokenizer", F.lit(ONE))
    return final.train_and_score(table, targets, shared_path(spark, "models"), params)


@query
def searched_models(spark, sf_dir):
    """Forests and networks searched over their whole grids, the winners refitted with the linear models, stored, and scored from disk; one vocabulary."""
    table, targets = _token_table(spark, sf_dir, SELECTED_FEATURES, one_vocabulary())
    grid, networks = trees.tree_grid(), mlp.mlp_grid()
    searches = {
        model: (trees.summarized(trees.cross_validate(table, targets, grid, rule)), grid) for model, rule in (("rf", trees.BEST), ("et", trees.RANDOM))
    }
    searches["mlp"] = trees.summarized(mlp.predict(table, mlp.fit(table, targets, networks))), networks
    return final.train_and_score(table, targets, shared_path(spark, "models"), final.searched_params(table, searches))


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)
