"""The narrow numeric table every estimator trains on, and linear prediction from parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokengauge.functions.text import FEATURES, add_features, gap_word_count, pretoken_count
from tokengauge.functions.tokens import Vocabulary, add_token_counts
from tokengauge.operators.folds import FOLDS, SEED, kfold
from tokengauge.operators.rows import ENGLISH, scopes_of
from tokengauge.session import materialize, spread
from tokengauge.sources.corpus import documents

PRETOKEN = "pretoken"


def training_table(
    corpus: DataFrame,
    features: Sequence[str],
    vocabularies: Mapping[str, Vocabulary] | None,
    key: str = "doc_id",
    folds: int = FOLDS,
    seed: int = SEED,
    gap_words: bool = False,
    drop_null_content: bool = False,
) -> DataFrame:
    """``key, source, is_english, fold``, features as doubles and one column per target.

    With ``vocabularies=None`` the one target is the pre-token count, which
    needs no vocabulary. No text is kept: everything downstream is numeric. A
    null text counts as the word ``None`` unless ``drop_null_content``.
    """
    if drop_null_content:
        corpus = corpus.where("content is not null")
    df = add_features(spread(corpus, key), features)
    if gap_words:
        df = df.withColumn("gap_word_count", gap_word_count("content"))
        features = [*features, "gap_word_count"]
    if vocabularies is None:
        df = df.withColumn(PRETOKEN, pretoken_count("content"))
        targets = [PRETOKEN]
    else:
        df = add_token_counts(df, vocabularies)
        targets = list(vocabularies)
    english = F.coalesce(F.col("language") == ENGLISH, F.lit(False))
    narrow = df.select(
        key,
        "source",
        english.alias("is_english"),
        *[F.col(f).cast("double").alias(f) for f in features],
        *targets,
    )
    return kfold(narrow, key, folds, seed).select(key, "source", "is_english", "fold", *features, *targets)


def stored_training_table(spark: SparkSession, sf_dir: str, features: Sequence[str], vocabularies, **options) -> DataFrame:
    """The training table of the documents, written once and read back narrow."""
    return materialize(training_table(documents(spark, sf_dir), features, vocabularies, **options), "training")


def long_targets(table: DataFrame, targets: Sequence[str]) -> DataFrame:
    """One row per (row, tokenizer) with target ``y``; rows without a target are dropped."""
    rest = [c for c in table.columns if c not in targets]
    return table.unpivot(rest, list(targets), "tokenizer", "y").where("y is not null")


def explode_scopes(long: DataFrame) -> DataFrame:
    return long.withColumn("scope", F.explode(scopes_of(F.col("is_english"))))


def params_schema(fold_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("model", T.StringType()),
            T.StructField("tokenizer", T.StringType()),
            T.StructField("scope", T.StringType()),
            T.StructField("fold", fold_type),
            T.StructField("intercept", T.DoubleType()),
            T.StructField("coefs", T.ArrayType(T.DoubleType())),
        ]
    )


def predict_linear(
    long: DataFrame,
    params: DataFrame,
    features: Sequence[str],
    on_fold: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``model, tokenizer, scope, fold, y, yhat`` from a parameter table.

    ``params`` is a local relation the size of the model grid, so the join is a
    broadcast and the data is not shuffled. With ``on_fold`` a row is scored by
    the model that did not see its fold.
    """
    rows = explode_scopes(long)
    keys = ["tokenizer", "scope", "fold"] if on_fold else ["tokenizer", "scope"]
    if not on_fold:
        params = params.drop("fold")
    yhat = F.col("intercept")
    for i, f in enumerate(features):
        yhat = yhat + F.col("coefs")[i] * F.col(f)
    return rows.join(params, keys).select(
        "model", "tokenizer", "scope", "fold", *keep,
        F.col("y").cast("double").alias("y"), yhat.alias("yhat"),
    )

