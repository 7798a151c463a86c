import math

import pytest
from pyspark.sql import functions as F

from tests import plain
from tokengauge.functions import patterns
from tokengauge.functions.text import FEATURES, SELECTED_FEATURES, add_features, gap_word_count
from tokengauge.sources import corpus


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, content string")


def compare(rows, texts, features=FEATURES):
    wrong = []
    for r in rows:
        want = plain.features(texts[r["id"]])
        for f in features:
            same = r[f] == want[f] or (
                isinstance(want[f], float) and math.isclose(r[f], want[f], rel_tol=1e-12)
            )
            if not same:
                wrong.append((f, texts[r["id"]], r[f], want[f]))
    assert not wrong, (len(wrong), wrong[:5])


def test_fixed_lists():
    assert len(set(patterns.UNICODE_SCRIPTS)) == 127
    assert len(set(patterns.STOPWORDS)) == 126
    assert len(patterns.PUNCTUATION) == 32


def test_hand_made_texts(spark):
    texts = plain.HAND_MADE
    compare(add_features(frame(spark, texts)).collect(), texts)


def test_random_texts(spark):
    texts = plain.random_texts(3000, 7)
    compare(add_features(frame(spark, texts).repartition(4)).collect(), texts)


def test_tables(spark, sf):
    texts = corpus.all_texts(spark, sf).select("content").collect()
    texts = [r["content"] for r in texts]
    compare(add_features(frame(spark, texts).repartition(4)).collect(), texts)


def test_gap_words(spark):
    texts = plain.HAND_MADE + plain.random_texts(500, 3)
    df = frame(spark, texts)
    for r in df.select("id", gap_word_count("content").alias("g")).collect():
        assert r["g"] == plain.gap_words(texts[r["id"]])


def test_null_text_can_be_empty(spark):
    row = add_features(frame(spark, [None]), null_text="").collect()[0]
    assert row["char_count"] == 0 and row["word_count"] == 0 and row["avg_word_length"] == 0.0


def test_subset_equals_bundle(spark):
    texts = plain.random_texts(200, 5)
    some = add_features(frame(spark, texts), SELECTED_FEATURES)
    assert some.columns == ["id", "content", *SELECTED_FEATURES]
    compare(some.collect(), texts, SELECTED_FEATURES)


def test_unknown_feature(spark):
    with pytest.raises(ValueError):
        add_features(frame(spark, ["a"]), ["no_such_feature"])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_and_no_shuffle_in_the_plan(spark):
    plan = plan_of(add_features(frame(spark, ["a"])))
    assert "Python" not in plan and "Exchange" not in plan


def test_unused_features_are_pruned(spark):
    plan = plan_of(add_features(frame(spark, ["a"])).select("id", "char_count"))
    assert "regexp" not in plan and "rlike" not in plan.lower()


def test_scan_reads_only_needed_columns(spark, sf):
    df = add_features(corpus.documents(spark, sf), ["char_count"]).agg(F.sum("char_count"))
    plan = plan_of(df)
    assert "ReadSchema: struct<text:string>" in plan
