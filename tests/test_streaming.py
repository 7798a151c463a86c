import numpy as np
from pyspark.sql import functions as F

from tokengauge.functions.text import FEATURES, add_features, pretoken_count
from tokengauge.functions.tokens import default_vocabularies
from tokengauge.sources import corpus, schemas
from tokengauge.streaming.featurize import featurize_new_shards
from tokengauge.streaming.moments import keep_moments, merged_store, shard_moments


def test_stream_equals_batch_and_takes_new_shards_only(spark, sf, tmp_path):
    docs = corpus.documents(spark, sf).select(*schemas.CORPUS.fieldNames())
    source, sink, mark = (str(tmp_path / d) for d in ("in", "out", "mark"))
    one = {"piece_bpe_32k": default_vocabularies()["piece_bpe_32k"]}

    def run():
        query = featurize_new_shards(spark, source, schemas.CORPUS, sink, mark, vocabularies=one, files_per_batch=1)
        query.awaitTermination(300)
        assert query.exception() is None
        return query

    docs.where(F.col("doc_id") % 2 == 0).repartition(2).write.parquet(source)
    run()
    first = spark.read.parquet(sink).count()
    assert first == docs.where(F.col("doc_id") % 2 == 0).count()
    docs.where(F.col("doc_id") % 2 == 1).coalesce(1).write.mode("append").parquet(source)
    run()
    run()  # nothing new: nothing written
    got = spark.read.parquet(sink).select("doc_id", *FEATURES)
    want = add_features(docs).select("doc_id", *FEATURES)
    assert got.count() == docs.count()
    assert sorted(got.collect()) == sorted(want.collect())


def test_moments_grow_by_shard_and_replays_change_nothing(spark, sf, tmp_path):
    names = ["char_count", "word_count", "pretoken"]
    source, store = str(tmp_path / "in"), str(tmp_path / "moments")
    docs = corpus.documents(spark, sf).select(*schemas.CORPUS.fieldNames())
    prepare = lambda df: add_features(df, names[:2]).withColumn("pretoken", pretoken_count("content"))

    def run(mark):
        query = keep_moments(spark, source, schemas.CORPUS, store, str(tmp_path / mark), prepare, names, files_per_batch=1)
        query.awaitTermination(300)
        assert query.exception() is None
        return merged_store(spark, store, 3)

    def same(found, rows):
        x = prepare(rows).select(*names).toPandas().to_numpy(dtype=float)
        assert found.n == len(x)
        np.testing.assert_allclose(found.mean, x.mean(axis=0))
        np.testing.assert_allclose(found.scatter, np.cov(x.T, bias=True) * len(x), rtol=1e-9)

    half = docs.where(F.col("doc_id") % 2 == 0)
    half.repartition(3).write.parquet(source)
    same(run("a"), half)
    docs.where(F.col("doc_id") % 2 == 1).coalesce(1).write.mode("append").parquet(source)
    whole = run("a")  # reads the new shard only
    same(whole, docs)
    again = run("b")  # a lost checkpoint: every shard is read again and replaced
    assert again.n == whole.n
    np.testing.assert_allclose(again.scatter, whole.scatter, rtol=1e-12)
    assert spark.read.parquet(store).count() == 4
    one = spark.read.parquet(store).first()["shard"]
    rest = merged_store(spark, store, 3, lambda t: t.where(F.col("shard") != one))
    same(rest, spark.read.parquet(source).where(F.col("_metadata.file_path") != one))
    none = shard_moments(docs.limit(0).selectExpr("'s' as shard", "1.0 as x", "2.0 as y"), ["x", "y"])
    assert none.count() == 0
