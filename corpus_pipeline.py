"""Documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokengauge.llm import line_dedup, minhash, packing, quality_rules, toxicity
from tokengauge.llm.common import read
from tokengauge.llm.queries import vocabulary
from tokengauge.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows among ``docs``."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def drop_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go from all but one; n_chars follows the text. Every document stays, if empty."""
    done = line_dedup.dedup_lines(docs).drop("n_lines", "n_dropped")
    return done.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else done


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest doc_id."""
    return minhash.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, placed in sequences."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_junk), ("line_dedup", drop_lines), ("minhash", drop_copies), ("packing", pack)]

#: SQL cannot express the classifier, the estimated accuracies or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is stored before the next one starts."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
