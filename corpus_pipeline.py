"""Corpus pipeline: each stage takes (spark, docs, sf_dir), and all but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgauge.llm import op1_suffix_dedup, op2_quality, op6_jaccard_join, op9_packing, op10_decontaminate
from siftgauge.llm.store import new_folder

#: Near-duplicate stages take five words and a similarity of 0.8.
NEAR_WIDTH, NEAR_PERCENT = 5, 80
#: No SQL is registered; the README names the tests of the operators that stand in for it.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    return op2_quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that with the smallest id, and all without words."""
    return op6_jaccard_join.one_of_each(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that also stand elsewhere; n_chars follows the text."""
    cut_out = op1_suffix_dedup.without_repeats(docs)
    return cut_out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text"), F.lit(0))).cast(docs.schema["n_chars"].dataType))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have no passage of the benchmark."""
    return op10_decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket, batch and place of each document."""
    return op9_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("benchmark decontamination", decontaminated), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's rows written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
