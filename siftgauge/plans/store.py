"""Lineage cuts and files in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs on one machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='siftgauge-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/siftgauge/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of `df`, written once as Parquet to the shared folder and read from there."""
    path = new_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
