"""Gapless numbering inside groups of any size, without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"


def in_blocks(df: DataFrame, by: list[Column], rows: int, rows_per_block: int = 200_000) -> DataFrame:
    """`df` in blocks of neighbours in the order `by`, numbered by BLOCK; cut the lineage before use."""
    return df.repartitionByRange(max(4, -(-rows // rows_per_block)), *by).withColumn(BLOCK, F.spark_partition_id())


def numbered(df: DataFrame, groups: list[str], order: list[Column], into: str) -> DataFrame:
    """Adds `into`: 0, 1, ... inside each group.  Rows are counted per block, and the blocks' counts summed up."""
    counts = df.groupBy(*groups, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*groups, BLOCK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = df.withColumn("_k", F.row_number().over(Window.partitionBy(*groups, BLOCK).orderBy(*order)))
    return own.join(base, [*groups, BLOCK]).withColumn(into, F.col("_base") + F.col("_k") - 1).drop("_base", "_k")
