"""Sensitivities kept up to date over micro-batches of cameras: max, and sum with count, merge exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reduce(ratios: DataFrame) -> DataFrame:
    """Streaming or batch: item, sens_max and the parts of the mean from (item, ratio)."""
    return ratios.groupBy("item").agg(F.max("ratio").alias("sens_max"), F.sum("ratio").alias("s"), F.count(F.lit(1)).alias("k"))


def merge(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The state after a batch; both as `reduce` gives them."""
    return state.unionByName(batch).groupBy("item").agg(F.max("sens_max").alias("sens_max"), F.sum("s").alias("s"), F.sum("k").alias("k"))


def finish(state: DataFrame) -> DataFrame:
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return state.select("item", F.round(clamp(F.col("sens_max")), 9).alias("sens_max"), F.round(clamp(F.col("s") / F.greatest("k", F.lit(1))), 9).alias("sens_mean"))
