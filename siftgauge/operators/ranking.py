"""Places and running sums over a whole table in one order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import cut


def numbered(df: DataFrame, by: list[str], into: str, value: str | None = None) -> DataFrame:
    """Adds `into`: 1, 2, ... in the order `by`; with `value` also `lo` and `hi`, its sums before and up to each row.

    Rows are dealt by ranges of the order; places and sums inside a range are added to those of the ranges before,
    of which there is one row for each range.
    """
    order = [F.expr(b.removesuffix(" DESC")).desc() if b.endswith(" DESC") else F.expr(b).asc() for b in by]
    placed = cut(df.repartitionByRange(*order).withColumn("_block", F.spark_partition_id()))
    inside, before = Window.partitionBy("_block").orderBy(*order), Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.expr(value)) if value else F.lit(0e0)
    blocks = placed.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"), total.alias("_s"))
    blocks = blocks.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(before), F.lit(0e0)).alias("_s"))
    out = placed.withColumn("_k", F.row_number().over(inside))
    if value:
        out = out.withColumn("_hi", F.sum(F.expr(value)).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(F.broadcast(blocks), "_block").withColumn(into, F.col("_n") + F.col("_k"))
    if value:
        out = out.withColumn("hi", F.col("_s") + F.col("_hi")).withColumn("lo", F.col("hi") - F.expr(value))
    return out.drop("_block", "_n", "_s", "_k", "_hi")
