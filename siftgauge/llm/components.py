"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Tables

FILE_ROWS = 1_000_000


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v; each node's neighbours are hung below its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")) if large else both.groupBy("u").agg(F.min("v").alias("m"))
    hung = both.join(least, "u")
    if large:
        hung = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return hung.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in `edges` (u, v) other than the roots; the root is the least node of the component.

    Steps go on until nothing changes, which takes a number of them that grows with the logarithm of the longest path.
    Each step's edges, never more than the nodes and edges before, are written to files of about FILE_ROWS.
    """
    tables = Tables(edges.sparkSession, "components")
    files = lambda n: max(1, -(-n // FILE_ROWS))
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    edges = tables.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().coalesce(files(edges.count())))
    was = None
    while (now := mark(edges)) != was:
        was, last = now, edges
        edges = tables.write(_step(_step(edges, True), False).coalesce(files(2 * now[0])))
        tables.drop(last)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
