"""Flood fill, components and distances on sparse voxels, by frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import cut

KEY = ["ix", "iy", "iz"]
_STEPS = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def neighbours(cells: DataFrame, *keep: str) -> DataFrame:
    steps = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(s, "abc", strict=True))) for s in _STEPS))
    return cells.withColumn("s", F.explode(steps)).select((F.col("ix") + F.col("s.a")).alias("ix"), (F.col("iy") + F.col("s.b")).alias("iy"), (F.col("iz") + F.col("s.c")).alias("iz"), *keep)


def components(cells: DataFrame, size: int) -> DataFrame:
    """cells with `label`: the least linear index of the 6-connected component."""
    linear = (F.col("ix") * size + F.col("iy")) * size + F.col("iz")
    now = cut(cells.select(*KEY, linear.cast("long").alias("label")))
    while True:
        best = neighbours(now, "label").groupBy(*KEY).agg(F.min("label").alias("other"))
        new = cut(now.join(best, KEY, "left").select(*KEY, F.least("label", F.coalesce("other", "label")).alias("label"), (F.coalesce("other", "label") < F.col("label")).alias("changed")))
        # Jump to the label of the labelled cell, which halves the depth each round.
        root = new.select(linear.cast("long").alias("label"), F.col("label").alias("up"))
        now = cut(new.join(root, "label", "left").select(*KEY, F.least("label", F.coalesce("up", "label")).alias("label")))
        if not new.where("changed").head(1):
            return now


def outside_interior(blocked: DataFrame, size: int) -> DataFrame:
    """Free cells of a size^3 grid with `interior`: whether no free path leads to the boundary."""
    axis = lambda n: blocked.sparkSession.range(size).select(F.col("id").cast("int").alias(n))
    free = axis("ix").crossJoin(F.broadcast(axis("iy"))).crossJoin(F.broadcast(axis("iz"))).join(blocked.select(*KEY), KEY, "left_anti")
    labelled = components(free, size)
    edge = F.greatest(*(((F.col(k) == 0) | (F.col(k) == size - 1)).cast("int") for k in KEY))
    open_ = labelled.where(edge == 1).select("label").distinct().withColumn("o", F.lit(True))
    return labelled.join(open_, "label", "left").select(*KEY, "label", F.col("o").isNull().alias("interior"))


def distances(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """cells reached from `sources` with `dist`, the number of 6-connected steps; goes on until no cell is new."""
    done = cut(sources.join(cells, KEY, "left_semi").select(*KEY).distinct().withColumn("dist", F.lit(0)))
    frontier, step = done, 0
    while True:
        step += 1
        frontier = cut(neighbours(frontier).distinct().join(cells, KEY, "left_semi").join(done, KEY, "left_anti").withColumn("dist", F.lit(step)))
        if not frontier.head(1):
            break
        done = cut(done.unionByName(frontier))
    return done


def gradient(dist: DataFrame) -> DataFrame:
    """Central differences of `dist`; a missing neighbour counts as the cell itself."""
    out = dist
    for axis, k in zip("xyz", KEY, strict=True):
        for sign, name in ((1, "up"), (-1, "down")):
            other = dist.select(*((F.col(c) - sign if c == k else F.col(c)).alias(c) for c in KEY), F.col("dist").alias(f"{name}{axis}"))
            out = out.join(other, KEY, "left")
        out = out.withColumn(f"g{axis}", (F.coalesce(f"up{axis}", "dist") - F.coalesce(f"down{axis}", "dist")) / F.lit(2.0)).drop(f"up{axis}", f"down{axis}")
    return out
