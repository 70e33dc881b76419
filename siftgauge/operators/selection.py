"""Selections that depend on what was selected before: farthest points, Poisson discs, greedy cover."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.store import cut

AXES = ["x", "y", "z"]


def _squared(a: list[Column], b: list[Column]) -> Column:
    return sum(((p - q) * (p - q) for p, q in zip(a, b, strict=True)), F.lit(0.0))


#: Candidates that the driver holds at once, the farthest of all points, and selections after which distances are written.
CANDIDATES, EVERY = 4096, 32


def farthest_points(points: DataFrame, k: int, candidates: int = CANDIDATES) -> DataFrame:
    """(rank, id): k-centre greedy order over all (id, x, y, z), from the least id; of equally far points the least id.

    Distances to what is selected only fall, so among the farthest points the next ones can be picked one after the
    other for as long as the farthest of them lies beyond every point that is not among them.
    """
    first = points.agg(F.min(F.struct("id", *AXES)).alias("p")).first()["p"]
    if first is None or k < 1:
        return points.sparkSession.createDataFrame([], "rank long, id long")
    state, chosen, since = points.select("id", *AXES, F.lit(math.inf).alias("d")), [first["id"]], [[first[a] for a in AXES]]
    while len(chosen) < k:
        for lo in range(0, len(since), EVERY):
            d = F.least("d", *(_squared([F.col(a) for a in AXES], [F.lit(v) for v in p]) for p in since[lo : lo + EVERY]))
            state = cut(state.withColumn("d", d))
        top = state.orderBy(F.col("d").desc(), "id").limit(candidates).toPandas().sort_values("id")
        xyz, left, ids, since = top[AXES].to_numpy(), top["d"].to_numpy(copy=True), top["id"].to_numpy(), []
        beyond = left.min() if len(top) == candidates else -1.0
        while len(chosen) < k:
            i = int(left.argmax())
            if left[i] <= 0 or since and left[i] <= beyond:
                break
            chosen.append(int(ids[i]))
            since.append(xyz[i].tolist())
            left = np.minimum(left, ((xyz - xyz[i]) ** 2).sum(axis=1))
        if not since:
            break
    return points.sparkSession.createDataFrame(list(enumerate(chosen)), "rank long, id long")


def poisson_discs(points: DataFrame, radius: float, order: Column | None = None) -> DataFrame:
    """ids of all points that greedy thinning accepts in the order of their hashes, any two at least `radius` apart.

    Any two points of a cell of side radius / sqrt(3) are too close, so in each round only a cell's first undecided
    point can be accepted: it is if no undecided point before it is within the radius.  Points near accepted ones go.
    """
    side = radius / math.sqrt(3)
    cell = [F.floor(F.col(a) / side).cast("long") for a in AXES]
    left = cut(points.select("id", *AXES, (F.xxhash64("id") if order is None else order).alias("o"), *(c.alias(f"c{a}") for c, a in zip(cell, AXES, strict=True))))
    keys = [f"c{a}" for a in AXES]
    accepted = None
    around = F.array(*(F.struct(*(F.lit(v).alias(a) for v, a in zip((i, j, k), AXES, strict=True))) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3)))
    while left.head(1):
        firsts = left.groupBy(*keys).agg(F.min(F.struct("o", "id", *AXES)).alias("f"))
        # A cell's first point is sent to the cells around it.
        sent = cut(firsts.withColumn("s", F.explode(around)).select(*((F.col(f"c{a}") + F.col(f"s.{a}")).alias(f"c{a}") for a in AXES), *(F.col(f"f.{c}").alias(f"f_{c}") for c in ("o", "id", *AXES))))
        near = left.join(sent, keys).where(_squared([F.col(a) for a in AXES], [F.col(f"f_{a}") for a in AXES]) < radius * radius)
        blocked = near.where(F.struct("o", "id") < F.struct(F.col("f_o").alias("o"), F.col("f_id").alias("id"))).select("f_id").distinct()
        new = cut(sent.select("f_id", "f_o").distinct().join(blocked, "f_id", "left_anti"))
        gone = near.join(new.select("f_id"), "f_id").select("id").distinct()
        left = cut(left.join(gone, "id", "left_anti"))
        accepted = new.select(F.col("f_id").alias("id")) if accepted is None else accepted.unionByName(new.select(F.col("f_id").alias("id")))
    return points.select("id").limit(0) if accepted is None else accepted


# Weights of the penalty for likeness and of the rewards for new directions, distances and targets; how
# many selections are remembered; the overlap and the cosine from which two poses are alike.
PENALTY, DIRECTION, DISTANCE, TARGET, RECENT, OVERLAP, ALIKE = 0.7, 0.8, 0.45, 0.25, 64, 0.6, math.cos(math.radians(8))


def greedy_cover(masks: DataFrame, weights: DataFrame, k: int, poses: DataFrame | None = None, near: float = 0.0) -> DataFrame:
    """(round, cand, gain, score): k rounds of the candidate with the best score; masks (cand, item), weights (item, w).

    The gain is the weight of items that no selected candidate covers.  With `poses` (cand, ex, ey, ez, fx, fy, fz,
    target, dir_bin, dist_bin) likeness to the last RECENT selections is penalised, by distance under `near`, by
    direction, and by overlap of the masks where one of these is alike; bins and targets seldom selected are rewarded.
    """
    spark, out, taken = masks.sparkSession, [], []
    items = cut(masks.join(weights, "item"))
    sizes = cut(masks.groupBy("cand").agg(F.count(F.lit(1)).alias("n")))
    overlaps = None
    for r in range(k):
        gains = items.groupBy("cand").agg(F.sum("w").alias("gain"))
        scored = sizes.join(gains, "cand", "left").withColumn("gain", F.coalesce("gain", F.lit(0.0))).where(~F.col("cand").isin([x["cand"] for x in taken]) if taken else F.lit(True))
        score = F.col("gain")
        if poses is not None:
            scored = scored.join(poses, "cand")
            penalty = F.lit(0.0)
            for x in taken[-RECENT:]:
                apart = F.sqrt(_squared([F.col(c) for c in ("ex", "ey", "ez")], [F.lit(x[c]) for c in ("ex", "ey", "ez")]))
                along = sum((F.col(c) * F.lit(x[c]) for c in ("fx", "fy", "fz")), F.lit(0.0))
                penalty = penalty + F.greatest(F.lit(0.0), (near - apart) / max(near, 1e-6)) + F.greatest(F.lit(0.0), (along - ALIKE) / (1 - ALIKE))
                share = F.coalesce(F.element_at("with", F.lit(x["cand"])), F.lit(0)) if overlaps is not None else F.lit(0)
                jaccard = share / (F.col("n") + F.lit(x["n"]) - share)
                penalty = penalty + F.when(((apart < near) | (along > ALIKE)) & (jaccard > OVERLAP), jaccard - OVERLAP).otherwise(0.0)
            if overlaps is not None:
                scored = scored.join(overlaps, "cand", "left")
            seen = lambda *cols: sum((F.when(_all(x, cols), 1).otherwise(0) for x in taken), F.lit(0))
            score = score - PENALTY * penalty + DIRECTION / (1 + seen("target", "dir_bin")) + DISTANCE / (1 + seen("target", "dist_bin")) + TARGET / (1 + seen("target"))
        best = scored.withColumn("score", score).orderBy(F.round("score", 9).desc(), "cand").first()
        if best is None or (poses is None and best["gain"] <= 0):
            break
        taken.append(best.asDict())
        out.append((r, best["cand"], round(best["gain"], 6), round(best["score"], 6)))
        own = masks.where(F.col("cand") == best["cand"]).select("item")
        items = cut(items.where(F.col("cand") != best["cand"]).join(own, "item", "left_anti"))
        if poses is not None:
            recent = masks.where(F.col("cand").isin([x["cand"] for x in taken[-RECENT:]])).select(F.col("cand").alias("other"), "item")
            both = masks.join(recent, "item").groupBy("cand", "other").agg(F.count(F.lit(1)).alias("n"))
            overlaps = cut(both.groupBy("cand").agg(F.map_from_entries(F.collect_list(F.struct("other", "n"))).alias("with")))
    return spark.createDataFrame(out, "round long, cand long, gain double, score double")


def _all(x: dict, cols: tuple[str, ...]) -> Column:
    test = F.lit(True)
    for c in cols:
        test = test & (F.col(c) == F.lit(x[c]))
    return test
