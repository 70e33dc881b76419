"""Queries that are loops or files rather than one statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import selection, voxels
from ..sources import ply
from ..streaming import incremental
from . import catalog
from .recursive import CHANCE
from .store import cut, new_folder

SIZE = 24


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.build(spark, sf_dir, "pts").select(F.col("gid").alias("id"), "x", "y", "z", "alpha")


def _blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.build(spark, sf_dir, "dil")


def s01_ply_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the scene as PLY files and scans one of them back."""
    spark.dataSource.register(ply.PlyDataSource)
    g = catalog.build(spark, sf_dir, "gauss")
    rows = g.select(F.col("gid").alias("gaussian_id"), *(F.col(c).cast("float") for c in "xyz"), F.col("logit").cast("float").alias("opacity"), *(F.col(f"dc{k}").cast("float").alias(f"f_dc_{k}") for k in range(3)), *(F.col(f"ls{k}").cast("float").alias(f"scale_{k}") for k in range(3)), *(F.col(f"q{k}").cast("float").alias(f"rot_{k}") for k in range(4)), F.array(*(F.col(f"sh{k}").cast("float") for k in range(45))).alias("f_rest"))
    path = new_folder(spark, "ply")
    rows.coalesce(1).sortWithinPartitions("gaussian_id").write.format("ply").mode("append").save(path)
    return spark.read.format("ply").option("path", f"{path}/part-00000.ply").option("rows_per_split", "200").load().select("gaussian_id", F.round("x", 4).alias("x"), F.round("opacity", 3).alias("opacity"), F.round(F.col("f_rest")[44], 4).alias("last_rest"))


def i03_flood_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.outside_interior(_blocked(spark, sf_dir), SIZE).select("ix", "iy", "iz", "interior")


def i04_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = voxels.components(_blocked(spark, sf_dir), SIZE)
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("cells"), F.min("ix").alias("x0"), F.max("ix").alias("x1"))


def i05_distance_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _blocked(spark, sf_dir)
    return voxels.distances(cells, cells.where("ix <= 6"))


def i06_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.gradient(i05_distance_field(spark, sf_dir))


def t10_farthest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.farthest_points(_points(spark, sf_dir), 192)


def t11_poisson_discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.poisson_discs(_points(spark, sf_dir), 0.8, F.expr(CHANCE))


def _poses(spark: SparkSession, sf_dir: str, made: dict) -> DataFrame:
    """Candidate eyes with what the score looks at: place, direction, the target most of their sight is near, and its bins."""
    built = lambda name: catalog.build(spark, sf_dir, name, made)
    main = built("j13_eye_target_sample").groupBy("eye").agg(F.min(F.struct((-F.col("n")).alias("n"), "target")).alias("t")).select("eye", "t.target")
    rows = built("look").join(main, "eye").join(F.broadcast(built("centre")), "target")
    apart = F.sqrt((F.col("ex") - F.col("tx")) ** 2 + (F.col("ey") - F.col("ty")) ** 2 + (F.col("ez") - F.col("tz")) ** 2)
    along = {c: -F.col(f"e{c}") / 4 for c in "xyz"}
    sign = sum((F.when(F.col(f"e{c}") > F.col(f"t{c}"), v).otherwise(0) for c, v in zip("xyz", (1, 2, 4), strict=True)), F.lit(0))
    return cut(rows.select(F.col("eye").cast("long").alias("cand"), "ex", "ey", "ez", *(along[c].alias(f"f{c}") for c in "xyz"), F.col("target").cast("long").alias("target"), sign.alias("dir_bin"), F.floor(apart).alias("dist_bin")))


def _sights(spark: SparkSession, sf_dir: str, made: dict) -> tuple[DataFrame, DataFrame]:
    vis = catalog.build(spark, sf_dir, "vis", made)
    return cut(vis.select(F.col("eye").cast("long").alias("cand"), F.col("gid").alias("item"))), cut(vis.select(F.col("gid").alias("item"), F.col("alpha").alias("w")).distinct())


def i11_greedy_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views by what they newly cover, less their likeness to those before, and more for seldom seen directions and targets."""
    made: dict = {}
    masks, weights = _sights(spark, sf_dir, made)
    return selection.greedy_cover(masks, weights, 6, _poses(spark, sf_dir, made), 0.5)


def u04_greedy_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views by what they newly cover alone."""
    return selection.greedy_cover(*_sights(spark, sf_dir, {}), 6).select("round", "cand", "gain")


def p46_boundary_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of each point to the boundary: that of its voxel, in steps, times the mean edge of a voxel."""
    made: dict = {}
    grid = voxels.outside_interior(catalog.build(spark, sf_dir, "dil", made), SIZE)
    shell = catalog.build(spark, sf_dir, "dil", made).select(*voxels.KEY)
    every = grid.select(*voxels.KEY).unionByName(shell)
    dist = cut(voxels.distances(every, shell))
    edge = catalog.build(spark, sf_dir, "box", made).select(((F.col("hix") - F.col("lox")) + (F.col("hiy") - F.col("loy")) + (F.col("hiz") - F.col("loz"))) / 3 / (SIZE - 1))
    step = edge.first()[0]
    eyes = catalog.build(spark, sf_dir, "p25_eye_voxels", made)
    return eyes.join(dist, voxels.KEY, "left").select("eye", (F.round(F.col("dist") * F.lit(step), 6)).alias("d"))


def f09_point_in_closed_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eyes by whether their voxel is interior, and the label of the free room that it belongs to."""
    made: dict = {}
    grid = cut(voxels.outside_interior(catalog.build(spark, sf_dir, "dil", made), SIZE))
    eyes = catalog.build(spark, sf_dir, "p25_eye_voxels", made)
    return eyes.join(grid, voxels.KEY, "left").select("eye", F.coalesce("interior", F.lit(False)).alias("interior"), F.when(F.col("interior"), F.col("label")).alias("label"))


def i10_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets: farthest points of the scene with the corners, face centres and centre of its box, thinned by discs."""
    made: dict = {}
    points = catalog.build(spark, sf_dir, "pts", made).select(F.col("gid").alias("id"), "x", "y", "z")
    far = selection.farthest_points(points, 48).join(points, "id").select("id", "x", "y", "z")
    fixed = catalog.build(spark, sf_dir, "box_points", made)
    radius = 0.08 * fixed.agg(F.sqrt((F.max("x") - F.min("x")) ** 2 + (F.max("y") - F.min("y")) ** 2 + (F.max("z") - F.min("z")) ** 2)).first()[0]
    both = cut(far.unionByName(fixed.select("id", "x", "y", "z")))
    return both.join(selection.poisson_discs(both, radius, F.col("id")), "id").select("id", *(F.round(c, 6).alias(c) for c in "xyz"))


def a07_incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    made: dict = {}
    own, all_ = catalog.build(spark, sf_dir, "own_pixel_l1", made), catalog.build(spark, sf_dir, "all_pixel_l1", made)
    ratios = own.join(all_, "k").select("item", "k", (F.col("n") / F.greatest("d", F.lit(1.1920929e-07))).alias("ratio"))
    state = None
    for part in range(4):
        batch = incremental.reduce(ratios.where(F.col("k") % 4 == part))
        state = batch if state is None else cut(incremental.merge(state, batch))
    return incremental.finish(state)


QUERIES = {f.__name__: f for f in (s01_ply_scan, i03_flood_fill, i04_components, i05_distance_field, i06_gradient, t10_farthest_points, t11_poisson_discs, i11_greedy_cover, u04_greedy_gain, p46_boundary_distance, f09_point_in_closed_roi, i10_targets, a07_incremental_merge)}
ORACLES = {
    "a07_incremental_merge": catalog.sql("a07_cross_batch_reduce"),
    "s01_ply_scan": "SELECT vec_id AS gaussian_id, round(CAST(8 * embedding[1] AS FLOAT), 4) AS x, round(CAST(16 * embedding[52] AS FLOAT), 3) AS opacity, round(CAST(0.4e0 * embedding[51] AS FLOAT), 4) AS last_rest FROM embeddings",
}
