"""Queries that write files from the tables and scan them again: cameras, manifests, metrics, listings, images, models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import cameras, ply
from . import catalog, geometry, report, sensitivity  # noqa: F401  (their stages)
from .store import cut, new_folder


def _lines(df: DataFrame, path: str) -> None:
    df.select("value").write.text(path)


def s05_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each dialect of container, size, intrinsics and pose; all give the same cameras."""
    cam = catalog.build(spark, sf_dir, "cam")
    row = lambda a, e=None: f"array({a}x, {a}y, {a}z" + (f", {e}" if e else "") + ")"
    t = {a: f"-({a}x * ex + {a}y * ey + {a}z * ez)" for a in "ruf"}
    w2c = "array(" + ", ".join(row(a, t[a]) for a in "ruf") + ", array(0D, 0D, 0D, 1D))"
    r, shift = "array(" + ", ".join(map(row, "ruf")) + ")", "array(" + ", ".join(t.values()) + ")"
    back = [f"r{c}, u{c}, f{c}" for c in "xyz"]
    c2w = "array(" + ", ".join(f"{x}, e{c}" for x, c in zip(back, "xyz", strict=True)) + ")"
    turn, eye = "array(" + ", ".join(f"array({x})" for x in back) + ")", "array(ex, ey, ez)"
    f = "(32D / tan(pi() / 6D))"
    k3, p4 = f"array(array({f}, 0D, 32D), array(0D, {f}, 32D), array(0D, 0D, 1D))", "array(array(1D / tan(pi() / 6D), 0D, 0D, 0D), array(0D, 1D / tan(pi() / 6D), 0D, 0D), array(0D, 0D, 1D, 0D), array(0D, 0D, 1D, 0D))"
    dialects = [
        ("named_struct('w', 64, 'h', 64, 'frames', {})", f"named_struct('FoVx', 60D, 'FoVy', 60D, 'world_view_transform', {w2c})"),
        ("{}", f"named_struct('width', 64, 'height', 64, 'fl_x', {f}, 'fl_y', {f}, 'camera_to_world', {c2w})"),
        ("named_struct('cameras', {})", f"named_struct('image_width', 64, 'image_height', 64, 'K', {k3}, 'R', {r}, 'T', {shift})"),
        ("named_struct('frames', array(), 'train_cameras', {})", f"named_struct('W', 64, 'H', 64, 'projection_matrix', {p4}, 'extrinsics', named_struct('R', {r}, 't', {shift}))"),
        ("named_struct('test_cameras', {}, 'width', 64, 'height', 64)", f"named_struct('fx', {f}, 'fy', {f}, 'rotation', {turn}, 'position', {eye})"),
        ("named_struct('cameras', {}, 'w', 64, 'h', 64)", f"named_struct('intrinsics', named_struct('K', {k3}), 'pose', array({', '.join(f'array({x}, e{c})' for x, c in zip(back, 'xyz', strict=True))}, array(0D, 0D, 0D, 1D)))"),
    ]
    folder, paths = new_folder(spark, "cameras"), []
    for n, (container, frame) in enumerate(dialects):
        listed = "transform(array_sort(collect_list(struct(cam, c))), x -> x.c)"
        paths.append(f"{folder}/{n}")
        _lines(cam.selectExpr("cam", f"{frame} AS c").groupBy().agg(F.expr(f"to_json({container.format(listed)})").alias("value")), paths[-1])
    got = cameras.load_cameras(spark, paths)
    return got.select("cam_ord", "width", "height", *(F.round(c, 7).alias(c) for c in ("fx", "fy", "fovx", "fovy")), *((F.round(F.col("w2c")[k], 6) + 0.0).alias(f"m{k}") for k in range(12)), *((F.round(c, 6) + 0.0).alias(c) for c in ("cx", "cy", "cz")))


_T = {a: f"-({a}x * ex + {a}y * ey + {a}z * ez)" for a in "ruf"}
_M = [x for a in "ruf" for x in (f"{a}x", f"{a}y", f"{a}z", _T[a])]
_CAM = "SELECT d * (SELECT count(*) FROM cam) + row_number() OVER (PARTITION BY d ORDER BY cam) - 1 AS cam_ord, 64 AS width, 64 AS height, round(32 / tan(pi() / 6), 7) AS fx, round(32 / tan(pi() / 6), 7) AS fy, round(pi() / 3, 7) AS fovx, round(pi() / 3, 7) AS fovy, " + ", ".join(f"round({x}, 6) + 0 AS m{k}" for k, x in enumerate(_M)) + ", round(ex, 6) + 0 AS cx, round(ey, 6) + 0 AS cy, round(ez, 6) + 0 AS cz FROM cam, (SELECT unnest(range(0, 6)) AS d) n"
_MANIFEST = "CASE o_orderkey % 7 WHEN 0 THEN '# ' || o_orderkey WHEN 1 THEN '   ' WHEN 2 THEN 'scene/' || o_orderkey WHEN 3 THEN 'scene/' || o_orderkey || ' , Outdoor ' WHEN 4 THEN 'scene/' || o_orderkey || ',garden' WHEN 5 THEN 'scene/' || o_orderkey || ',INDOOR,more' ELSE ' scene/' || o_orderkey || ',indoor' END"


def s10_manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a manifest: comments and blank lines go, short lines and unknown labels are counted as rejected."""
    path = new_folder(spark, "manifest")
    _lines(spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(f"{_MANIFEST} AS value"), path)
    return spark.sql(_PARSED + " SELECT label, why, count(*) AS n, min(path) AS first FROM judged GROUP BY label, why", lines=spark.read.text(path))


_PARSED = """WITH parts AS (SELECT trim(split_part(value, ',', 1)) AS path, CASE WHEN value LIKE '%,%' THEN lower(trim(split_part(value, ',', 2))) END AS label FROM {lines} WHERE trim(value) <> '' AND NOT trim(value) LIKE '#%'),
judged AS (SELECT path, label, CASE WHEN label IS NULL THEN 'short' WHEN label NOT IN ('indoor', 'outdoor') THEN 'label' ELSE 'kept' END AS why FROM parts)"""


def s12_metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics written as CSV with a header and read as text; blank and bad numbers are null."""
    path = new_folder(spark, "metrics")
    made = catalog.build(spark, sf_dir, "metric").selectExpr("concat(' ', dataset, '_', granularity, '.png') AS file", *_CELLS)
    made.write.option("header", True).csv(path)
    read = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return read.selectExpr("file", *(f"round(try_cast(trim({c}) AS DOUBLE), 6) AS {c}" for c in ("psnr", "dssim", "lpips")))


#: Whole doubles: a cell rounded to 8 digits can round up once more when it is read.
_CELLS = ("CASE WHEN n % 5 = 0 THEN ' ' WHEN n % 5 = 1 THEN 'n/a' ELSE CAST(psnr AS VARCHAR(40)) END AS psnr", "CAST((1 - ssim) / 2 AS VARCHAR(40)) AS dssim", "CASE WHEN n % 3 = 0 THEN NULL ELSE CAST(lpips AS VARCHAR(40)) END AS lpips")


def s13_results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """variant -> metric -> view -> value as one JSON document, and back to rows."""
    path = new_folder(spark, "results")
    m = catalog.build(spark, sf_dir, "metric").selectExpr("dataset", "granularity", "stack(2, 'PSNR', round(psnr, 6), 'SSIM', round(ssim, 6)) AS (metric, value)")
    views = m.groupBy("dataset", "metric").agg(F.map_from_entries(F.collect_list(F.struct("granularity", "value"))).alias("v"))
    kinds = views.groupBy("dataset").agg(F.map_from_entries(F.collect_list(F.struct("metric", "v"))).alias("v"))
    _lines(kinds.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("dataset", "v")))).alias("value")), path)
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, map<string, double>>>").alias("j"))
    return whole.select(F.explode("j").alias("variant", "m")).select("variant", F.explode("m").alias("metric", "v")).select("variant", "metric", F.explode("v").alias("view", "value"))


def s14_training_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two runs appended to one log with headers, and the averages of each set."""
    path = new_folder(spark, "training")
    for part in (0, 1):
        rows = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_id") % 2 == part)
        rows.selectExpr("event_id AS iteration", "event_type AS set", "round(value, 6) AS l1_loss", "round(value / 2, 6) AS psnr").write.mode("append").option("header", True).csv(path)
    read = spark.read.option("header", True).schema("iteration long, set string, l1_loss double, psnr double").csv(path)
    return read.groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l1_loss"), 6).alias("l1_loss"), F.round(F.avg("psnr"), 6).alias("psnr"), F.max("iteration").alias("last"))


def s15_image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered images written as PPM files, found by a glob and decoded: mean of each channel."""
    folder = new_folder(spark, "images")
    pixels = catalog.build(spark, sf_dir, "image").selectExpr("cam", "py * 64 + px AS at", *(f"CAST(rint(d{k} * 255) AS INT) AS c{k}" for k in range(3)))
    images = pixels.groupBy("cam").agg(F.collect_list(F.struct("at", "c0", "c1", "c2")).alias("p"))  # an image has a fixed size

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cam, p in zip(batch["cam"], batch["p"], strict=True):
                out = np.zeros((64 * 64, 3), np.uint8)
                for x in p:
                    out[x["at"]] = (x["c0"], x["c1"], x["c2"])
                store, place = ply._open(f"{folder}/view_{cam:05d}.ppm")
                store.create_dir(place.rpartition("/")[0], recursive=True)
                with store.open_output_stream(place) as f:
                    f.write(b"P6\n64 64\n255\n" + out.tobytes())
            yield pd.DataFrame({"n": [len(batch)]})

    images.mapInPandas(put, "n long").agg(F.sum("n")).collect()

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                data = np.frombuffer(content[content.index(b"\n255\n") + 5 :], np.uint8).reshape(-1, 3) / 255
                rows.append((path.rpartition("/")[2], *data.mean(axis=0).round(6)))
            yield pd.DataFrame(rows, columns=["file", "r", "g", "b"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.ppm").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", "content").mapInPandas(decode, "file string, r double, g double, b double")


_NAMES = "CASE s_suppkey % 5 WHEN 0 THEN 'chkpnt' || s_suppkey || '.pth' WHEN 1 THEN 'point_cloud/iteration_' || s_suppkey || '/point_cloud.ply' WHEN 2 THEN 'point_cloud.ply' WHEN 3 THEN 'per_pixel_l1_max.pt' ELSE 'per_tile_l2_mean_nocolor.pt' END"
#: What the listing's file names mean: the run's iteration (a checkpoint before a point cloud), and a tensor's level, norm and reduction.
_MEANT = """SELECT run, name, regexp_extract(name, '^(per_[a-z]+)_(l1|l2)_(max|mean)(_nocolor)?[.]pt$', 1) AS level, regexp_extract(name, '^(per_[a-z]+)_(l1|l2)_(max|mean)(_nocolor)?[.]pt$', 2) AS norm, regexp_extract(name, '^(per_[a-z]+)_(l1|l2)_(max|mean)(_nocolor)?[.]pt$', 3) AS reduction,
name LIKE '%_nocolor.pt' AS nocolour, CASE WHEN name LIKE 'chkpnt%' THEN 0 WHEN name LIKE '%/iteration_%' THEN 1 WHEN name LIKE '%.ply' THEN 2 END AS choice,
CASE WHEN NOT name LIKE '%.pt' THEN coalesce(try_cast(regexp_extract(name, 'chkpnt([0-9]+)', 1) AS BIGINT), try_cast(regexp_extract(name, 'iteration_([0-9]+)', 1) AS BIGINT), 30000) END AS iteration FROM {names}"""


def s18_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of model folders: layout, resume iteration and tensor names from the paths that a listing gives."""
    folder = new_folder(spark, "models")
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("CAST(s_nationkey AS INT) AS run", f"{_NAMES} AS name").distinct()

    def touch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for run, name in zip(batch["run"], batch["name"], strict=True):
                store, place = ply._open(f"{folder}/run-{run}/{name}")
                store.create_dir(place.rpartition("/")[0], recursive=True)
                with store.open_output_stream(place) as f:
                    f.write(b"x")
            yield pd.DataFrame({"n": [len(batch)]})

    names.mapInPandas(touch, "n long").agg(F.sum("n")).collect()
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    found = listed.select(F.regexp_extract("path", r"/run-(\d+)/(.*)$", 1).cast("int").alias("run"), F.regexp_extract("path", r"/run-(\d+)/(.*)$", 2).alias("name"))
    return spark.sql(_MEANT, names=found)


def s21_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The artifact that each run resumes from: checkpoints before iterations before a bare point cloud, the latest of them."""
    found = cut(s18_listing(spark, sf_dir))
    return spark.sql(_RESUME, found=found)


_RESUME = "SELECT run, name, iteration FROM (SELECT run, name, iteration, row_number() OVER (PARTITION BY run ORDER BY choice, iteration DESC, name) AS place FROM {found} WHERE choice IS NOT NULL) r WHERE place = 1"


def u05_listing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listing holds beside tensors."""
    return s18_listing(spark, sf_dir).where("NOT name LIKE '%.pt'").select("run", "name")


def _model(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """A gaussian model with the columns of the file format, from scene columns."""
    return rows.select(F.col("gid").alias("gaussian_id"), *(F.col(c).cast("float") for c in "xyz"), F.col("logit").cast("float").alias("opacity"), *(F.col(f"dc{k}").cast("float").alias(f"f_dc_{k}") for k in range(3)), *(F.col(f"ls{k}").cast("float").alias(f"scale_{k}") for k in range(3)), *(F.col(f"q{k}").cast("float").alias(f"rot_{k}") for k in range(4)), F.array(*(F.col(f"sh{k}").cast("float") for k in range(45))).alias("f_rest"))


def s02_coreset_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reweighted coreset as one ordered model file, scanned again."""
    spark.dataSource.register(ply.PlyDataSource)
    path = f"{new_folder(spark, 'model')}"
    kept = catalog.build(spark, sf_dir, "reweighted")
    ordered = _model(spark, kept).repartitionByRange(1, "gaussian_id").sortWithinPartitions("gaussian_id")
    ordered.write.format("ply").mode("overwrite").save(path)
    back = spark.read.format("ply").option("path", f"{path}/part-00000.ply").option("rows_per_split", "100").load()
    return back.select(F.col("gaussian_id").alias("place"), *(F.round(c, 4).alias(c) for c in ("x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", "scale_0")), F.round(F.col("f_rest")[0], 4).alias("first_rest"), F.round(F.col("f_rest")[44], 4).alias("last_rest"))


def s06_sensitivity_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All levels stored by granularity, norm, reduction and colour mode; one of them loaded, with its non-zero count."""
    path = new_folder(spark, "sensitivities")
    catalog.build(spark, sf_dir, "all_levels").write.partitionBy("granularity", "norm", "reduction", "nocolour").parquet(path)
    return spark.read.parquet(path).groupBy("granularity", "norm", "reduction", "nocolour").agg(F.count_if(F.col("sens") != 0).alias("nonzero"), F.count(F.lit(1)).alias("n"), F.round(F.sum("sens"), 4).alias("mass")).withColumn("nocolour", F.col("nocolour").cast("boolean"))


def _after(stage: str, text: str) -> str:
    """SQL of `text`, which reads the stage by its name."""
    body = catalog.sql(stage)
    return f"WITH {stage} AS ({body}) {text}"


QUERIES = {f.__name__: f for f in (s05_cameras, s10_manifest_scan, s12_metrics_csv, s13_results_json, s14_training_csv, s15_image_scan, s18_listing, s21_resume, u05_listing_filter, s02_coreset_model, s06_sensitivity_store)}
_FOUND = f"(SELECT DISTINCT CAST(s_nationkey AS INT) AS run, {_NAMES} AS name FROM supplier) f"
ORACLES = {
    "s05_cameras": _after("cam", _CAM),
    "s10_manifest_scan": _PARSED.replace("{lines}", f"(SELECT {_MANIFEST} AS value FROM orders) l") + " SELECT label, why, count(*) AS n, min(path) AS first FROM judged GROUP BY label, why",
    "s12_metrics_csv": _after("metric", "SELECT dataset || '_' || granularity || '.png' AS file, CASE WHEN n % 5 > 1 THEN round(psnr, 6) END AS psnr, round((1 - ssim) / 2, 6) AS dssim, CASE WHEN n % 3 > 0 THEN round(lpips, 6) END AS lpips FROM metric"),
    "s13_results_json": _after("metric", "SELECT dataset AS variant, 'PSNR' AS metric, granularity AS view, round(psnr, 6) AS value FROM metric UNION ALL SELECT dataset, 'SSIM', granularity, round(ssim, 6) FROM metric"),
    "s14_training_csv": "SELECT event_type AS set, count(*) AS n, round(avg(round(value, 6)), 6) AS l1_loss, round(avg(round(value / 2, 6)), 6) AS psnr, max(event_id) AS last FROM events GROUP BY event_type",
    "s15_image_scan": _after("image", "SELECT 'view_' || lpad(CAST(cam AS VARCHAR), 5, '0') || '.ppm' AS file, " + ", ".join(f"round(sum(round_even(d{k} * 255, 0)) / 255 / 4096, 6) AS {c}" for k, c in enumerate("rgb")) + " FROM image GROUP BY cam"),
    "s18_listing": _MEANT.replace("{names}", _FOUND),
    "s21_resume": _RESUME.replace("{found}", "(" + _MEANT.replace("{names}", _FOUND) + ") g"),
    "u05_listing_filter": f"SELECT run, name FROM {_FOUND} WHERE NOT name LIKE '%.pt'",
    "s02_coreset_model": _after("reweighted", "SELECT row_number() OVER (ORDER BY gid) - 1 AS place, " + ", ".join(f"round(CAST({c} AS FLOAT), 4) AS {n}" for c, n in (*zip("xyz", "xyz", strict=True), *((f"dc{k}", f"f_dc_{k}") for k in range(3)), ("ls0", "scale_0"), ("sh0", "first_rest"), ("sh44", "last_rest"))) + " FROM reweighted"),
    "s06_sensitivity_store": _after("all_levels", "SELECT granularity, norm, reduction, nocolour, count_if(sens <> 0) AS nonzero, count(*) AS n, round(sum(sens), 4) AS mass FROM all_levels GROUP BY granularity, norm, reduction, nocolour"),
}
