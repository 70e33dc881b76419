"""Queries against DuckDB, the dense reference values, and the sources."""

import json
import math

import dense
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftgauge.operators import compositing, ranking, selection, voxels
from siftgauge.plans import catalog, classify, queries
from siftgauge.sources import cameras, ply

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(cols, values):
    plain = lambda v: v if v is None or isinstance(v, (str, bool)) else round(float(v), 5) + 0.0
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted(([plain(r[k]) for k in order] for r in values), key=str)


#: Loops and files that are quick enough for this test.
QUICK = {"s10_manifest_scan", "s12_metrics_csv", "s13_results_json", "s18_listing", "s21_resume"}


def stages_of(name):
    """A query's stages, itself included."""
    return {name}.union(*(stages_of(x) for x in catalog.reads(name) if x in catalog.STAGES))


def test_queries_match_sql(spark, duck):
    """Queries without cameras (held against dense arrays below) and presets, of each letter every third."""
    made: dict = {}
    names = [n for n in queries.ORACLES if n in catalog.STAGES and not stages_of(n) & {"seen_by", "io_box_smart"}]
    for name in [*names[::3], *sorted(QUICK)]:
        sql = queries.ORACLES[name]
        df = catalog.build(spark, SF, name, made) if name in catalog.STAGES else queries.QUERIES[name](spark, SF)
        got = duck.execute(sql)
        cols = [c[0] for c in got.description]
        assert sorted(cols) == sorted(df.columns), name
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(cols, got.fetchall()), name


LEVELS = (("a01_per_channel", "channel"), ("a02_per_pixel", "pixel"), ("a03_per_tile", "tile"), ("a04_per_image", "image"), ("a05_per_batch", "batch"), ("a06_per_scene", "scene"))


@pytest.fixture(scope="module")
def gaussians(duck):
    return dense.scene([r[0] for r in duck.execute("SELECT embedding FROM embeddings ORDER BY vec_id").fetchall()])


def test_dense_levels_have_the_published_means(gaussians):
    """Means of degree 0 over 500 items on two camera batches, max and mean, from another dense computation."""
    want = {"l1": ((0.733226, 0.704942, 0.077855, 0.005788, 0.002415, 0.002), (0.009975, 0.009977, 0.010231, 0.002103, 0.002006, 0.002)), "l2": ((0.631282, 0.599760, 0.051109, 0.002854, 0.001060, 0.000839), (0.005350, 0.005322, 0.005280, 0.000882, 0.000840, 0.000839))}
    for norm, both in want.items():
        found = dense.levels(gaussians, dense.cameras(10), degree=0, norm=norm)
        for k, values in enumerate(both):
            assert [round(float(found[level][k].mean()), 6) for _, level in LEVELS] == list(values)


@pytest.mark.parametrize("variant,mode", [("", {}), ("_nocolour", {"colour": False}), ("_white", {"background": 1.0})])
def test_levels_equal_dense_arrays(spark, gaussians, variant, mode):
    """Degree 3 on all cameras: every gaussian's value of every level, colour mode, norm and reduction."""
    made: dict = {}
    for norm in ("l1", "l2") if not variant else ("l1",):
        want = dense.levels(gaussians, dense.cameras(), norm=norm, **mode)
        for name, level in LEVELS:
            most, mean = np.zeros(500), np.zeros(500)
            for r in catalog.build(spark, SF, f"{name}_{norm}{variant}", made).collect():
                most[r["gid"]], mean[r["gid"]] = r["sens_max"], r["sens_mean"]
            assert abs(most - want[level][0]).max() < 6e-7 and abs(mean - want[level][1]).max() < 6e-7, (name, norm)


def test_colours_equal_dense_harmonics(spark, gaussians):
    cams = dense.cameras()
    for r in catalog.build(spark, SF, "p11_sh_colour").where("gid < 40").collect():
        rot, eye = cams[r["cam"]]
        v = rot @ (gaussians["xyz"][r["gid"]] - eye)
        for degree in range(4):
            basis = dense.harmonics((v / np.linalg.norm(v))[None], degree)[0]
            coeffs = np.concatenate([gaussians["dc"][r["gid"]][:, None], gaussians["rest"][r["gid"]]], axis=1)
            for c in range(3):
                assert abs(r[f"c{c}_degree{degree}"] - max(0, 0.5 + coeffs[c, : len(basis)] @ basis)) < 1e-6


def test_scene_of_one_file_is_dealt_out(spark):
    """The table lies in one file; its gaussians are written by several tasks, each of them once."""
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = catalog.build(spark, SF, "gauss").select("gid", F.input_file_name().alias("file")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert sorted(r["gid"] for r in got) == list(range(500)) and len({r["file"] for r in got}) == 8


def dealt(spark):
    """Rows that all stages so far have written to shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    none = gateway.new_array(gateway.jvm.double, 0)
    found = store.stageList(None, False, False, none, gateway.jvm.java.util.ArrayList())
    return sum(found.apply(k).shuffleWriteRecords() for k in range(found.size()))


def test_compositing_deals_splats_not_pixels(spark, duck):
    """All contributions of the stage's SQL, with fewer rows dealt out than a quarter of the supported pixels."""
    made: dict = {}
    catalog.build(spark, SF, "splats", made)
    before = dealt(spark)
    got = catalog.build(spark, SF, "comp", made).toPandas()
    moved = dealt(spark) - before
    assert 0 < moved < duck.execute(f"SELECT count(*) FROM ({catalog.sql('pix')}) p").fetchall()[0][0] / 4
    want = duck.execute(catalog.sql("comp")).df()
    got, want = (df.sort_values(["cam", "px", "py", "gid"]) for df in (got, want))
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    for c in want.columns:
        assert np.abs(got[c].to_numpy() - want[c].to_numpy()).max() < 1e-9, c


@pytest.mark.parametrize("name", ["all_levels", "t07_all_coresets", *(f"{level}_{norm}{v}" for level, _ in LEVELS for norm in ("l1", "l2") for v in ("", "_nocolour", "_white"))])
def test_levels_are_built_without_all_pixels(name):
    """Of what Spark builds for a level, nothing makes the pixels of all splats before they are composited."""
    todo, seen = [name], set()
    while todo:
        seen.add(x := todo.pop())
        if x in catalog.STAGES:
            todo += catalog.STAGES[x].needs or catalog.reads(x)
    assert {"splats", "comp"} <= seen and "pix" not in seen


def test_compositing_of_a_tile_across_batches(spark):
    """Opaque and faint splats, equal depths, boxes over part of a tile and a missing colour against plain loops."""
    rng = np.random.default_rng(11)
    made = []
    for gid in range(700):
        x0, y0 = rng.integers(0, 24, 2).tolist()
        alpha = float(rng.choice([0.003, 0.2, 0.7, 1.0]))
        made.append((gid, gid % 2, 0, float(rng.integers(1, 60)), None if gid == 5 else gid / 7, x0 + 4.3, y0 + 3.6, 0.3, 0.05, 0.2, alpha, math.log(1 / 255) - math.log(alpha), x0, min(31, x0 + 8), y0, min(31, y0 + 8)))
    names = ["gid", "cam", "batch", "cz", "c0", "u", "v", "ia", "ib", "ic", "alpha", "faint", "l", "r", "t", "b"]
    left, want = {}, {}
    for s in sorted((dict(zip(names, m, strict=True)) for m in made), key=lambda s: (s["cam"], s["cz"], s["gid"])):
        for px in range(s["l"], s["r"] + 1):
            for py in range(s["t"], s["b"] + 1):
                dx, dy = px - s["u"], py - s["v"]
                conic = s["ia"] * dx * dx + 2 * s["ib"] * dx * dy + s["ic"] * dy * dy
                t = left.get((s["cam"], px, py), 1.0)
                if conic <= 9 and -conic / 2 >= s["faint"]:
                    a = min(0.99, s["alpha"] * math.exp(-conic / 2))
                    left[s["cam"], px, py] = t * (1 - a)
                    if t >= 1e-4:
                        want[s["gid"], px, py] = (a, t, a * t, s["c0"])
    kinds = "gid long, cam int, batch int, cz double, c0 double, u double, v double, ia double, ib double, ic double, alpha double, faint double, l int, r int, t int, b int"
    splats = spark.createDataFrame(made, kinds).selectExpr("*", "c0 AS c1", "c0 AS c2", "explode(sequence(l div 16, r div 16)) AS tx").selectExpr("*", "explode(sequence(t div 16, b div 16)) AS ty")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("7", kept):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = {(r["gid"], r["px"], r["py"]): (r["a"], r["t"], r["w"], r["c0"]) for r in compositing.composite(splats, 16, 1e-4).collect()}
        assert got.keys() == want.keys() and len(want) > 5000 and min(left.values()) < 1e-5
        assert all(x[3] == y[3] and max(abs(a - b) for a, b in zip(x[:3], y[:3], strict=True)) < 1e-12 for x, y in ((got[k], want[k]) for k in want))
    assert compositing.composite(splats.limit(0), 16, 1e-4).count() == 0


def test_ranges_give_the_places_of_a_sort(spark):
    values = [(k, (k * 7919) % 101 / 101) for k in range(300)]
    df = spark.createDataFrame(values, "id long, p double").repartition(5)
    got = ranking.numbered(df, ["p DESC", "id"], "rk", "p").collect()
    at = 0.0
    for k, (i, p) in enumerate(sorted(values, key=lambda x: (-x[1], x[0])), 1):
        row = next(r for r in got if r["id"] == i)
        assert row["rk"] == k and abs(row["lo"] - at) < 1e-9 and abs(row["hi"] - at - p) < 1e-9
        at += p
    assert ranking.numbered(df.limit(0), ["p"], "rk").count() == 0


def test_camera_dialects(spark, tmp_path):
    pose = {"R": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "T": [1, 2, 3]}
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text(json.dumps({"w": 64, "h": 48, "frames": [{"FoVx": 60, "FoVy": 60, **pose}, {"K": [[50, 0, 32], [0, 50, 24], [0, 0, 1]], **pose}]}))
    b.write_text(json.dumps([{"width": 10, "height": 10, "fx": 5, "fy": 5, "quaternion": [0, 0, 0, 1], "position": [1, 1, 1]}]))
    got = cameras.load_cameras(spark, [str(a), str(b)]).orderBy("cam_ord").collect()
    assert len(got) == 3 and abs(got[0]["fx"] - 32 / math.tan(math.radians(30))) < 1e-9 and got[1]["fx"] == 50
    assert [got[0][c] for c in ("cx", "cy", "cz")] == [-1, -2, -3] and got[2]["w2c"][3] == -1


def test_ply_rejects_other_files(tmp_path):
    (tmp_path / "x.ply").write_bytes(b"plyx\n")
    with pytest.raises(ValueError):
        ply.header(str(tmp_path / "x.ply"))


def test_voxels(spark):
    shell = [(x, y, z) for x in range(1, 6) for y in range(1, 6) for z in range(1, 6) if 1 in (x, y, z) or 5 in (x, y, z)]
    got = voxels.outside_interior(spark.createDataFrame(shell, "ix int, iy int, iz int"), 7)
    assert got.where("interior").count() == 27
    dist = voxels.distances(got.where("interior"), got.where("interior AND ix = 2"))
    assert dist.agg({"dist": "max"}).first()[0] == 2
    assert voxels.gradient(dist).where("ix = 3").agg({"gx": "min"}).first()[0] == 1.0


def test_selection(spark):
    rng = np.random.default_rng(4)
    xyz = rng.random((300, 3)).round(3)
    xyz[50] = xyz[51]
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(xyz.tolist())], "id long, x double, y double, z double").repartition(4)
    order, left = [0], ((xyz - xyz[0]) ** 2).sum(1)
    while len(order) < 40:
        order.append(int(left.argmax()))
        left = np.minimum(left, ((xyz - xyz[order[-1]]) ** 2).sum(1))
    for candidates in (5, 4096):
        assert [r["id"] for r in selection.farthest_points(points, 40, candidates).orderBy("rank").collect()] == order
    kept = []
    for k in range(300):
        if all(((xyz[j] - xyz[k]) ** 2).sum() >= 0.2**2 for j in kept):
            kept.append(k)
    assert sorted(r["id"] for r in selection.poisson_discs(points, 0.2, F.col("id")).collect()) == kept
    empty = points.limit(0)
    assert selection.farthest_points(empty, 3).count() == 0 and selection.poisson_discs(empty, 1.0).count() == 0


def test_greedy_cover(spark):
    masks = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 3), (2, 4), (3, 1), (3, 2)], "cand long, item long")
    weights = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0), (4, 0.5)], "item long, w double")
    assert [(r["cand"], r["gain"]) for r in selection.greedy_cover(masks, weights, 5).orderBy("round").collect()] == [(1, 3.0), (2, 0.5)]
    poses = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0, 0, 0), (2, 9.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1, 1, 1), (3, 0.0, 0.1, 0.0, 1.0, 0.0, 0.0, 0, 0, 0)], "cand long, ex double, ey double, ez double, fx double, fy double, fz double, target long, dir_bin long, dist_bin long")
    got = selection.greedy_cover(masks, weights, 3, poses, 0.5).orderBy("round").collect()
    # The last one is near (0.8), looks the same way (1) and sees 2 of 3 items in common, above the bound by 2/3 - 0.6.
    want = [3.0 + 1.5, 0.5 + 1.5, -0.7 * (0.8 + 1 + 2 / 3 - 0.6) + 0.8 / 2 + 0.45 / 2 + 0.25 / 2]
    assert [r["cand"] for r in got] == [1, 2, 3] and all(abs(r["score"] - w) < 1e-5 for r, w in zip(got, want))


def test_classifier_equals_plain_arrays(spark, duck, gaussians):
    scenes = np.array([r[0] for r in duck.execute("SELECT label FROM embeddings ORDER BY vec_id").fetchall()])
    both = {("default", r["scene"]): (r["label"], r["p_outdoor"]) for r in catalog.build(spark, SF, "p43_scene_classifier").collect()}
    both |= {(preset, scene): (label, p) for preset, scene, label, p, _ in duck.execute(queries.ORACLES["f15_presets"]).fetchall()}
    assert len(both) == 90
    for (name, scene), (label, p) in both.items():
        thresholds = classify.parameters() if name == "default" else classify.parameters("wide", io_fallback="force", io_uncertain_band=0.02) if name == "given" else classify.parameters(name)
        m = scenes == scene
        want = dense.classify(gaussians["xyz"][m], gaussians["dc"][m], gaussians["alpha"][m], thresholds)
        assert want[0] == label and abs(want[1] - p) < 1e-6


def test_presets_give_way_to_what_is_given():
    assert classify.parameters("tight", open_bins=7)["open_bins"] == 7 and classify.parameters("tight", open_bins=None)["open_bins"] == 240 and classify.parameters()["open_bins"] == 200
    with pytest.raises(ValueError):
        classify.parameters(no_such=1)


def test_metrics_csv_rounds_once(spark, tmp_path):
    """Values that 8 digits would lift to a tie of 6; a tiny one is written with an exponent."""
    values = [("A", 1, 53644.2674996, 0.0522330098, 0.0421874996), ("A", 2, 1234.5675004, 0.0522330092, 0.0000004996), ("R", 1, 0.0004996, 1.0, 0.0)]
    made = [v for v in values for _ in range(2)]  # two rows of a group keep all three cells
    spark.createDataFrame(made, "l_returnflag string, l_suppkey long, l_extendedprice double, l_discount double, l_tax double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in queries.QUERIES["s12_metrics_csv"](spark, str(tmp_path)).collect())
    assert got == [("A_1.png", 53.644267, 0.473883, 0.042187), ("A_2.png", 1.234568, 0.473883, 0.0), ("R_1.png", 0.0, 0.0, 0.0)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(con.execute(queries.ORACLES["s12_metrics_csv"]).fetchall())


def test_text_and_foreign_point_clouds(spark, tmp_path):
    spark.dataSource.register(ply.PlyDataSource)
    names = [*ply.COLUMNS[:4], "f_dc_0", "f_dc_1", "f_dc_2", "f_rest_0", "f_rest_1", "f_rest_2", *ply.COLUMNS[7:]]
    values = [[k + j / 8 for j in range(len(names))] for k in range(3)]
    head = "".join(f"property float {n}\n" for n in names)
    (tmp_path / "t.ply").write_text(f"ply\nformat ascii 1.0\nelement vertex 3\n{head}end_header\n" + "".join(" ".join(map(str, v)) + "\n" for v in values))
    got = spark.read.format("ply").option("path", str(tmp_path / "t.ply")).load().orderBy("gaussian_id").collect()
    assert [r["x"] for r in got] == [0, 1, 2] and got[1]["f_rest"][0] == values[1][7] and got[1]["f_rest"][15] == values[1][8] and got[1]["f_rest"][30] == values[1][9]
    out = f"file://{tmp_path}/model"
    frame = spark.createDataFrame([r.asDict() for r in got], schema=ply.SCHEMA).coalesce(1)
    frame.write.format("ply").mode("append").save(out)
    with pytest.raises(Exception):
        frame.write.format("ply").mode("append").save(out)
    frame.write.format("ply").mode("overwrite").save(out)
    again = spark.read.format("ply").option("path", f"{out}/part-00000.ply").load().orderBy("gaussian_id").collect()
    assert [r["opacity"] for r in again] == [r["opacity"] for r in got] and again[2]["f_rest"] == got[2]["f_rest"]
