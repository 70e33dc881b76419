"""Scene statistics, classification, voxels, visibility and camera geometry."""

from __future__ import annotations

from .catalog import query, stage

stage("pts", "SELECT vec_id AS gid, label AS scene, 8 * E<0> AS x, 8 * E<1> AS y, 8 * E<2> AS z, 1 / (1 + exp(-16 * E<51>)) AS alpha, 4 * E<3> AS r, 4 * E<4> AS g, 4 * E<5> AS b, exp(-2.5e0 + 4 * E<52>) AS s0 FROM {embeddings}", cut=True)
query("a18_lower_median", "SELECT scene, round(percentile_disc(0.5) WITHIN GROUP (ORDER BY s0), 9) AS s_med, round(percentile_disc(0.5) WITHIN GROUP (ORDER BY x), 8) AS x_med FROM {pts} GROUP BY scene")
query("f04_opacity_filter", "SELECT scene, count(*) AS n FROM {pts} WHERE alpha >= 0.3e0 GROUP BY scene")
query("a22_confusion", "SELECT count_if(quality = 1 AND toxic = 1) AS tp, count_if(quality = 1 AND toxic = 0) AS fn, count_if(quality = 0 AND toxic = 1) AS fp, count_if(quality = 0 AND toxic = 0) AS tn, round(avg(CAST(quality = toxic AS INT)), 8) AS accuracy, count_if(quality IS NULL) AS skipped FROM {labels}")
# Voxels of the whole scene on a 24^3 grid over its robust box.
stage("box", ("SELECT " + ", ".join(f"PCT({c}, 0.01) AS lo{c}, PCT({c}, 0.99) AS hi{c}" for c in "xyz") + ", PCT(s0, 0.5) AS s_med FROM {pts}"), cut=True)
stage("vox", "SELECT gid, scene, alpha, " + ", ".join(f"CAST(least(23e0, greatest(0e0, RINT<({c} - lo{c}) / (hi{c} - lo{c}) * 23>)) AS INT) AS i{c}" for c in "xyz") + " FROM {pts} CROSS JOIN {box}", cut=True)
query("p22_world_to_voxel", "SELECT gid, ix, iy, iz FROM {vox}")
query("p23_voxel_to_world", "SELECT gid, round(lox + ix / 23e0 * (hix - lox), 8) AS x, round(loy + iy / 23e0 * (hiy - loy), 8) AS y, round(loz + iz / 23e0 * (hiz - loz), 8) AS z FROM {vox} CROSS JOIN {box}")
query("p24_voxel_size", "SELECT round((hix - lox) / 23, 9) AS vx, round((hiy - loy) / 23, 9) AS vy, round((hiz - loz) / 23, 9) AS vz FROM {box}")
query("p25_index_clamp", "SELECT count_if(ix = 0 OR ix = 23) AS edge_x, count_if(iy = 0 OR iy = 23) AS edge_y, count_if(iz = 0 OR iz = 23) AS edge_z FROM {vox}")
query("p26_grid_size", "SELECT scene, CAST(least(256e0, greatest(48e0, RINT<64 + 8 * log10(greatest(n, 10))>)) AS BIGINT) AS grid FROM (SELECT scene, count(*) AS n FROM {pts} GROUP BY scene) z")
query("p27_percentile_pair", "SELECT scene, least(least(a, b), 1e0) AS lo, greatest(greatest(a, b), 0e0) AS hi FROM (SELECT scene, 0.99e0 - scene / 20e0 AS a, 0.01e0 + scene / 20e0 AS b FROM (SELECT DISTINCT scene FROM {pts}) s) z")
stage("occ", "SELECT DISTINCT ix, iy, iz FROM {vox}", cut=True)
query("i01_occupancy", "SELECT ix, iy, iz FROM {occ}")
stage("dil", "SELECT DISTINCT ix + dx AS ix, iy + dy AS iy, iz + dz AS iz FROM {occ} o, SERIES<-1;1> AS a(dx), SERIES<-1;1> AS b(dy), SERIES<-1;1> AS c(dz) WHERE ix + dx BETWEEN 0 AND 23 AND iy + dy BETWEEN 0 AND 23 AND iz + dz BETWEEN 0 AND 23", cut=True)
query("i02_dilation", "SELECT ix, iy, iz FROM {dil}")
query("j15_neighbours", "SELECT d.ix, d.iy, d.iz, count(*) AS n FROM {dil} d JOIN (SELECT ix + dx AS ix, iy, iz FROM {dil} a, SERIES<-1;1> AS t(dx) WHERE dx <> 0 UNION ALL SELECT ix, iy + dx, iz FROM {dil} a, SERIES<-1;1> AS t(dx) WHERE dx <> 0 UNION ALL SELECT ix, iy, iz + dx FROM {dil} a, SERIES<-1;1> AS t(dx) WHERE dx <> 0) m ON d.ix = m.ix AND d.iy = m.iy AND d.iz = m.iz GROUP BY d.ix, d.iy, d.iz")
query("a33_mask_aabb", "SELECT min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1, min(iz) AS z0, max(iz) AS z1 FROM {dil}")
query("a34_projections", "SELECT 'xy' AS plane, ix AS a, iy AS b FROM {occ} GROUP BY ix, iy UNION ALL SELECT 'xz', ix, iz FROM {occ} GROUP BY ix, iz UNION ALL SELECT 'yz', iy, iz FROM {occ} GROUP BY iy, iz")
query("f17_roi_size", "SELECT scene, count(*) AS n FROM {vox} GROUP BY scene HAVING count(*) >= greatest(20, floor(24 * 24 * 24 / 20000))")
query("a32_axis_histogram", "SELECT axis, CAST(least(255e0, greatest(0e0, floor((v - lo) / (hi - lo) * 256))) AS INT) AS bin, count(*) AS n FROM (SELECT 'x' AS axis, x AS v, lox AS lo, hix AS hi FROM {pts} CROSS JOIN {box} UNION ALL SELECT 'y', y, loy, hiy FROM {pts} CROSS JOIN {box} UNION ALL SELECT 'z', z, loz, hiz FROM {pts} CROSS JOIN {box}) u GROUP BY axis, CAST(least(255e0, greatest(0e0, floor((v - lo) / (hi - lo) * 256))) AS INT)")
# Eight directions over the sphere.
stage("dirs", "SELECT k, sqrt(1 - z * z) * cos(t) AS dx, sqrt(1 - z * z) * sin(t) AS dy, z AS dz FROM (SELECT k, 1 - 2 * (k + 0.5e0) / 8e0 AS z, pi() * (1 + sqrt(5e0)) * (k + 0.5e0) AS t FROM (SELECT 1 AS one) o, SERIES<0;7> AS s(k)) q")
stage("supports", "SELECT scene, k, dx, dy, dz, min(x * dx + y * dy + z * dz) AS bmin, max(x * dx + y * dy + z * dz) AS bmax FROM {pts} CROSS JOIN {dirs} GROUP BY scene, k, dx, dy, dz", cut=True)
stage("extent", "SELECT scene, " + ", ".join(f"min({c}) AS lo{c}, max({c}) AS hi{c}" for c in "xyz") + " FROM {pts} GROUP BY scene", cut=True)
query("a35_kdop_supports", "SELECT scene, k, round(bmin, 8) AS bmin, round(bmax, 8) AS bmax FROM {supports}")
# Points against the polytope of the scene before theirs, and against its box, which stands in where there is no hull.
query("f08_point_in_kdop", "SELECT gid, bool_and(x * dx + y * dy + z * dz BETWEEN bmin - 1e-9 AND bmax + 1e-9) AS inside, bool_and(x BETWEEN lox AND hix AND y BETWEEN loy AND hiy AND z BETWEEN loz AND hiz) AS in_box FROM {pts} p JOIN {supports} s ON s.scene = p.scene - 1 JOIN {extent} e ON e.scene = p.scene - 1 GROUP BY gid")
# The ray from a scene's centre to each of its points, clipped by the slabs of its polytope.
query("i08_kdop_ray_clip", "SELECT gid, round(max(CASE WHEN dd > 0 THEN (bmin - oo) / dd ELSE (bmax - oo) / dd END), 6) AS t_in, round(min(CASE WHEN dd > 0 THEN (bmax - oo) / dd ELSE (bmin - oo) / dd END), 6) AS t_out FROM (SELECT gid, (x - tx) * dx + (y - ty) * dy + (z - tz) * dz AS dd, tx * dx + ty * dy + tz * dz AS oo, bmin, bmax FROM {pts} p JOIN {supports} s ON s.scene = p.scene JOIN {centre} c ON c.target = p.scene) q WHERE abs(dd) > 1e-6 GROUP BY gid")
stage("centre", "SELECT scene AS target, avg(x) AS tx, avg(y) AS ty, avg(z) AS tz FROM {pts} GROUP BY scene", cut=True)
stage("near", "SELECT gid, alpha, target, d2 FROM (SELECT gid, alpha, target, d2, row_number() OVER (PARTITION BY gid ORDER BY d2, target) AS r FROM (SELECT gid, alpha, target, (x - tx) * (x - tx) + (y - ty) * (y - ty) + (z - tz) * (z - tz) AS d2 FROM {pts} CROSS JOIN {centre}) q) w WHERE r = 1", cut=True)
query("j10_nearest_target", "SELECT gid, target, round(d2, 7) AS d2 FROM {near}")
query("a36_opacity_mass", "SELECT target, round(sum(alpha), 6) AS mass FROM {near} GROUP BY target")
stage("look", "SELECT n_nationkey AS eye, 4 * sqrt(1 - z * z) * cos(t) AS ex, 4 * sqrt(1 - z * z) * sin(t) AS ey, 4 * z AS ez FROM (SELECT n_nationkey, 1 - 2 * (n_nationkey + 0.5e0) / 25e0 AS z, pi() * (1 + sqrt(5e0)) * (n_nationkey + 0.5e0) AS t FROM {nation}) s")
stage("vis", "SELECT eye, gid, alpha FROM (SELECT eye, gid, alpha, -(ex * (x - ex) + ey * (y - ey) + ez * (z - ez)) / 4 AS along, sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey) + (z - ez) * (z - ez)) AS d FROM {pts} CROSS JOIN {look}) q WHERE along / greatest(d, 1e-9) >= cos(pi() / 6 + pi() / 30) AND d BETWEEN 0.06e0 AND 30.4e0", cut=True)
query("f10_fov_visibility", "SELECT eye, count(*) AS hits FROM {vis} GROUP BY eye HAVING count(*) >= 60")
# Least distance of each eye to all points: eyes are few, minima aggregate partially.
query("j11_min_distance", "SELECT eye, round(sqrt(min((x - ex) * (x - ex) + (y - ey) * (y - ey) + (z - ez) * (z - ez))), 7) AS d FROM {pts} CROSS JOIN {look} GROUP BY eye")
query("j13_eye_target_sample", "SELECT v.eye, n.target, count(*) AS n FROM {vis} v JOIN {near} n ON v.gid = n.gid GROUP BY v.eye, n.target")
query("j14_pairwise_jaccard", "SELECT a.eye AS eye_a, b.eye AS eye_b, round(count(*) * 1e0 / (max(x.n) + max(y.n) - count(*)), 8) AS jaccard FROM {vis} a JOIN {vis} b ON a.gid = b.gid AND a.eye < b.eye JOIN {u03_sizes} x ON a.eye = x.eye JOIN {u03_sizes} y ON b.eye = y.eye GROUP BY a.eye, b.eye")
stage("u03_sizes", "SELECT eye, count(*) AS n FROM {vis} GROUP BY eye")
stage("shared_sights", "SELECT a.eye AS eye_a, b.eye AS eye_b, count(*) AS n FROM {vis} a JOIN {vis} b ON a.gid = b.gid AND a.eye < b.eye GROUP BY a.eye, b.eye")
query("u02_mask_union_intersection", "SELECT x.eye AS eye_a, y.eye AS eye_b, x.n + y.n - coalesce(s.n, 0) AS n_union, coalesce(s.n, 0) AS n_both FROM {u03_sizes} x JOIN {u03_sizes} y ON x.eye < y.eye LEFT JOIN {shared_sights} s ON s.eye_a = x.eye AND s.eye_b = y.eye")
query("u03_jaccard", "SELECT eye_a, max(jaccard) AS best FROM {j14_pairwise_jaccard} GROUP BY eye_a")
query("u04_unused_targets", "SELECT target FROM {centre} c WHERE NOT EXISTS (SELECT 1 FROM {near} n WHERE n.target = c.target AND n.alpha > 0.95e0)")
query("u06_unique_rows", "SELECT DISTINCT ix, iy FROM {vox}")
query("j16_first_roi", "SELECT v.gid, coalesce(min(r.scene), 0) AS roi FROM {vox} v LEFT JOIN {f17_roi_size} r ON v.scene = r.scene GROUP BY v.gid")
query("i07_eye_backoff", "SELECT gid, min(k) AS k FROM {pts} p CROSS JOIN {box} b, SERIES<0;15> AS s(k) WHERE abs(x) * pow(0.85e0, k) <= hix AND abs(y) * pow(0.85e0, k) <= hiy AND abs(z) * pow(0.85e0, k) <= hiz GROUP BY gid")
query("p14_fov_focal", "SELECT c_custkey, round(32 / tan(a / 2), 8) AS focal, round(2 * atan(32 / greatest(32 / tan(a / 2), 1e-8)), 8) AS fov FROM (SELECT c_custkey, radians(20 + c_custkey % 101) AS a FROM {customer}) c")
query("p18_vector_algebra", "SELECT gid, round(x / greatest(sqrt(x * x + y * y + z * z), 1e-12), 8) AS nx, round(x * r + y * g + z * b, 7) AS dot, round(y * b - z * g, 7) AS cx, round(z * r - x * b, 7) AS cy, round(x * g - y * r, 7) AS cz FROM {pts}")
query("p41_near_far", "SELECT eye, round(greatest(0.01e0, 0.01e0 * sqrt(ex * ex + ey * ey + ez * ez)), 8) AS near_, round(8 * greatest(1e0, sqrt(ex * ex + ey * ey + ez * ez)), 8) AS far_ FROM {look}")
# The inward threshold, and how far from the boundary it begins and ends to fade, in voxels.
query("p42_linear_fade", "SELECT gid, round(CASE WHEN d <= 3 * v THEN 0.25e0 WHEN d >= 9 * v THEN 0e0 ELSE 0.25e0 * greatest(0e0, least(1e0, 1 - (d - 3 * v) / greatest(6 * v, 1e-9))) END, 8) AS threshold FROM (SELECT gid, least(least(least(x - lox, hix - x), least(y - loy, hiy - y)), least(z - loz, hiz - z)) AS d, ((hix - lox) + (hiy - loy) + (hiz - loz)) / 3 / 23 AS v FROM {pts} CROSS JOIN {box}) q")
query("p45_clearance", "SELECT round(sqrt((hix - lox) * (hix - lox) + (hiy - loy) * (hiy - loy) + (hiz - loz) * (hiz - loz)), 7) AS diag, round(greatest(0.01e0 * sqrt((hix - lox) * (hix - lox) + (hiy - loy) * (hiy - loy) + (hiz - loz) * (hiz - loz)), 3 * s_med), 8) AS clearance FROM {box}")
query("p48_directions_per_eye", "SELECT eye, CAST(least(8e0, greatest(3e0, RINT<3 + 5 * pow(n / 2000e0, 1.2e0)>)) AS BIGINT) AS k FROM {u03_sizes}")
query("p49_direction_distance_bins", "SELECT gid, k AS dir_bin, CASE WHEN rel <= 0.06e0 THEN 0 WHEN rel <= 0.12e0 THEN 1 WHEN rel <= 0.25e0 THEN 2 ELSE 3 END AS dist_bin FROM (SELECT gid, k, sqrt(x * x + y * y + z * z) / 10 AS rel, row_number() OVER (PARTITION BY gid ORDER BY x * dx + y * dy + z * dz DESC, k) AS r FROM {pts} CROSS JOIN {dirs}) q WHERE r = 1")
query("a38_bin_coverage", "SELECT count(DISTINCT dir_bin) AS dirs, count(DISTINCT dist_bin) AS dists, round(pow(count(DISTINCT dir_bin) / 8e0 * count(DISTINCT dist_bin) / 4e0, 1 / 3e0), 8) AS composite FROM {p49_direction_distance_bins}")
query("a39_capacity", "SELECT round(1.414e0 * (hix - lox) * (hiy - loy) * (hiz - loz) / pow(greatest(2 * s_med, 1e-6), 3), 3) AS capacity FROM {box}")
query("a46_solid_angle", "SELECT gid, round(avg(CAST(x * dx + y * dy + z * dz >= 0.3e0 AS INT)), 8) AS free FROM {pts} CROSS JOIN {dirs} GROUP BY gid")
query("a47_volume_weights", "SELECT scene, round(greatest(n / (sum(n) OVER () + 0.1e0 * 13824), 1e-9), 9) AS w FROM (SELECT scene, count(DISTINCT ix * 576 + iy * 24 + iz) AS n FROM {vox} GROUP BY scene) q")
query("a48_rejection_counters", "SELECT count_if(alpha < 0.3e0) AS faint, count_if(x < lox OR x > hix) AS off_x, count_if(y < loy OR y > hiy) AS off_y, count_if(s0 > 0.2e0) AS large FROM {pts} CROSS JOIN {box}")
query("f16_inward_gate", "SELECT eye, count(*) AS n FROM {look} l CROSS JOIN {centre} c WHERE -(ex * (tx - ex) + ey * (ty - ey) + ez * (tz - ez)) > 0 GROUP BY eye".replace("-(ex", "-1 * (ex"))

stage("p25_eye_voxels", "SELECT eye, " + ", ".join(f"CAST(least(23e0, greatest(0e0, RINT<(e{c} * 0.5e0 - lo{c}) / (hi{c} - lo{c}) * 23>)) AS INT) AS i{c}" for c in "xyz") + " FROM {look} CROSS JOIN {box}")
# Corners, face centres and centre of the box, as numbers below 0 to 26.
stage("box_points", "SELECT -1 - (9 * a + 3 * b + c) AS id, " + ", ".join(f"lo{x} + (hi{x} - lo{x}) * {v} / 2e0 AS {x}" for x, v in zip("xyz", "abc")) + " FROM {box}, SERIES<0;2> AS p(a), SERIES<0;2> AS q(b), SERIES<0;2> AS r(c) WHERE (CASE WHEN a = 1 THEN 1 ELSE 0 END) + (CASE WHEN b = 1 THEN 1 ELSE 0 END) + (CASE WHEN c = 1 THEN 1 ELSE 0 END) IN (0, 2, 3)")
