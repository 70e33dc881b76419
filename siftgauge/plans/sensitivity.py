"""Generic sensitivities on any (item, group, contribution) table, coresets and sampling."""

from __future__ import annotations

from .catalog import numbered, query, stage

EPS = "1.1920929e-07"

stage("cell", "SELECT l_partkey AS item, l_orderkey AS px, l_suppkey AS img, sum(l_extendedprice) AS c FROM {lineitem} GROUP BY l_partkey, l_orderkey, l_suppkey", cut=True)
for _norm, _c in (("l1", "c"), ("l2", "c * c")):
    for _level, _key in (("pixel", "px"), ("image", "img")):
        stage(f"own_{_level}_{_norm}", f"SELECT item, {_key} AS k, {_c.replace('c', 'sum(c)')} AS n FROM {{cell}} GROUP BY item, {_key}")
        stage(f"all_{_level}_{_norm}", f"SELECT {_key} AS k, {_c.replace('c', 'sum(c)')} AS d FROM {{cell}} GROUP BY {_key}")
        query(f"a0{2 if _level == 'pixel' else 4}_{_level}_{_norm}", f"SELECT item, round(max(n / greatest(d, {EPS})), 9) AS sens_max, round(avg(n / greatest(d, {EPS})), 9) AS sens_mean FROM {{own_{_level}_{_norm}}} o JOIN {{all_{_level}_{_norm}}} a ON o.k = a.k GROUP BY item")
query("a05_per_batch", f"""SELECT item, round(max(n / greatest(d, {EPS})), 9) AS sens_max, round(sum(n / greatest(d, {EPS}) * k) / sum(k), 9) AS sens_mean FROM
  (SELECT item, floor(img / 5) AS b, sum(c) AS n, count(DISTINCT img) AS k FROM {{cell}} GROUP BY item, floor(img / 5)) o JOIN (SELECT floor(img / 5) AS b, sum(c) AS d FROM {{cell}} GROUP BY floor(img / 5)) a ON o.b = a.b GROUP BY item""")
query("a06_per_scene", f"SELECT item, round(sum(c) / greatest((SELECT sum(c) FROM {{cell}}), {EPS}), 12) AS sens FROM {{cell}} GROUP BY item")
stage("sens", "SELECT p.item, p.sens_max AS s_pixel, i.sens_max AS s_image, c.sens AS s_scene FROM {a02_pixel_l1} p JOIN {a04_image_l1} i ON p.item = i.item JOIN {a06_per_scene} c ON p.item = c.item", cut=True)
numbered("by_image", "sens", "s_image DESC, item")
query("t01_topk_coreset", "SELECT item, s_pixel, s_image, s_scene FROM {by_image} r CROSS JOIN {p40_coreset_size} k WHERE rk <= k.kept")
query("p40_coreset_size", "SELECT CAST(greatest(1, RINT<(1 - 0.9) * count(*)>) AS BIGINT) AS kept FROM {sens}")
query("a07_cross_batch_reduce", f"""SELECT item, round(least(1e0, greatest(0e0, max(m))), 9) AS sens_max, round(least(1e0, greatest(0e0, sum(s) / greatest(sum(k), 1))), 9) AS sens_mean FROM
  (SELECT item, part, max(r) AS m, sum(r) AS s, count(*) AS k FROM (SELECT o.item, o.k % 4 AS part, n / greatest(d, {EPS}) AS r FROM {{own_pixel_l1}} o JOIN {{all_pixel_l1}} a ON o.k = a.k) x GROUP BY item, part) y GROUP BY item""")
query("a14_probability", "SELECT item, round(CASE WHEN t > 0 THEN s / t ELSE 1e0 / n END, 12) AS p FROM {p29_sanitised} q CROSS JOIN (SELECT sum(s) AS t, count(*) AS n FROM {p29_sanitised}) z")
query("p29_sanitised", "SELECT item, CASE WHEN isnan(s_image) OR abs(s_image) > 1e300 THEN 0e0 ELSE greatest(s_image, 0e0) END AS s FROM {sens}")
query("p28_temperature", "SELECT item, round(pow(s, 1e0 / 2e0), 9) AS s FROM {p29_sanitised}")
stage("prob", "SELECT item, s / t AS p FROM {p29_sanitised} q CROSS JOIN (SELECT sum(s) AS t FROM {p29_sanitised}) z", cut=True)
_U = "((((({id} * 1103515245 + 12345 + 7 * 7919) % 2147483648) * 1103515245 + 12345) % 2147483648) + 0.5e0) / 2147483648e0"
stage("u_item", f"SELECT item, p, {_U.replace('{id}', 'item')} AS u FROM {{prob}}")
stage("raced", "SELECT item, -ln(u) / p AS arrival FROM {u_item} WHERE p > 0")
numbered("arrivals", "raced", "arrival, item")
query("t02_sample_without_replacement", "SELECT item FROM {arrivals} WHERE rk <= 200")
numbered("bounds", "prob", "item", value="p")
stage("draws", f"SELECT j, {_U.replace('{id}', 'CAST(j AS BIGINT)')} AS u FROM (SELECT 1 AS one) o, SERIES<0;499> AS s(j)")
# Draws meet the interval they fall into by equal cells: as many cells as items, and each interval in those it overlaps.
stage("intervals", "SELECT b.item, b.lo, b.hi, cell FROM (SELECT item, lo, hi, CAST(floor(greatest(lo, 0e0) * n) AS INT) AS first, CAST(greatest(floor(greatest(lo, 0e0) * n), floor(hi * n)) AS INT) AS last FROM {bounds} CROSS JOIN (SELECT count(*) AS n FROM {prob}) c) b, SERIES<first;last> AS s(cell)")
stage("drawn", "SELECT j, item FROM (SELECT j, u, CAST(floor(u * n) AS INT) AS cell FROM {draws} CROSS JOIN (SELECT count(*) AS n FROM {prob}) c) d JOIN {intervals} i ON d.cell = i.cell AND d.u >= i.lo AND d.u < i.hi")
query("t03_sample_with_replacement", "SELECT item, count(*) AS draws FROM {drawn} GROUP BY item")
query("a13_unique_counts", "SELECT draws, count(*) AS items FROM {t03_sample_with_replacement} GROUP BY draws")
stage("weighted", "SELECT t.item, t.draws, p, t.draws / greatest(500 * p, 1e-12) AS w FROM {t03_sample_with_replacement} t JOIN {prob} p ON t.item = p.item")
query("a15_importance_weights", "SELECT item, round(w, 6) AS w FROM {weighted}")
query("a16_weight_clamp", "SELECT item, round(least(least(w, q), 4 * m), 6) AS w FROM {weighted} CROSS JOIN (SELECT PCT(w, 0.999) AS q, avg(w / t) AS m FROM {weighted} CROSS JOIN (SELECT sum(w * p) AS t FROM {weighted}) z) c")
query("t05_duplicates_coreset", "SELECT j, item FROM {drawn}")
query("t06_uniform_baseline", "SELECT item, 1e0 / n AS p FROM {sens} CROSS JOIN (SELECT count(*) AS n FROM {sens}) c")
query("t08_size_sweep", "SELECT size, count(*) AS kept, round(sum(s_image), 6) AS mass FROM {by_image} r CROSS JOIN (SELECT 100 * j AS size FROM (SELECT 1 AS one) o, SERIES<1;10> AS s(j)) z WHERE rk <= size GROUP BY size")
numbered("by_chance", "u_item", "u, item")
query("t09_random_subsample", "SELECT item FROM {by_chance} WHERE rk <= 120")
query("j05_sensitivity_by_id", "SELECT p.item, s_image, p.p FROM {prob} p JOIN {sens} s ON p.item = s.item".replace("p.p FROM", "round(p.p, 12) AS p FROM"))
query("j06_weighted_mix", "SELECT item, round(sum(w * s), 9) AS s FROM (SELECT item, 0.5e0 AS w, s_pixel AS s FROM {sens} UNION ALL SELECT item, 0.3e0, s_image FROM {sens} UNION ALL SELECT item, 0.2e0, s_scene FROM {sens}) u GROUP BY item")
query("f12_subset_by_id", "SELECT l_partkey, count(*) AS n FROM {lineitem} WHERE l_partkey IN (SELECT item FROM {t01_topk_coreset}) GROUP BY l_partkey")
numbered("by_mass", "prob", "p DESC, item", value="p")
query("a28_head_tail_mass", "SELECT round(sum(CASE WHEN rk <= 100 THEN p ELSE 0e0 END), 9) AS head, round(1 - sum(CASE WHEN rk <= 100 THEN p ELSE 0e0 END), 9) AS tail, count_if(rk > 100) AS tail_count FROM {by_mass}")
query("w12_cumulative_mass", "SELECT item, round(hi, 9) AS mass FROM {by_mass}")
# The first row whose mass reaches a grid point is the one whose interval holds it.
query("a29_mass_subsample", "SELECT j, round(hi, 9) AS mass FROM (SELECT hi, CAST(floor(greatest(lo, 0e0) * 20) + 1 AS INT) AS first, CAST(floor(hi * 20) AS INT) AS last FROM {by_mass} WHERE floor(hi * 20) > floor(greatest(lo, 0e0) * 20)) m, SERIES<first;last> AS s(j) WHERE j <= 19")
query("a30_tail_log_histogram", "SELECT CAST(floor(16 * log10(p)) AS BIGINT) AS bin, count(*) AS n FROM {prob} WHERE p > 0 GROUP BY floor(16 * log10(p))")
query("a31_draw_calibration", "SELECT p.item, coalesce(draws, 0) AS observed, round(500 * p, 6) AS expected, round(1.96e0 * sqrt(500 * p * (1 - p)), 6) AS band FROM {prob} p LEFT JOIN {t03_sample_with_replacement} t ON p.item = t.item")
query("a45_nonzero_finite", "SELECT count_if(s_image <> 0) AS nonzero, count_if(NOT isnan(s_image)) AS finite, count(*) AS n FROM {sens}")
