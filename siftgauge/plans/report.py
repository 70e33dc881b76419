"""Image quality, ranking reports, series and text functions."""

from __future__ import annotations

from .catalog import numbered, query, stage

# Two images of 24 x 24 pixels per supplier class from lineitem: prediction and truth.
stage("imgs", "SELECT i, y, x, least(1e0, greatest(0e0, 0.5e0 + 0.4e0 * sin(x / 3e0 + i) * cos(y / 4e0))) AS a, least(1e0, greatest(0e0, 0.5e0 + 0.38e0 * sin(x / 3e0 + i + 0.05e0) * cos(y / 4e0))) AS b FROM (SELECT n_nationkey AS i FROM {nation}) n, SERIES<0;23> AS sy(y), SERIES<0;23> AS sx(x)", cut=True)
query("a24_psnr", "SELECT i, round(10 * log10(1 / greatest(avg((a - b) * (a - b)), 1e-10)), 6) AS psnr FROM {imgs} GROUP BY i")
query("p44_border_crop", "SELECT i, count(*) AS n, round(10 * log10(1 / greatest(avg((a - b) * (a - b)), 1e-10)), 6) AS psnr FROM {imgs} WHERE x BETWEEN 2 AND 21 AND y BETWEEN 2 AND 21 GROUP BY i")
query("a27_masked_reduce", "SELECT i, round(sum((a - b) * (a - b) * m) / greatest(sum(m), 1e-8), 9) AS mse FROM (SELECT i, a, b, CAST((x + y) % 3 = 0 AS INT) AS m FROM {imgs}) q GROUP BY i")
query("p31_luma", "SELECT i, round(avg(0.299e0 * a + 0.587e0 * b + 0.114e0 * a), 8) AS bt601, round(avg(0.2126e0 * a + 0.7152e0 * b + 0.0722e0 * a), 8) AS bt709 FROM {imgs} GROUP BY i")
query("p32_to_unit", "SELECT event_id, round(least(1e0, greatest(0e0, (value - 50) / 255e0)), 8) AS u FROM {events}")
stage("kern", "SELECT d, w / sum(w) OVER () AS w FROM (SELECT d, exp(-d * d / (2 * 1.5e0 * 1.5e0)) AS w FROM (SELECT 1 AS one) o, SERIES<-5;5> AS s(d)) k", cut=True)
_M = ("a", "b", "a * a", "b * b", "a * b")
stage("blur_x", "SELECT i, y, x - 0 AS x, " + ", ".join(f"sum(w * {m}) AS m{k}" for k, m in enumerate(_M)) + " FROM (SELECT t.i, t.y, t.x, k.w, s.a, s.b FROM (SELECT i, y, x, d, CASE WHEN x + d < 0 THEN -(x + d) WHEN x + d > 23 THEN 46 - (x + d) ELSE x + d END AS q FROM (SELECT DISTINCT i, y, x FROM {imgs}) p CROSS JOIN {kern} kk) t JOIN {kern} k ON t.d = k.d JOIN {imgs} s ON s.i = t.i AND s.y = t.y AND s.x = t.q) z GROUP BY i, y, x", cut=True)
stage("blur", "SELECT i, y, x, " + ", ".join(f"sum(w * m{k}) AS m{k}" for k in range(5)) + " FROM (SELECT t.i, t.y, t.x, k.w, s.m0, s.m1, s.m2, s.m3, s.m4 FROM (SELECT i, y, x, d, CASE WHEN y + d < 0 THEN -(y + d) WHEN y + d > 23 THEN 46 - (y + d) ELSE y + d END AS q FROM (SELECT i, y, x FROM {blur_x}) p CROSS JOIN {kern} kk) t JOIN {kern} k ON t.d = k.d JOIN {blur_x} s ON s.i = t.i AND s.x = t.x AND s.y = t.q) z GROUP BY i, y, x", cut=True)
query("a25_ssim", "SELECT i, round(avg(s), 6) AS ssim, round((1 - avg(s)) / 2, 6) AS dssim FROM (SELECT i, (2 * m0 * m1 + 0.0001e0) * (2 * (m4 - m0 * m1) + 0.0009e0) / greatest((m0 * m0 + m1 * m1 + 0.0001e0) * (m2 - m0 * m0 + m3 - m1 * m1 + 0.0009e0), 1e-12) AS s FROM {blur}) q GROUP BY i")
# Metric rows: dataset = l_returnflag, granularity = supplier.
stage("metric", "SELECT l_returnflag AS dataset, CAST(l_suppkey AS STRING) AS granularity, avg(l_extendedprice) / 1000 AS psnr, avg(l_discount) AS ssim, avg(l_tax) AS lpips, count(*) AS n FROM {lineitem} GROUP BY l_returnflag, l_suppkey".replace("AS STRING", "AS VARCHAR(20)"), cut=True)
query("a23_averages", "SELECT dataset, round(avg(psnr), 7) AS psnr, round(avg(ssim), 8) AS ssim, count(lpips) AS n_lpips FROM {metric} GROUP BY dataset")
stage("group_means", "SELECT granularity, avg(psnr) AS psnr, round(avg(psnr), 9) AS by_psnr FROM {metric} GROUP BY granularity")
numbered("group_places", "group_means", "by_psnr DESC, granularity")
query("a40_group_averages", "SELECT granularity, round(psnr, 7) AS psnr, rk AS place FROM {group_places}")
stage("ranked", "SELECT dataset, granularity, psnr, ssim, lpips, row_number() OVER (PARTITION BY dataset ORDER BY round(psnr, 9) DESC, granularity) AS r_psnr, row_number() OVER (PARTITION BY dataset ORDER BY round(ssim, 9) DESC, granularity) AS r_ssim, row_number() OVER (PARTITION BY dataset ORDER BY round(lpips, 9), granularity) AS r_lpips FROM {metric}", cut=True)
query("w06_dataset_ranking", "SELECT dataset, granularity, r_psnr, r_ssim, r_lpips FROM {ranked}")
query("w07_composite_rank", "SELECT dataset, granularity, row_number() OVER (PARTITION BY dataset ORDER BY coalesce(r_psnr + r_ssim + r_lpips, 1000000000), r_psnr, r_ssim, r_lpips, granularity) AS place FROM {ranked}")
stage("variances", "SELECT granularity, round(var_pop(psnr), 6) AS v FROM {metric} GROUP BY granularity")
query("w08_variance_top8", "SELECT granularity, v FROM {variances} ORDER BY v, granularity LIMIT 8")
query("w09_variance_entries", "SELECT metric, value, row_number() OVER (ORDER BY metric, value) AS place FROM (SELECT 'psnr' AS metric, round(var_pop(psnr), 6) AS value FROM {metric} UNION ALL SELECT 'ssim', round(var_pop(ssim), 9) FROM {metric} UNION ALL SELECT 'lpips', round(var_pop(lpips), 9) FROM {metric}) q")
query("w10_series_order", "SELECT dataset, name, row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN name LIKE '%psnr' THEN 0 WHEN name LIKE '%ssim' THEN 1 WHEN name LIKE '%lpips' THEN 2 ELSE 3 END, CASE WHEN name LIKE 'avg%' THEN 0 WHEN name LIKE 'rank%' THEN 1 ELSE 2 END, name) AS place FROM (SELECT DISTINCT dataset, concat(CASE n % 3 WHEN 0 THEN 'avg_' WHEN 1 THEN 'rank_' ELSE '' END, CASE CAST(granularity AS INT) % 4 WHEN 0 THEN 'psnr' WHEN 1 THEN 'ssim' WHEN 2 THEN 'lpips' ELSE 'time' END) AS name FROM {metric}) q")
query("a41_win_counts", "SELECT granularity, count(*) AS wins FROM {ranked} WHERE r_psnr = 1 GROUP BY granularity")
query("a42_view_stats", "SELECT dataset, round(avg(psnr), 7) AS mean, round(median(psnr), 7) AS median, round(min(psnr), 7) AS low, round(max(psnr), 7) AS high, max(CASE WHEN r_psnr = 1 THEN granularity END) AS best, max(CASE WHEN w = 1 THEN granularity END) AS worst FROM (SELECT r.*, row_number() OVER (PARTITION BY dataset ORDER BY round(psnr, 9), granularity) AS w FROM {ranked} r) q GROUP BY dataset")
query("a43_numeric_columns", "SELECT count(try_cast(l_returnflag AS DOUBLE)) > 0 AS returnflag, count(try_cast(CAST(l_quantity AS VARCHAR(30)) AS DOUBLE)) > 0 AS quantity FROM {lineitem}")
query("f13_baseline_rows", "SELECT granularity, psnr > 30 AS high FROM (SELECT granularity, psnr FROM {metric} UNION ALL SELECT ' Baseline ', 31e0) q WHERE lower(trim(granularity)) = 'baseline'")
query("f14_exclude_missing", "SELECT dataset, count(*) AS n FROM {metric} WHERE psnr IS NOT NULL AND NOT isnan(psnr) GROUP BY dataset")
stage("losses", "SELECT ts, event_id, value FROM {events}")
numbered("loss", "losses", "ts, event_id", into="iteration")
# Blocks of iterations, each with the 19 before it, so that no window spans the table.
stage("stretch", "SELECT iteration, value, floor(iteration / 100000) AS block, 1 AS own FROM {loss} UNION ALL SELECT iteration, value, floor(iteration / 100000) + 1, 0 FROM {loss} WHERE iteration % 100000 >= 100000 - 19")
query("w04_moving_average", "SELECT iteration, round(m, 7) AS m FROM (SELECT iteration, own, avg(value) OVER (PARTITION BY block ORDER BY iteration ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m FROM {stretch}) q CROSS JOIN (SELECT count(*) AS n FROM {loss}) c WHERE own = 1 AND iteration >= greatest(1, least(20, n))")
query("w05_loss_extremes", "SELECT min(m) AS low, max(m) AS high FROM {w04_moving_average}")
query("p33_string_to_float", "SELECT c_custkey, try_cast(trim(s) AS DOUBLE) AS v FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN concat(' ', CAST(c_custkey AS VARCHAR(20)), '.5 ') WHEN 1 THEN c_name WHEN 2 THEN '' WHEN 3 THEN concat('-', CAST(c_custkey AS VARCHAR(20)), 'e3') END AS s FROM {customer}) q")
query("p34_path_leaf", r"SELECT url, regexp_extract(url, '([^/]*)$', 1) AS leaf FROM {pages}")
query("p35_stage_regex", r"SELECT name, regexp_extract(name, '_(pre|post)$', 1) AS stage, regexp_extract(name, 'metrics_per_model_variance_(min|max|mean)', 1) AS kind FROM (SELECT concat(CASE s_suppkey % 3 WHEN 0 THEN 'metrics_per_model_variance_min' WHEN 1 THEN 'metrics_per_model_variance_mean' ELSE 'metrics_per_scene' END, '_', CAST(s_suppkey AS VARCHAR(20)), CASE s_suppkey % 4 WHEN 0 THEN '_pre' WHEN 1 THEN '_post' ELSE '' END) AS name FROM {supplier}) q")
query("p36_labels", "SELECT dataset, granularity, concat_ws('·', dataset, granularity) AS label, CASE WHEN length(concat(dataset, ' supplier number ', granularity)) > 18 THEN concat(substring(concat(dataset, ' supplier number ', granularity), 1, 15), '…') ELSE concat(dataset, ' supplier number ', granularity) END AS tick FROM {metric}")
query("p37_view_index", r"SELECT n_name, try_cast(regexp_extract(n_name, '([0-9]+)', 1) AS BIGINT) AS idx FROM {nation}")
query("p38_prefix_strip", r"SELECT n_name, regexp_replace(n_name, '^NATION_', '') AS stem FROM {nation}")
# Predictions with the last truth of the same stem, and those of either side without a partner.
query("j07_pair_by_stem", "SELECT coalesce(p.stem, g.stem) AS stem, pred, truth, CASE WHEN pred IS NULL THEN 'truth only' WHEN truth IS NULL THEN 'prediction only' ELSE 'pair' END AS kind FROM (SELECT concat('v', CAST(c_custkey AS VARCHAR(20))) AS stem, max(c_custkey) AS pred FROM {customer} WHERE c_custkey % 3 <> 0 GROUP BY c_custkey) p FULL JOIN (SELECT concat('v', CAST(o_custkey AS VARCHAR(20))) AS stem, max(o_orderkey) AS truth FROM {orders} GROUP BY o_custkey) g ON p.stem = g.stem")
numbered("nations", "nation", "n_nationkey")
numbered("regions", "region", "r_regionkey")
query("j08_positional_pairs", "SELECT a.n_name, b.r_name FROM {nations} a JOIN {regions} b ON a.rk = b.rk")
# Lists of cameras one after the other, each in its own order.
query("u01_concat_cameras", "SELECT n_nationkey + CASE WHEN list = 0 THEN 0 ELSE (SELECT count(*) FROM {nation}) END AS ord, list, n_name AS name FROM (SELECT 0 AS list, n_nationkey, n_name FROM {nation} UNION ALL SELECT 1, n_nationkey, n_name FROM {nation}) u")
query("t13_suffix_sort", r"SELECT c_nationkey, c, row_number() OVER (PARTITION BY c_nationkey ORDER BY CAST(regexp_extract(c, '([0-9]+)$', 1) AS INT)) AS place FROM (SELECT DISTINCT c_nationkey, concat('f_rest_', CAST(c_custkey % 45 AS VARCHAR(10))) AS c FROM {customer}) q")

query("p39_name_grammar", r"SELECT name, regexp_extract(name, '^(per_[a-z]+)_', 1) AS granularity, regexp_extract(name, '_(l1|l2)_', 1) AS norm, regexp_extract(name, '_(max|mean)(_nocolor)?[.]pt$', 1) AS reduction, name LIKE '%_nocolor.pt' AS nocolour FROM (SELECT DISTINCT concat(CASE s_suppkey % 6 WHEN 0 THEN 'per_channel' WHEN 1 THEN 'per_pixel' WHEN 2 THEN 'per_tile' WHEN 3 THEN 'per_image' WHEN 4 THEN 'per_batch' ELSE 'per_scene' END, '_', CASE s_nationkey % 2 WHEN 0 THEN 'l1' ELSE 'l2' END, '_', CASE s_nationkey % 3 WHEN 0 THEN 'max' ELSE 'mean' END, CASE s_nationkey % 5 WHEN 0 THEN '_nocolor' ELSE '' END, '.pt') AS name FROM {supplier}) x")
