"""Indoor or outdoor: all measures, scores and labels of a scene's gaussians, for any preset of thresholds."""

from __future__ import annotations

from math import cos, radians

from .catalog import query, stage

# The thresholds by default and in the named presets, and the weights of the evidence.
DEFAULTS = {"aabb_pct_low": 0.0001, "aabb_pct_high": 0.9999, "aabb_mul": 1.20, "tau_shell_frac": 0.03, "tau_topbot_frac": 0.03, "thr_core_frac": 0.12, "open_radius_frac": 0.35, "open_bins": 200, "open_cone_deg": 15.0, "open_alpha_min": 0.25, "io_fallback": "auto", "io_uncertain_band": 0.10}
PRESETS = {
    "smart": {"aabb_pct_low": 0.005, "aabb_pct_high": 0.995, "aabb_mul": 1.05, "tau_shell_frac": 0.085, "tau_topbot_frac": 0.050, "thr_core_frac": 0.14, "open_radius_frac": 0.37, "open_bins": 240, "open_cone_deg": 20.0, "open_alpha_min": 0.20},
    "safe": {"aabb_pct_low": 0.005, "aabb_pct_high": 0.995, "aabb_mul": 1.05, "tau_shell_frac": 0.085, "tau_topbot_frac": 0.050, "thr_core_frac": 0.14, "open_radius_frac": 0.37, "open_bins": 240, "open_cone_deg": 20.0, "open_alpha_min": 0.20, "io_fallback": "auto", "io_uncertain_band": 0.10},
    "wide": {"tau_shell_frac": 0.10, "tau_topbot_frac": 0.06, "thr_core_frac": 0.14, "open_radius_frac": 0.37, "open_bins": 240, "open_cone_deg": 22.0, "open_alpha_min": 0.20},
    "tight": {"aabb_pct_low": 0.005, "aabb_pct_high": 0.995, "aabb_mul": 1.05, "tau_shell_frac": 0.038, "tau_topbot_frac": 0.03, "thr_core_frac": 0.16, "open_radius_frac": 0.37, "open_bins": 240, "open_cone_deg": 22.0, "open_alpha_min": 0.20},
    "balanced": {"tau_shell_frac": 0.035, "tau_topbot_frac": 0.03, "thr_core_frac": 0.145, "open_radius_frac": 0.37, "open_bins": 240, "open_cone_deg": 18.0, "open_alpha_min": 0.23},
    "skew-in": {"tau_shell_frac": 0.04, "tau_topbot_frac": 0.02, "thr_core_frac": 0.14, "open_radius_frac": 0.40, "open_bins": 300, "open_cone_deg": 20.0, "open_alpha_min": 0.20},
    "skew-out": {"tau_shell_frac": 0.03, "tau_topbot_frac": 0.03, "thr_core_frac": 0.12, "open_radius_frac": 0.35, "open_bins": 300, "open_cone_deg": 15.0, "open_alpha_min": 0.25},
}
#: Bands tried in turn where the first finds no walls, as multiples of it, and their bound as a share of the diagonal.
WIDER, WIDEST = (1.5, 2.0), 0.12
_FRACTIONS = {
    "frac_shell_any": "near_x OR near_y OR near_z", "frac_shell_two_plus": "CAST(near_x AS INT) + CAST(near_y AS INT) + CAST(near_z AS INT) >= 2",
    "frac_x_planes": "near_x", "frac_y_planes": "near_y", "frac_z_planes": "near_z", "frac_x_min": "x_min <= shell", "frac_x_max": "x_max <= shell",
    "frac_z_min": "z_min <= shell", "frac_z_max": "z_max <= shell", "frac_top": "y_max <= strip", "frac_bottom": "y_min <= strip",
}


def parameters(preset: str | None = None, **given) -> dict:
    """The thresholds: what is given goes before the preset, and that before the defaults."""
    unknown = set(given) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"no such thresholds: {sorted(unknown)}")
    return DEFAULTS | (PRESETS[preset] if preset else {}) | {k: v for k, v in given.items() if v is not None}


def classifier(v: str, p: dict) -> None:
    """Stages ending in `classes{v}`: a row for each scene with its label, confidence and measures."""
    num = lambda k: f"{float(p[k])!r}e0"
    bands = (1.0, *WIDER)
    stage(f"io_quantiles{v}", "SELECT scene, " + ", ".join(f"PCT({c}, {p['aabb_pct_low']}) AS ql{c}, PCT({c}, {p['aabb_pct_high']}) AS qh{c}" for c in "xyz") + " FROM {pts} GROUP BY scene")
    grown = lambda e, c: f"(ql{c} + qh{c}) / 2 + (q{e}{c} - (ql{c} + qh{c}) / 2) * {num('aabb_mul')}"
    stage(f"io_box{v}", "SELECT b.*, greatest(sqrt(" + " + ".join(f"(hi{c} - lo{c}) * (hi{c} - lo{c})" for c in "xyz") + "), 1e-8) AS diag FROM (SELECT scene, " + ", ".join(f"least({grown('l', c)}, {grown('h', c)}) AS lo{c}, greatest({grown('l', c)}, {grown('h', c)}) AS hi{c}" for c in "xyz") + f" FROM {{io_quantiles{v}}}) b", cut=True)
    stage(f"io_points{v}", "SELECT p.scene, gid, x, y, z, alpha, " + ", ".join(f"least(1e0, greatest(0e0, {c} + 0.5e0)) AS {c}" for c in "rgb") + ", diag, " + ", ".join(f"abs({c} - lo{c}) AS {c}_min, abs(hi{c} - {c}) AS {c}_max" for c in "xyz") + f" FROM {{pts}} p JOIN {{io_box{v}}} b ON p.scene = b.scene")
    width = lambda tau, m: f"{num(tau)} * diag" if m == 1 else f"least({num(tau)} * diag * {m}e0, {WIDEST}e0 * diag)"
    for k, m in enumerate(bands):
        stage(f"io_near{k}{v}", f"SELECT q.*, " + ", ".join(f"({c}_min <= shell OR {c}_max <= shell) AS near_{c}" for c in "xyz") + f" FROM (SELECT i.*, {width('tau_shell_frac', m)} AS shell, {width('tau_topbot_frac', m)} AS strip FROM {{io_points{v}}} i) q")
        stage(f"io_bands{k}{v}", "SELECT scene, " + ", ".join(f"avg(CASE WHEN {test} THEN 1e0 ELSE 0e0 END) AS {name}" for name, test in _FRACTIONS.items()) + f" FROM {{io_near{k}{v}}} GROUP BY scene")
    core = " AND ".join(f"{c}_{e} > {num('thr_core_frac')} * diag" for c in "xyz" for e in ("min", "max"))
    stage(f"io_top{v}", f"SELECT scene, coalesce(avg(CASE WHEN y_max <= strip THEN greatest(b - greatest(r, g), 0e0) END), 0e0) AS blue_top_score, coalesce(avg(CASE WHEN y_max <= strip THEN alpha END), 1e0) AS top_alpha_mean, avg(CASE WHEN {core} THEN 1e0 ELSE 0e0 END) AS frac_core FROM {{io_near0{v}}} GROUP BY scene")
    middle = lambda test, c: f"percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN {test} THEN {c} END)"
    stage(f"io_centre{v}", "SELECT b.*, " + ", ".join(f"coalesce(m{c}, o{c}, (lo{c} + hi{c}) / 2) AS c{c}" for c in "xyz") + f" FROM {{io_box{v}}} b JOIN (SELECT scene, " + ", ".join(f"{middle(core, c)} AS m{c}, {middle('NOT (near_x OR near_y OR near_z)', c)} AS o{c}" for c in "xyz") + f" FROM {{io_near0{v}}} GROUP BY scene) m ON b.scene = m.scene", cut=True)
    n = int(p["open_bins"])
    stage(f"io_probes{v}", f"SELECT k, sqrt(greatest(1 - z * z, 0e0)) * cos(t) AS dx, sqrt(greatest(1 - z * z, 0e0)) * sin(t) AS dy, z AS dz FROM (SELECT k, 1 - 2 * (k + 0.5e0) / {n}e0 AS z, pi() * (1 + sqrt(5e0)) * (k + 0.5e0) AS t FROM (SELECT 1 AS one) o, SERIES<0;{n - 1}> AS s(k)) q")
    leaves = "least(" + ", ".join(f"CASE WHEN abs(d{c}) < 1e-9 THEN 1e30 ELSE greatest((lo{c} - c{c}) / d{c}, (hi{c} - c{c}) / d{c}) END" for c in "xyz") + ")"
    stage(f"io_rays{v}", f"SELECT scene, k, dx, dy, dz, least({num('open_radius_frac')} * diag, greatest(0e0, {leaves})) AS reach FROM {{io_centre{v}}} CROSS JOIN {{io_probes{v}}}")
    # A point is compared with its scene's probes, whose number is fixed.
    stage(f"io_blocked{v}", f"SELECT DISTINCT r.scene, r.k FROM {{io_rays{v}}} r JOIN (SELECT w.*, greatest(sqrt(vx * vx + vy * vy + vz * vz), 1e-8) AS unit, sqrt(vx * vx + vy * vy + vz * vz) AS dist FROM (SELECT p.scene, " + ", ".join(f"p.{c} - c{c} AS v{c}" for c in "xyz") + f" FROM {{pts}} p JOIN {{io_centre{v}}} c ON p.scene = c.scene WHERE alpha >= {num('open_alpha_min')}) w) p ON r.scene = p.scene WHERE dist <= reach AND (vx * dx + vy * dy + vz * dz) / unit >= {cos(radians(p['open_cone_deg']))!r}e0", cut=True)
    stage(f"io_open{v}", f"SELECT r.scene, avg(CASE WHEN b.k IS NULL THEN 1e0 ELSE 0e0 END) AS open_frac_global, coalesce(avg(CASE WHEN dy > 0 THEN CASE WHEN b.k IS NULL THEN 1e0 ELSE 0e0 END END), avg(CASE WHEN b.k IS NULL THEN 1e0 ELSE 0e0 END)) AS open_frac_up FROM {{io_rays{v}}} r LEFT JOIN {{io_blocked{v}}} b ON r.scene = b.scene AND r.k = b.k GROUP BY r.scene")
    stage(f"io_first{v}", f"SELECT b.scene, x.diag, (hiy - loy) / x.diag AS v_ratio, blue_top_score, top_alpha_mean, frac_core, greatest(0e0, frac_shell_any - frac_core) AS gap0, open_frac_global, open_frac_up, frac_shell_any, frac_x_planes + frac_z_planes AS planes, least(frac_x_min, frac_x_max) + least(frac_z_min, frac_z_max) AS paired FROM {{io_bands0{v}}} b JOIN {{io_box{v}}} x ON b.scene = x.scene JOIN {{io_top{v}}} t ON b.scene = t.scene JOIN {{io_open{v}}} o ON b.scene = o.scene", cut=True)
    locked = "(open_frac_up >= 0.45e0 OR open_frac_global >= 0.45e0)"
    asks = f"NOT {locked} AND frac_shell_any < 0.40e0 AND paired < 0.05e0 AND planes < 0.18e0 AND open_frac_up < 0.25e0 AND open_frac_global < 0.30e0 AND blue_top_score < 0.06e0 AND top_alpha_mean >= 0.15e0 AND (gap0 >= 0.25e0 OR frac_core >= 0.04e0 OR v_ratio <= 0.45e0)"
    wants = {"auto": asks, "force": "1 = 1", "off": "1 = 0"}[p["io_fallback"]]
    finds = lambda k: f"(w{k}.frac_shell_any >= 0.40e0 OR least(w{k}.frac_x_min, w{k}.frac_x_max) + least(w{k}.frac_z_min, w{k}.frac_z_max) >= 0.05e0 OR w{k}.frac_x_planes + w{k}.frac_z_planes >= 0.18e0)"
    used = "CASE WHEN NOT wants THEN 0 " + " ".join(f"WHEN {finds(k)} THEN {k}" for k in range(1, len(bands))) + " ELSE 0 END"
    stage(f"io_band{v}", f"SELECT f.scene, {used} AS band FROM (SELECT i.*, ({wants}) AS wants FROM {{io_first{v}}} i) f " + " ".join(f"JOIN {{io_bands{k}{v}}} w{k} ON f.scene = w{k}.scene" for k in range(1, len(bands))))
    picked = " UNION ALL ".join(f"SELECT s.*, b.band FROM {{io_bands{k}{v}}} s JOIN {{io_band{v}}} b ON s.scene = b.scene WHERE b.band = {k}" for k in range(len(bands)))
    scale = "CASE band " + " ".join(f"WHEN {k} THEN {m}e0" for k, m in enumerate(bands)) + " END"
    cap = lambda tau: f"CASE WHEN band = 0 THEN {num(tau)} * diag ELSE least({num(tau)} * diag * {scale}, {WIDEST}e0 * diag) END"
    measures = "least(frac_x_min, frac_x_max) AS paired_x, least(frac_z_min, frac_z_max) AS paired_z, (frac_top >= 0.08e0) AS enough, least(1e0, greatest(0e0, v_ratio / 0.25e0)) AS bvt_gain"
    stage(f"io_measures{v}", f"SELECT m.*, (paired_x + paired_z >= 0.05e0 OR frac_x_planes + frac_z_planes >= 0.18e0) AS walls FROM (SELECT s.*, f.diag, f.v_ratio, f.blue_top_score, f.top_alpha_mean, f.frac_core, f.gap0 AS enclosure_gap, f.open_frac_global, f.open_frac_up, {cap('tau_shell_frac')} AS thr_shell_abs, {cap('tau_topbot_frac')} AS thr_topbot_abs, {num('thr_core_frac')} * f.diag AS thr_core_abs, {measures} FROM ({picked}) s JOIN {{io_first{v}}} f ON s.scene = f.scene) m", cut=True)
    above = lambda w, x, t: f"{w}e0 * greatest(0e0, {x} - {t}e0)"
    below = lambda w, x, t: f"{w}e0 * greatest(0e0, {t}e0 - {x})"
    hole = "CASE WHEN NOT enough AND walls THEN {a}e0 ELSE {b}e0 END"
    out = f"1.4e0 * bvt_gain * greatest(0e0, frac_bottom - frac_top) + CASE WHEN enough THEN 0.9e0 * greatest(0e0, blue_top_score) + {below(0.7, 'top_alpha_mean', 0.35)} ELSE 0e0 END + {below(0.5, 'frac_shell_any', 0.25)} + {below(0.4, 'frac_shell_two_plus', 0.12)} + {hole.format(a=0.7, b=1.0)} * {above(0.8, 'open_frac_global', 0.35)} + {hole.format(a=0.6, b=1.0)} * {above(1.1, 'open_frac_up', 0.35)}"
    ins = f"{above(0.9, 'frac_shell_any', 0.28)} + {above(0.7, 'frac_shell_two_plus', 0.07)} + paired_x + paired_z + 0.8e0 * least(frac_x_planes, frac_z_planes) + {above(0.5, '(frac_top + frac_bottom)', 0.18)} + enclosure_gap + {hole.format(a=0.35, b=0.0)}"
    stage(f"io_scores{v}", f"SELECT s.*, outdoor_score - indoor_score AS score_net, 1 / (1 + exp(-2 * (outdoor_score - indoor_score))) AS p_outdoor FROM (SELECT m.*, {out} AS outdoor_score, {ins} AS indoor_score FROM {{io_measures{v}}} m) s")
    # Where the sky is open an indoor verdict would become uncertain, as it has a probability under a half.
    stage(f"classes{v}", f"SELECT s.*, CASE WHEN abs(p_outdoor - 0.5e0) < {num('io_uncertain_band')} THEN 'uncertain' WHEN p_outdoor > 0.5e0 THEN 'outdoor' WHEN {locked} AND p_outdoor < 0.5e0 THEN 'uncertain' ELSE 'indoor' END AS label FROM {{io_scores{v}}} s")


METRICS = ["p_outdoor", "score_net", "diag", "thr_shell_abs", "thr_topbot_abs", "thr_core_abs", "v_ratio", *_FRACTIONS, "paired_x", "paired_z", "blue_top_score", "top_alpha_mean", "bvt_gain", "enclosure_gap", "frac_core", "open_frac_global", "open_frac_up", "outdoor_score", "indoor_score"]
classifier("", parameters())
for _preset in PRESETS:
    classifier("_" + _preset.replace("-", "_"), parameters(_preset))
classifier("_given", parameters("wide", io_fallback="force", io_uncertain_band=0.02))
query("p43_scene_classifier", "SELECT scene, label, round(greatest(p_outdoor, 1 - p_outdoor), 8) AS confidence, round(1 - p_outdoor, 8) AS p_indoor, " + ", ".join(f"round({m}, 8) AS {m}" for m in METRICS) + ", CAST(enough AS INT) AS enough_top, CAST(walls AS INT) AS walls_evidence, CAST(band > 0 AS INT) AS fallback_used FROM {classes}")
query("f15_presets", " UNION ALL ".join(f"SELECT '{name}' AS preset, scene, label, round(p_outdoor, 8) AS p_outdoor, band FROM {{classes_{name.replace('-', '_')}}}" for name in (*PRESETS, "given")))
query("a17_robust_aabb", "SELECT scene, " + ", ".join(f"round({e}{c}, 8) AS {e}{c}" for c in "xyz" for e in ("lo", "hi")) + " FROM {io_box}")
query("a19_fractions", "SELECT scene, " + ", ".join(f"round({m}, 8) AS {m}" for m in _FRACTIONS) + " FROM {io_bands0}")
query("a20_conditional_means", "SELECT scene, round(blue_top_score, 8) AS blue, round(top_alpha_mean, 8) AS top_alpha FROM {io_top}")
query("a21_openness", "SELECT scene, round(open_frac_global, 8) AS open_global, round(open_frac_up, 8) AS open_up FROM {io_open}")
query("f05_plane_bands", "SELECT scene, gid, near_x, near_y, near_z, CAST(near_x AS INT) + CAST(near_y AS INT) + CAST(near_z AS INT) >= 2 AS two_axes FROM {io_near0}")
query("f06_core_membership", "SELECT scene, round(frac_core, 8) AS frac_core FROM {io_top}")
query("f07_cone_test", "SELECT scene, k FROM {io_blocked}")
query("j09_direction_cone_join", "SELECT scene, count(*) AS blocked FROM {io_blocked} GROUP BY scene")
query("i13_fallback_widening", "SELECT g.scene, g.band, a.band AS auto_band, round(g.thr_shell_abs, 8) AS shell FROM {io_measures_given} g JOIN {io_band} a ON g.scene = a.scene")
query("p21_ray_aabb_exit", "SELECT scene, k, round(reach, 7) AS reach FROM {io_rays}")
