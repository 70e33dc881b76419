"""Gaussian scenes: projection, tiles, pixels, ordered compositing and the six sensitivity levels."""

from __future__ import annotations

from ..operators.compositing import composite
from .catalog import numbered, query, stage
from .sensitivity import EPS

W, TILE, FOCAL = 64, 16, "(32e0 / tan(pi() / 6e0))"
stage("gauss", "SELECT vec_id AS gid, label AS scene, " + ", ".join(f"8 * E<{k}> AS {c}" for k, c in enumerate("xyz")) + ", " + ", ".join(f"4 * E<{k + 3}> AS dc{k}" for k in range(3))
      + ", " + ", ".join(f"0.4e0 * E<{6 + k}> AS sh{k}" for k in range(45)) + ", 16 * E<51> AS logit, " + ", ".join(f"-2.5e0 + 4 * E<{52 + k}> AS ls{k}" for k in range(3))
      + ", " + ", ".join(f"E<{55 + k}> / greatest(sqrt(E<55> * E<55> + E<56> * E<56> + E<57> * E<57> + E<58> * E<58>), 1e-8) AS q{k}" for k in range(4)) + " FROM {embeddings}", cut=True, dealt="vec_id")
query("p01_sigmoid_opacity", "SELECT gid, round(1 / (1 + exp(-logit)), 9) AS alpha FROM {gauss}")
query("p02_exp_scale", "SELECT gid, round(exp(ls0), 9) AS s0, round(exp(ls1), 9) AS s1, round(exp(ls2), 9) AS s2, round(exp(2 * ls0), 9) AS v0 FROM {gauss}")
stage("rot", """SELECT gid, 1 - 2 * (q2 * q2 + q3 * q3) AS r00, 2 * (q1 * q2 - q0 * q3) AS r01, 2 * (q1 * q3 + q0 * q2) AS r02, 2 * (q1 * q2 + q0 * q3) AS r10, 1 - 2 * (q1 * q1 + q3 * q3) AS r11, 2 * (q2 * q3 - q0 * q1) AS r12,
  2 * (q1 * q3 - q0 * q2) AS r20, 2 * (q2 * q3 + q0 * q1) AS r21, 1 - 2 * (q1 * q1 + q2 * q2) AS r22, exp(2 * ls0) AS v0, exp(2 * ls1) AS v1, exp(2 * ls2) AS v2 FROM {gauss}""", cut=True)
query("p03_rotation", "SELECT gid, " + ", ".join(f"round(r{i}{j}, 8) AS r{i}{j}" for i in range(3) for j in range(3)) + " FROM {rot}")
stage("cov", "SELECT gid, " + ", ".join(f"r{i}0 * r{j}0 * v0 + r{i}1 * r{j}1 * v1 + r{i}2 * r{j}2 * v2 AS c{i}{j}" for i in range(3) for j in range(i, 3)) + " FROM {rot}", cut=True)
query("p04_world_covariance", "SELECT gid, " + ", ".join(f"round(c{i}{j}, 8) AS c{i}{j}" for i in range(3) for j in range(i, 3)) + " FROM {cov}")
stage("sphere", "SELECT n_nationkey AS k, sqrt(1 - z * z) * cos(t) AS dx, sqrt(1 - z * z) * sin(t) AS dy, z AS dz FROM (SELECT n_nationkey, 1 - 2 * (n_nationkey + 0.5e0) / 25e0 AS z, pi() * (1 + sqrt(5e0)) * (n_nationkey + 0.5e0) AS t FROM {nation}) s")
query("p20_fibonacci_sphere", "SELECT k, round(dx, 8) AS dx, round(dy, 8) AS dy, round(dz, 8) AS dz FROM {sphere}")
stage("cam", """SELECT k AS cam, CAST(floor(k / 5) AS INT) AS batch, rx, ry, rz, ry * fz - rz * fy AS ux, rz * fx - rx * fz AS uy, rx * fy - ry * fx AS uz, fx, fy, fz, 4 * dx AS ex, 4 * dy AS ey, 4 * dz AS ez FROM
  (SELECT k, dx, dy, dz, -dx AS fx, -dy AS fy, -dz AS fz, dz / sqrt(dx * dx + dz * dz) AS rx, 0e0 AS ry, -dx / sqrt(dx * dx + dz * dz) AS rz FROM {sphere}) s""", cut=True)
query("p17_look_at", "SELECT cam, " + ", ".join(f"round({c}, 8) + 0e0 AS {c}" for c in ("rx", "rz", "ux", "uy", "uz", "fx", "fy", "fz")) + " FROM {cam}")
# The constants of the real spherical harmonics of degrees 0 to 3, and their order.
SH_C0, SH_C1 = "0.28209479177387814e0", "0.4886025119029199e0"
SH_C2 = ("1.0925484305920792e0", "-1.0925484305920792e0", "0.31539156525252005e0", "-1.0925484305920792e0", "0.5462742152960396e0")
SH_C3 = ("-0.5900435899266435e0", "2.890611442640554e0", "-0.4570457994644658e0", "0.3731763325901154e0", "-0.4570457994644658e0", "1.445305721320277e0", "-0.5900435899266435e0")
_SHAPES = (
    ("-vy", "vz", "-vx"),
    ("vx * vy", "vy * vz", "(2 * vz * vz - vx * vx - vy * vy)", "vx * vz", "(vx * vx - vy * vy)"),
    ("vy * (3 * vx * vx - vy * vy)", "vx * vy * vz", "vy * (4 * vz * vz - vx * vx - vy * vy)", "vz * (2 * vz * vz - 3 * vx * vx - 3 * vy * vy)", "vx * (4 * vz * vz - vx * vx - vy * vy)", "vz * (vx * vx - vy * vy)", "vx * (vx * vx - 3 * vy * vy)"),
)
BASIS = [f"{c} * ({shape})" for scale, shapes in zip(((SH_C1,) * 3, SH_C2, SH_C3), _SHAPES, strict=True) for c, shape in zip(scale, shapes, strict=True)]


def colour(channel: int, degree: int) -> str:
    """A channel's colour from the direction (vx, vy, vz) in camera space, at least 0."""
    terms = "".join(f" + b{k} * sh{15 * channel + k}" for k in range((degree + 1) ** 2 - 1))
    return f"greatest(0e0, 0.5e0 + {SH_C0} * dc{channel}{terms})"


stage("seen_by", """SELECT g.*, c.cam, c.batch, c.rx, c.ry, c.rz, c.ux, c.uy, c.uz, c.fx, c.fy, c.fz, c.rx * (g.x - c.ex) + c.ry * (g.y - c.ey) + c.rz * (g.z - c.ez) AS cx, c.ux * (g.x - c.ex) + c.uy * (g.y - c.ey) + c.uz * (g.z - c.ez) AS cy,
  c.fx * (g.x - c.ex) + c.fy * (g.y - c.ey) + c.fz * (g.z - c.ez) AS cz FROM {gauss} g CROSS JOIN {cam} c""")
stage("view", "SELECT gid, cam, cx, cy, cz FROM {seen_by}")
# The direction and the basis are made once for each visible pair of a camera and a gaussian.
stage("basis", "SELECT s.*, " + ", ".join(f"{e} AS b{k}" for k, e in enumerate(BASIS)) + " FROM (SELECT v.*, cx / n AS vx, cy / n AS vy, cz / n AS vz FROM (SELECT w.*, greatest(sqrt(cx * cx + cy * cy + cz * cz), 1e-12) AS n FROM {seen_by} w WHERE cz > 0.2e0) v) s")
query("p05_world_to_camera", "SELECT gid, cam, round(cx, 7) AS cx, round(cy, 7) AS cy, round(cz, 7) AS cz FROM {view}")
query("j01_camera_product", "SELECT cam, count(*) AS n FROM {view} GROUP BY cam")
query("p06_pinhole", f"SELECT gid, cam, round({FOCAL} * cx / (cz + 1e-8) + 32, 6) AS u, round({FOCAL} * cy / (cz + 1e-8) + 32, 6) AS v FROM {{view}} WHERE cz > 0.2e0")
query("p11_sh_colour", "SELECT gid, cam, " + ", ".join(f"round({colour(c, d)}, 7) AS c{c}_degree{d}" for d in range(4) for c in range(3)) + " FROM {basis}")
# A model's degree follows from how many coefficients a channel has; here from those of a gaussian that are not 0 at the end.
query("p12_sh_degree", "SELECT gid, CASE WHEN m >= 16 THEN 3 WHEN m >= 9 THEN 2 WHEN m >= 4 THEN 1 ELSE 0 END AS degree FROM (SELECT gid, 1 + greatest(" + ", ".join(f"CASE WHEN abs(sh{k}) > 0.05e0 THEN {k + 1} ELSE 0 END" for k in range(15)) + ") AS m FROM {gauss}) d")
query("p13_dc_rgb", "SELECT gid, round(least(1e0, greatest(0e0, dc0 + 0.5e0)), 8) AS r, round(least(1e0, greatest(0e0, dc1 + 0.5e0)), 8) AS g, round(least(1e0, greatest(0e0, dc2 + 0.5e0)), 8) AS b FROM {gauss}")
_LIM = "1.3e0 * tan(pi() / 6e0)"
stage("jac", f"""SELECT gid, cam, batch, rx, ry, rz, ux, uy, uz, fx, fy, fz, cx, cy, cz, 1 / (1 + exp(-logit)) AS alpha, {", ".join(f"{colour(c, 3)} AS c{c}" for c in range(3))}, {FOCAL} / (cz + 1e-8) AS j0, -{FOCAL} * least({_LIM}, greatest(-{_LIM}, cx / (cz + 1e-8))) / (cz + 1e-8) AS j1,
  -{FOCAL} * least({_LIM}, greatest(-{_LIM}, cy / (cz + 1e-8))) / (cz + 1e-8) AS j2, {FOCAL} * cx / (cz + 1e-8) + 32 AS u, {FOCAL} * cy / (cz + 1e-8) + 32 AS v FROM {{basis}}""", cut=True)
query("p07_jacobian", "SELECT gid, cam, round(j0, 6) AS j0, round(j1, 6) AS j1, round(j2, 6) AS j2 FROM {jac}")
stage("rows2", "SELECT gid, cam, batch, cz, alpha, c0, c1, c2, u, v, " + ", ".join(f"j0 * {a}{c} + {j} * f{c} AS {m}{c}" for m, a, j in (("a", "r", "j1"), ("b", "u", "j2")) for c in "xyz") + " FROM {jac}")
_Q = lambda p, q: " + ".join(f"r.{p}{'xyz'[i]} * r.{q}{'xyz'[j]} * c.c{min(i, j)}{max(i, j)}" for i in range(3) for j in range(3))
stage("s2", f"SELECT r.gid, r.cam, r.batch, r.cz, r.alpha, r.c0, r.c1, r.c2, r.u, r.v, {_Q('a', 'a')} AS sxx, {_Q('a', 'b')} AS sxy, {_Q('b', 'b')} AS syy FROM {{rows2}} r JOIN {{cov}} c ON r.gid = c.gid")
query("p08_covariance_2d", "SELECT gid, cam, round(sxx, 5) AS sxx, round(sxy, 5) AS sxy, round(syy, 5) AS syy, round(greatest(sxx * syy - sxy * sxy, 1e-12), 4) AS det FROM {s2}")
query("p09_pixel_sigmas", "SELECT gid, cam, round(least(128e0, greatest(0.5e0, sqrt(sxx))), 5) AS sx, round(least(128e0, greatest(0.5e0, sqrt(syy))), 5) AS sy FROM {s2}")
stage("conic", """SELECT gid, cam, batch, cz, alpha, c0, c1, c2, u, v, syy / det AS ia, -sxy / det AS ib, sxx / det AS ic, sxx, syy, ceil(3 * sqrt(greatest((sxx + syy) / 2 + sqrt(greatest((sxx + syy) * (sxx + syy) / 4 - det, 0e0)), 0e0)) + 1) AS radius FROM
  (SELECT s.*, greatest(sxx * syy - sxy * sxy, 1e-12) AS det FROM {s2} s) d""", cut=True)
query("p10_splat_radius", "SELECT gid, cam, CAST(radius AS BIGINT) AS radius FROM {conic}")
stage("rect", f"""SELECT * FROM (SELECT c.*, CAST(greatest(0e0, least(4e0, floor((u - radius) / {TILE}))) AS INT) AS x0, CAST(greatest(0e0, least(4e0, floor((u + radius) / {TILE}) + 1)) AS INT) AS x1,
  CAST(greatest(0e0, least(4e0, floor((v - radius) / {TILE}))) AS INT) AS y0, CAST(greatest(0e0, least(4e0, floor((v + radius) / {TILE}) + 1)) AS INT) AS y1 FROM {{conic}} c) r WHERE x1 > x0 AND y1 > y0""")
query("f01_frustum", "SELECT cam, count(*) AS visible FROM {rect} GROUP BY cam")
query("j02_tile_pairs", "SELECT cam, tx, ty, count(*) AS n FROM {rect} r, SERIES<x0;x1 - 1> AS a(tx), SERIES<y0;y1 - 1> AS b(ty) GROUP BY cam, tx, ty")
query("a12_tile_histogram", "SELECT n, count(*) AS tiles FROM {j02_tile_pairs} GROUP BY n")
# Pixels of a splat's tiles inside the box that holds its 3-sigma ellipse, which no supported pixel is outside of.
_BOX = f"""SELECT * FROM (SELECT q.*, CAST(greatest(x0 * {TILE}, floor(u - 3 * sqrt(sxx)) - 1) AS INT) AS l, CAST(least(x1 * {TILE} - 1, ceil(u + 3 * sqrt(sxx))) AS INT) AS r, CAST(greatest(y0 * {TILE}, floor(v - 3 * sqrt(syy)) - 1) AS INT) AS t, CAST(least(y1 * {TILE} - 1, ceil(v + 3 * sqrt(syy))) AS INT) AS b FROM {{rect}} q) w WHERE l <= r AND t <= b"""
stage("pix", f"""SELECT gid, cam, batch, cz, c0, c1, c2, px, py, least(0.99e0, alpha * exp(-conic / 2)) AS a FROM (SELECT r.*, px, py, ia * (px - u) * (px - u) + 2 * ib * (px - u) * (py - v) + ic * (py - v) * (py - v) AS conic FROM
  ({_BOX}) r,
  SERIES<l;r> AS sx(px), SERIES<t;b> AS sy(py)) z WHERE conic <= 9 AND -conic / 2 >= ln(1e0 / 255) - ln(greatest(alpha, 1e-8))""")
query("j03_pixel_grid", "SELECT cam, count(*) AS rows_, count(DISTINCT py * 64 + px) AS pixels FROM {pix} GROUP BY cam")
query("f02_pixel_support", "SELECT gid, count(*) AS n, round(sum(a), 5) AS mass FROM {pix} GROUP BY gid")
# The same rows from the splats of each tile, front to back: the pixels before the camera are never dealt out or sorted.
stage("splats", f"SELECT gid, cam, batch, cz, c0, c1, c2, u, v, ia, ib, ic, alpha, ln(1e0 / 255) - ln(greatest(alpha, 1e-8)) AS faint, l, r, t, b, tx, ty FROM ({_BOX}) w, SERIES<floor(l / {TILE});floor(r / {TILE})> AS a(tx), SERIES<floor(t / {TILE});floor(b / {TILE})> AS c(ty)")
stage("comp", """SELECT gid, cam, batch, px, py, cz, a, t, a * t AS w, c0, c1, c2 FROM (SELECT p.*, coalesce(exp(sum(ln(1 - a)) OVER (PARTITION BY cam, px, py ORDER BY cz, gid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1e0) AS t FROM {pix} p) z WHERE t >= 1e-4""", cut=True, make=lambda splats: composite(splats, TILE, 1e-4), needs=("splats",))
query("w01_transmittance", "SELECT cam, px, py, round(min(t), 6) AS t_last FROM {comp} GROUP BY cam, px, py")
query("w03_depth_sort", "SELECT cam, px, py, gid, row_number() OVER (PARTITION BY cam, px, py ORDER BY cz, gid) AS place FROM {comp}")
query("f03_early_termination", "SELECT cam, count(*) AS active FROM {comp} GROUP BY cam")
stage("tiles", f"SELECT gid, cam, 256 * 3 AS p3 FROM {{rect}} r, SERIES<x0;x1 - 1> AS a(tx), SERIES<y0;y1 - 1> AS b(ty)")
stage("tcount", "SELECT gid, sum(p3) AS p3, count(*) AS tiles FROM {tiles} GROUP BY gid", cut=True)
stage("blank", f"SELECT t.cam, t.tx, t.ty, {TILE * TILE} - coalesce(n, 0) AS n FROM (SELECT DISTINCT cam, tx, ty FROM {{rect}} r, SERIES<x0;x1 - 1> AS a(tx), SERIES<y0;y1 - 1> AS b(ty)) t LEFT JOIN (SELECT cam, floor(px / {TILE}) AS tx, floor(py / {TILE}) AS ty, count(*) AS n FROM {{image}} GROUP BY cam, floor(px / {TILE}), floor(py / {TILE})) l ON t.cam = l.cam AND t.tx = l.tx AND t.ty = l.ty")


def variant(v: str, rgb: tuple[str, ...], background: str) -> None:
    """Image, effective contributions and the six levels of one colour mode over one background."""
    after = "exp(sum(ln(1 - a)))"
    stage(f"image{v}", "SELECT cam, px, py, " + ", ".join(f"least(1e0, greatest(0e0, sum(w * {c}) + {background} * {after})) AS d{k}" for k, c in enumerate(rgb)) + f", sum(w * cz) AS depth, {after} AS t FROM {{comp}} GROUP BY cam, px, py")
    room = "1e0" if background == "0e0" else f"greatest(0e0, 1 - {background} * exp(sum(ln(1 - a)) OVER (PARTITION BY cam, px, py)))"
    shares = ", ".join(f"least(w * {c}, greatest(0e0, {room} - coalesce(sum(w * {c}) OVER (PARTITION BY cam, px, py ORDER BY cz, gid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))) AS e{k}" for k, c in enumerate(rgb))
    stage(f"eff{v}", f"SELECT gid, cam, batch, px, py, {shares} FROM {{comp}}")
    stage(f"pairs{v}", f"SELECT e.*, d0, d1, d2 FROM {{eff{v}}} e JOIN {{image{v}}} i ON e.cam = i.cam AND e.px = i.px AND e.py = i.py", cut=True)
    for norm, power in (("l1", "{x}"), ("l2", "{x} * {x}")):
        e, d = ([power.replace("{x}", f"{c}{k}") for k in range(3)] for c in "ed")
        name = f"{norm}{v}"
        shares = [f"({e[k]}) / greatest({d[k]}, {EPS})" for k in range(3)]
        stage(f"lev_{name}", f"SELECT gid, cam, batch, px, py, greatest({', '.join(shares)}) AS ch, {' + '.join(shares)} AS chs, {power.replace('{x}', '(e0 + e1 + e2)')} AS n, {power.replace('{x}', '(d0 + d1 + d2)')} AS d FROM {{pairs{v}}}")
        query(f"a01_per_channel_{name}", f"SELECT l.gid, round(least(1e0, max(ch)), 6) AS sens_max, round(least(1e0, sum(chs) / max(p3)), 6) AS sens_mean FROM {{lev_{name}}} l JOIN {{tcount}} t ON l.gid = t.gid GROUP BY l.gid")
        query(f"a02_per_pixel_{name}", f"SELECT l.gid, round(least(1e0, max(n / greatest(d, {EPS}))), 6) AS sens_max, round(least(1e0, sum(n / greatest(d, {EPS})) / (max(p3) / 3)), 6) AS sens_mean FROM {{lev_{name}}} l JOIN {{tcount}} t ON l.gid = t.gid GROUP BY l.gid")
        # Pixels without contributions show the background; those of tiles with a gaussian count, as one row a tile.
        shown = f"SELECT cam, px, py, {power.replace('{x}', '(d0 + d1 + d2)')} AS d FROM {{image{v}}}"
        blank = "" if background == "0e0" else f" UNION ALL SELECT cam, tx * {TILE}, ty * {TILE}, n * {power.replace('{x}', f'(3 * {background})')} FROM {{blank}}"
        stage(f"pd_{name}", f"SELECT p.*, CAST(floor(cam / 5) AS INT) AS batch FROM ({shown}{blank}) p")
        query(f"a03_per_tile_{name}", f"SELECT o.gid, round(least(1e0, max(n / greatest(d, {EPS}))), 6) AS sens_max, round(least(1e0, sum(n / greatest(d, {EPS})) / max(t.tiles)), 6) AS sens_mean FROM (SELECT gid, cam, floor(px / {TILE}) AS tx, floor(py / {TILE}) AS ty, sum(n) AS n FROM {{lev_{name}}} GROUP BY gid, cam, floor(px / {TILE}), floor(py / {TILE})) o JOIN (SELECT cam, floor(px / {TILE}) AS tx, floor(py / {TILE}) AS ty, sum(d) AS d FROM {{pd_{name}}} GROUP BY cam, floor(px / {TILE}), floor(py / {TILE})) a ON o.cam = a.cam AND o.tx = a.tx AND o.ty = a.ty JOIN {{tcount}} t ON o.gid = t.gid GROUP BY o.gid")
        for id_, level, key in (("a04", "image", "cam"), ("a05", "batch", "batch"), ("a06", "scene", "0")):
            query(f"{id_}_per_{level}_{name}", f"SELECT gid, round(least(1e0, max(r)), 7) AS sens_max, round(least(1e0, sum(r * k) / greatest(sum(k), 1)), 7) AS sens_mean FROM (SELECT o.gid, n / greatest(d, {EPS}) AS r, k FROM (SELECT gid, {key} AS g, sum(n) AS n, count(DISTINCT CASE WHEN n > 0 THEN cam END) AS k FROM {{lev_{name}}} GROUP BY gid{'' if key == '0' else ', ' + key}) o JOIN (SELECT {key} AS g, sum(d) AS d FROM {{pd_{name}}}{'' if key == '0' else ' GROUP BY ' + key}) a ON o.g = a.g) z GROUP BY gid")


variant("", ("c0", "c1", "c2"), "0e0")
variant("_nocolour", ("1e0", "1e0", "1e0"), "0e0")
variant("_white", ("c0", "c1", "c2"), "1e0")
query("a09_composite", "SELECT cam, px, py, round(d0, 6) AS r, round(d1, 6) AS g, round(d2, 6) AS b, round(depth, 5) AS depth, round(t, 6) AS t FROM {image}")
query("a10_pixel_denominator", "SELECT b.cam, round(w.d, 4) AS white, round(b.d, 4) AS black, round(n.d, 4) AS nocolour FROM " + " JOIN ".join(f"(SELECT cam, sum(d) AS d FROM {{{x}}} GROUP BY cam) {y}" + (f" ON b.cam = {y}.cam" if y != "b" else "") for x, y in (("pd_l1", "b"), ("pd_l1_white", "w"), ("pd_l1_nocolour", "n"))))
query("s16_depth_normalised", "SELECT cam, px, py, round((depth - lo) / (hi - lo + 1e-8), 5) AS depth FROM (SELECT cam, px, py, depth, min(depth) OVER (PARTITION BY cam) AS lo, max(depth) OVER (PARTITION BY cam) AS hi FROM {image}) z")
query("w02_prefix_contribution", "SELECT gid, round(sum(e0), 5) AS e0, round(sum(e1), 5) AS e1, round(sum(e2), 5) AS e2 FROM {eff} GROUP BY gid")
query("a08_effective_contribution", "SELECT cam, round(sum(e0 + e1 + e2), 4) AS e, count_if(e0 + e1 + e2 > 0) AS n FROM {eff} GROUP BY cam")
query("a11_no_colour", "SELECT gid, round(max(w), 6) AS sens FROM {comp} GROUP BY gid")

# All levels of a model as one table, and the coresets of each of them.
_LEVELS = [(name, level) for name, level in (("a01_per_channel", "per_channel"), ("a02_per_pixel", "per_pixel"), ("a03_per_tile", "per_tile"), ("a04_per_image", "per_image"), ("a05_per_batch", "per_batch"), ("a06_per_scene", "per_scene"))]
stage("all_levels", " UNION ALL ".join(f"SELECT gid, '{level}' AS granularity, '{norm}' AS norm, '{kind}' AS reduction, {'true' if v else 'false'} AS nocolour, sens_{kind} AS sens FROM {{{name}_{norm}{v}}}" for name, level in _LEVELS for norm in ("l1", "l2") for kind in ("max", "mean") for v in ("", "_nocolour")), cut=True)
_CHANCE = "((((gid * 1103515245 + 12345 + 7 * 7919) % 2147483648) * 1103515245 + 12345) % 2147483648)"
stage("offered", f"SELECT gid, concat(granularity, '_', norm, '_', reduction) AS g, sens FROM {{all_levels}} WHERE NOT nocolour UNION ALL SELECT gid, 'uniform', {_CHANCE} / 2147483648e0 FROM {{gauss}}")
numbered("in_turn", "offered", "g, sens DESC, gid")
# One order over all outputs; a place in an output is the place in the whole less those of the outputs before.
query("t07_all_coresets", "SELECT t.g, gid FROM {in_turn} t JOIN (SELECT g, min(rk) AS first FROM {in_turn} GROUP BY g) f ON t.g = f.g CROSS JOIN (SELECT greatest(1, RINT<0.1e0 * count(*)>) AS kept FROM {gauss}) k WHERE rk - first < kept")
# A coreset of gaussians drawn in proportion to their sensitivity per image; colours carry the weights, opacity and shape do not.
stage("g_prob", "SELECT gid, sens_max / t AS p FROM {a04_per_image_l1} CROSS JOIN (SELECT sum(sens_max) AS t FROM {a04_per_image_l1}) s", cut=True)
numbered("g_bounds", "g_prob", "gid", value="p")
stage("g_intervals", "SELECT b.gid, lo, hi, cell FROM (SELECT gid, lo, hi, CAST(floor(greatest(lo, 0e0) * n) AS INT) AS first, CAST(greatest(floor(greatest(lo, 0e0) * n), floor(hi * n)) AS INT) AS last FROM {g_bounds} CROSS JOIN (SELECT count(*) AS n FROM {g_prob}) c) b, SERIES<first;last> AS s(cell)")
stage("g_drawn", "SELECT i.gid, count(*) AS draws FROM (SELECT u, CAST(floor(u * n) AS INT) AS cell FROM {draws} CROSS JOIN (SELECT count(*) AS n FROM {g_prob}) c) d JOIN {g_intervals} i ON d.cell = i.cell AND d.u >= i.lo AND d.u < i.hi GROUP BY i.gid")
stage("g_raw", "SELECT d.gid, draws, p, draws / greatest(500 * p, 1e-12) AS w FROM {g_drawn} d JOIN {g_prob} p ON d.gid = p.gid", cut=True)
stage("g_weights", "SELECT gid, draws, least(least(w, q), 4 * m) AS w FROM {g_raw} CROSS JOIN (SELECT PCT(w, 0.999) AS q, avg(w / t) AS m FROM {g_raw} CROSS JOIN (SELECT sum(w * p) AS t FROM {g_raw}) z) c")
stage("reweighted", "SELECT g.gid, w, draws, x, y, z, logit, " + ", ".join(f"ls{k}" for k in range(3)) + ", " + ", ".join(f"q{k}" for k in range(4)) + ", " + ", ".join(f"w * dc{k} AS dc{k}" for k in range(3)) + ", " + ", ".join(f"w * sh{k} AS sh{k}" for k in range(45)) + " FROM {gauss} g JOIN {g_weights} w ON g.gid = w.gid", cut=True)
query("t04_sh_coreset", "SELECT gid, draws, round(w, 6) AS w, " + ", ".join(f"round(dc{k}, 6) AS dc{k}" for k in range(3)) + ", round(" + " + ".join(f"abs(sh{k})" for k in range(45)) + ", 5) AS rest FROM {reweighted}")
query("p30_colour_reweight", "SELECT gid, round(w, 6) AS w, " + ", ".join(f"round(sh{k}, 6) AS sh{k}" for k in (0, 14, 15, 29, 30, 44)) + " FROM {reweighted}")

# Projection of everything before a camera, as one camera at a time does it, and what its ellipses of three sigmas cover.
stage("front", f"""SELECT gid, cam, cx, cy, cz, 1 / (1 + exp(-logit)) AS alpha, rx, ry, rz, ux, uy, uz, fx, fy, fz, {FOCAL} / (cz + 1e-8) AS j0, -{FOCAL} * least({_LIM}, greatest(-{_LIM}, cx / (cz + 1e-8))) / (cz + 1e-8) AS j1,
  -{FOCAL} * least({_LIM}, greatest(-{_LIM}, cy / (cz + 1e-8))) / (cz + 1e-8) AS j2, {FOCAL} * cx / (cz + 1e-8) + 32 AS u, {FOCAL} * cy / (cz + 1e-8) + 32 AS v FROM {{seen_by}} WHERE cz > 0""", cut=True)
stage("front_rows", "SELECT gid, cam, cz, alpha, u, v, " + ", ".join(f"j0 * {a}{c} + {j} * f{c} AS {m}{c}" for m, a, j in (("a", "r", "j1"), ("b", "u", "j2")) for c in "xyz") + " FROM {front}")
stage("projected", f"SELECT r.gid, r.cam, r.cz, r.alpha, r.u, r.v, greatest(0.5e0, sqrt({_Q('a', 'a')})) AS sx, greatest(0.5e0, sqrt({_Q('b', 'b')})) AS sy FROM {{front_rows}} r JOIN {{cov}} c ON r.gid = c.gid", cut=True)
query("p50_single_projection", "SELECT gid, cam, round(u, 5) AS u, round(v, 5) AS v, round(cz, 7) AS z, round(sx, 5) AS sx, round(sy, 5) AS sy FROM {projected}")
_IN = "u + 3 * sx >= 0 AND u - 3 * sx <= 63 AND v + 3 * sy >= 0 AND v - 3 * sy <= 63"
query("f11_sigma_in_frame", f"SELECT gid, count(*) AS cameras FROM {{projected}} WHERE {_IN} GROUP BY gid")
query("j12_camera_coverage", f"SELECT cam, count(*) AS n, round(sum(alpha), 6) AS mass FROM {{projected}} WHERE {_IN} GROUP BY cam")
query("a37_pixel_coverage", "SELECT round(sum(CASE WHEN f.gid IS NULL THEN 0e0 ELSE a END) / (sum(a) + 1e-12), 8) AS weighted, round(avg(CASE WHEN f.gid IS NULL THEN 0e0 ELSE 1e0 END), 8) AS unweighted FROM (SELECT gid, 1 / (1 + exp(-logit)) AS a FROM {gauss}) g LEFT JOIN {f11_sigma_in_frame} f ON g.gid = f.gid")
