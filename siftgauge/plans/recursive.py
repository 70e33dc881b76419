"""DuckDB SQL of the queries that Spark runs as loops, as recursive statements."""

from __future__ import annotations

from . import catalog, geometry, scene  # noqa: F401  (their stages)

SIZE = 24
_STEP = "(VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) s(a, b, c)"
_AT = "n.ix = r.ix + s.a AND n.iy = r.iy + s.b AND n.iz = r.iz + s.c"
_INDEX = f"((ix * {SIZE} + iy) * {SIZE} + iz)"


def _with(stages: list[str], parts: str, text: str) -> str:
    """A recursive statement whose first tables are catalog stages."""
    head = ", ".join(f"{s} AS ({catalog.sql(s)})" for s in stages)
    return f"WITH RECURSIVE {head}, {parts} {text}"


_GRID = f"grid AS (SELECT a AS ix, b AS iy, c AS iz FROM range(0, {SIZE}) x(a), range(0, {SIZE}) y(b), range(0, {SIZE}) z(c)), free AS (SELECT * FROM grid g WHERE NOT EXISTS (SELECT 1 FROM dil d WHERE d.ix = g.ix AND d.iy = g.iy AND d.iz = g.iz))"
_OPEN = f"opened AS (SELECT ix, iy, iz FROM free WHERE 0 IN (ix, iy, iz) OR {SIZE - 1} IN (ix, iy, iz) UNION SELECT n.ix, n.iy, n.iz FROM opened r, {_STEP} JOIN free n ON {_AT})"


def _parts(cells: str, into: str) -> str:
    """Cells with the least index of their component: smaller indices spread until none spreads further."""
    return f"""{into}(ix, iy, iz, label) USING KEY (ix, iy, iz) AS (SELECT ix, iy, iz, {_INDEX} FROM {cells}
  UNION SELECT q.ix, q.iy, q.iz, q.label FROM (SELECT n.ix, n.iy, n.iz, min(r.label) AS label FROM {into} r, {_STEP} JOIN {cells} n ON {_AT} GROUP BY n.ix, n.iy, n.iz) q JOIN recurring.{into} o ON o.ix = q.ix AND o.iy = q.iy AND o.iz = q.iz WHERE q.label < o.label)"""


def _distances(cells: str, sources: str) -> str:
    """Steps from the sources, found ring by ring."""
    return f"""dist(ix, iy, iz, dist) USING KEY (ix, iy, iz) AS (SELECT ix, iy, iz, 0 FROM {sources}
  UNION SELECT q.ix, q.iy, q.iz, q.dist FROM (SELECT n.ix, n.iy, n.iz, min(r.dist) + 1 AS dist FROM dist r, {_STEP} JOIN {cells} n ON {_AT} GROUP BY n.ix, n.iy, n.iz) q LEFT JOIN recurring.dist o ON o.ix = q.ix AND o.iy = q.iy AND o.iz = q.iz WHERE o.ix IS NULL)"""


_SPREAD = _distances("dil", "(SELECT * FROM dil WHERE ix <= 6) q")
_SIDES = " ".join(f"LEFT JOIN dist {n} ON " + " AND ".join(f"{n}.i{c} = d.i{c}" + (f" {s} 1" if c == axis else "") for c in "xyz") for axis in "xyz" for s, n in (("+", f"u{axis}"), ("-", f"l{axis}")))
_GRADIENT = f"SELECT d.ix, d.iy, d.iz, d.dist, " + ", ".join(f"(coalesce(u{a}.dist, d.dist) - coalesce(l{a}.dist, d.dist)) / 2.0 AS g{a}" for a in "xyz") + f" FROM dist d {_SIDES}"


def farthest(source: str, k: int, into: str) -> str:
    """`into` (rank, id): farthest points of `source` (id, x, y, z); each step has all points with their distances."""
    return f"""walk_{into} AS (SELECT 0 AS step, p.id, p.x, p.y, p.z, (p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y) + (p.z - f.z) * (p.z - f.z) AS d, f.id AS pick, 1e0 AS far FROM {source} p, (SELECT * FROM {source} ORDER BY id LIMIT 1) f
  UNION ALL SELECT step + 1, id, x, y, z, least(d, (x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)), pid, pd FROM (SELECT *, first_value(id) OVER w AS pid, first_value(x) OVER w AS px, first_value(y) OVER w AS py, first_value(z) OVER w AS pz, first_value(d) OVER w AS pd FROM walk_{into} WHERE step < {k - 1} WINDOW w AS (ORDER BY d DESC, id)) q WHERE pd > 0),
{into} AS (SELECT DISTINCT step AS rank, pick AS id FROM walk_{into})"""


def discs(source: str, order: str, square: str, into: str) -> str:
    """`into` (id): points of `source` accepted one after the other in `order` unless one accepted before is too near."""
    return f"""line_{into} AS (SELECT id, x, y, z, row_number() OVER (ORDER BY {order}) AS rk, {square} AS sq FROM {source}),
taken_{into} AS (SELECT CAST(0 AS BIGINT) AS rk, CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE, z DOUBLE)[]) AS kept UNION ALL SELECT p.rk, CASE WHEN len(list_filter(t.kept, lambda a: (a.x - p.x) * (a.x - p.x) + (a.y - p.y) * (a.y - p.y) + (a.z - p.z) * (a.z - p.z) < p.sq)) = 0 THEN list_append(t.kept, {{'id': CAST(p.id AS BIGINT), 'x': p.x, 'y': p.y, 'z': p.z}}) ELSE t.kept END FROM taken_{into} t JOIN line_{into} p ON p.rk = t.rk + 1),
{into} AS (SELECT unnest(kept).id AS id FROM taken_{into} WHERE rk = (SELECT count(*) FROM {source}))"""


def cover(rounds: int) -> str:
    """The candidate of each round by newly covered weight, one table after the other."""
    parts = ["left0 AS (SELECT CAST(eye AS BIGINT) AS cand, gid AS item, alpha AS w FROM vis)"]
    for r in range(rounds):
        parts.append(f"best{r} AS (SELECT CAST({r} AS BIGINT) AS round, cand, sum(w) AS gain FROM left{r} GROUP BY cand HAVING sum(w) > 0 ORDER BY round(sum(w), 9) DESC, cand LIMIT 1)")
        parts.append(f"left{r + 1} AS (SELECT * FROM left{r} l WHERE NOT EXISTS (SELECT 1 FROM vis v JOIN best{r} b ON v.eye = b.cand WHERE v.gid = l.item) AND l.cand NOT IN (SELECT cand FROM best{r}))")
    return ", ".join(parts)


_POINTS = "points AS (SELECT gid AS id, x, y, z FROM pts)"
_DIAGONAL = "(SELECT 0.0064 * ((max(x) - min(x)) * (max(x) - min(x)) + (max(y) - min(y)) * (max(y) - min(y)) + (max(z) - min(z)) * (max(z) - min(z))) FROM box_points)"
CHANCE = "((((id * 1103515245 + 12345 + 7 * 7919) % 2147483648) * 1103515245 + 12345) % 2147483648)"
ORACLES = {
    "i03_flood_fill": _with(["dil"], f"{_GRID}, {_OPEN}", "SELECT f.ix, f.iy, f.iz, o.ix IS NULL AS interior FROM free f LEFT JOIN opened o ON f.ix = o.ix AND f.iy = o.iy AND f.iz = o.iz"),
    "i04_components": _with(["dil"], _GRID + ", " + _parts("free", "parts"), "SELECT CAST(label AS BIGINT) AS label, count(*) AS cells, min(ix) AS x0, max(ix) AS x1 FROM parts GROUP BY label").replace("free AS (SELECT * FROM grid g WHERE NOT EXISTS", "free AS (SELECT * FROM grid g WHERE EXISTS"),
    "i05_distance_field": _with(["dil"], _SPREAD, "SELECT * FROM dist"),
    "i06_gradient": _with(["dil"], _SPREAD, _GRADIENT),
    "f09_point_in_closed_roi": _with(["dil", "p25_eye_voxels"], f"{_GRID}, {_OPEN}, {_parts('free', 'parts')}", "SELECT eye, f.ix IS NOT NULL AND o.ix IS NULL AS interior, CASE WHEN f.ix IS NOT NULL AND o.ix IS NULL THEN label END AS label FROM p25_eye_voxels e LEFT JOIN free f ON f.ix = e.ix AND f.iy = e.iy AND f.iz = e.iz LEFT JOIN opened o ON o.ix = e.ix AND o.iy = e.iy AND o.iz = e.iz LEFT JOIN parts p ON p.ix = e.ix AND p.iy = e.iy AND p.iz = e.iz"),
    "p46_boundary_distance": _with(["dil", "box", "p25_eye_voxels"], _GRID + ", " + _distances("grid", "dil"), f"SELECT eye, round(dist * ((hix - lox) + (hiy - loy) + (hiz - loz)) / 3 / {SIZE - 1}, 6) AS d FROM p25_eye_voxels e JOIN dist d ON d.ix = e.ix AND d.iy = e.iy AND d.iz = e.iz CROSS JOIN box"),
    "t10_farthest_points": _with(["pts"], f"{_POINTS}, {farthest('points', 192, 'far')}", "SELECT * FROM far"),
    "t11_poisson_discs": _with(["pts"], f"{_POINTS}, {discs('points', CHANCE + ', id', '0.8 * 0.8', 'thin')}", "SELECT * FROM thin"),
    "i10_targets": _with(["pts", "box_points"], f"{_POINTS}, {farthest('points', 48, 'far')}, every AS (SELECT p.id, x, y, z FROM points p JOIN far f ON p.id = f.id UNION ALL SELECT id, x, y, z FROM box_points), {discs('every', 'id', _DIAGONAL, 'thin')}", "SELECT e.id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM every e JOIN thin t ON e.id = t.id"),
    "u04_greedy_gain": _with(["vis"], cover(6), " UNION ALL ".join(f"SELECT round, cand, round(gain, 6) AS gain FROM best{r}" for r in range(6))),
}
