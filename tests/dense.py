"""The renderer and its six levels as dense arrays, one camera after the other: a second source for the engine's formulas."""

import math

import numpy as np

EPS = 1.1920929e-07


def scene(embedding):
    """Gaussians from rows of 64 numbers."""
    e = np.asarray(embedding, float)
    q = e[:, 55:59] / np.maximum(np.linalg.norm(e[:, 55:59], axis=1, keepdims=True), 1e-8)
    return {"xyz": 8 * e[:, :3], "dc": 4 * e[:, 3:6], "rest": 0.4 * e[:, 6:51].reshape(-1, 3, 15), "alpha": 1 / (1 + np.exp(-16 * e[:, 51])), "scale": np.exp(-2.5 + 4 * e[:, 52:55]), "q": q}


def cameras(count=25, of=25):
    out = []
    for k in range(count):
        z, t = 1 - 2 * (k + 0.5) / of, math.pi * (1 + math.sqrt(5)) * (k + 0.5)
        d = np.array([math.sqrt(1 - z * z) * math.cos(t), math.sqrt(1 - z * z) * math.sin(t), z])
        forward, right = -d, np.array([d[2], 0, -d[0]]) / math.hypot(d[0], d[2])
        out.append((np.stack([right, np.cross(right, forward), forward]), 4 * d))
    return out


def harmonics(v, degree):
    x, y, z = v.T
    rows = [np.full(len(v), 0.28209479177387814), -0.4886025119029199 * y, 0.4886025119029199 * z, -0.4886025119029199 * x]
    rows += [1.0925484305920792 * x * y, -1.0925484305920792 * y * z, 0.31539156525252005 * (2 * z * z - x * x - y * y), -1.0925484305920792 * x * z, 0.5462742152960396 * (x * x - y * y)]
    rows += [-0.5900435899266435 * y * (3 * x * x - y * y), 2.890611442640554 * x * y * z, -0.4570457994644658 * y * (4 * z * z - x * x - y * y), 0.3731763325901154 * z * (2 * z * z - 3 * x * x - 3 * y * y), -0.4570457994644658 * x * (4 * z * z - x * x - y * y), 1.445305721320277 * z * (x * x - y * y), -0.5900435899266435 * x * (x * x - 3 * y * y)]
    return np.stack(rows[: (degree + 1) ** 2], axis=1)


def levels(g, cams, degree=3, background=0.0, colour=True, norm="l1", size=64, per_batch=5):
    """{level: (max, mean)} over all gaussians."""
    n, focal, lim = len(g["alpha"]), size / 2 / math.tan(math.pi / 6), 1.3 * math.tan(math.pi / 6)
    w, x, y, z = g["q"].T
    rot = np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)], 1).reshape(-1, 3, 3)
    cov = np.einsum("nij,nj,nkj->nik", rot, g["scale"] ** 2, rot)
    py, px = (a.ravel() for a in np.mgrid[0:size, 0:size])
    power = (lambda v: v * v) if norm == "l2" else (lambda v: v)
    high = {k: np.zeros(n) for k in ("channel", "pixel", "tile")}
    total = {k: np.zeros(n) for k in ("channel", "pixel", "tile")}
    tiles_of, nums, dens, seen = np.zeros(n), [], [], []
    for r, eye in cams:
        c = (g["xyz"] - eye) @ r.T
        front = np.flatnonzero(c[:, 2] > 0.2)
        front = front[np.lexsort((front, c[front, 2]))]
        p, depth = c[front], c[front, 2] + 1e-8
        view = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
        coeffs = np.concatenate([g["dc"][front][:, :, None], g["rest"][front]], axis=2)[:, :, : (degree + 1) ** 2]
        rgb = np.maximum(0.5 + np.einsum("nck,nk->nc", coeffs, harmonics(view, degree)), 0) if colour else np.ones((len(front), 3))
        u, v = focal * p[:, 0] / depth + size / 2, focal * p[:, 1] / depth + size / 2
        jac = np.zeros((len(front), 2, 3))
        jac[:, 0, 0] = jac[:, 1, 1] = focal / depth
        jac[:, 0, 2], jac[:, 1, 2] = -focal * np.clip(p[:, 0] / depth, -lim, lim) / depth, -focal * np.clip(p[:, 1] / depth, -lim, lim) / depth
        jr = jac @ r
        s = jr @ cov[front] @ jr.transpose(0, 2, 1)
        a, b, d = s[:, 0, 0], s[:, 0, 1], s[:, 1, 1]
        det = np.maximum(a * d - b * b, 1e-12)
        radius = np.ceil(3 * np.sqrt(np.maximum((a + d) / 2 + np.sqrt(np.maximum(((a + d) ** 2) / 4 - det, 0)), 0)) + 1)
        edge = lambda m, up: np.clip(np.floor(m / 16) + up, 0, size // 16)[:, None]
        x0, x1, y0, y1 = edge(u - radius, 0), edge(u + radius, 1), edge(v - radius, 0), edge(v + radius, 1)
        on = (px // 16 >= x0) & (px // 16 < x1) & (py // 16 >= y0) & (py // 16 < y1)
        listed = on.any(0)  # a tile that no gaussian is listed for is in no sum
        dx, dy = px - u[:, None], py - v[:, None]
        q = (d / det)[:, None] * dx * dx - 2 * (b / det)[:, None] * dx * dy + (a / det)[:, None] * dy * dy
        opacity = g["alpha"][front][:, None]
        on &= (q <= 9) & (-q / 2 >= math.log(1 / 255) - np.log(np.maximum(opacity, 1e-8)))
        alpha = np.where(on, np.minimum(0.99, opacity * np.exp(-np.where(on, q, 0) / 2)), 0)
        before = np.cumprod(np.vstack([np.ones(size * size), 1 - alpha[:-1]]), axis=0)
        active = on & (before >= 1e-4)
        weight = np.where(active, alpha * before, 0)
        left = np.prod(np.where(active, 1 - alpha, 1), axis=0)
        parts = weight[:, :, None] * rgb[:, None, :]
        shown = np.clip(parts.sum(0) + left[:, None] * background, 0, 1)
        room = np.maximum(0, 1 - left * background)[:, None]
        eff = np.minimum(parts, np.maximum(0, room - (np.cumsum(parts, 0) - parts)))
        ratio = power(eff) / np.maximum(power(shown), EPS)
        num, den = power(eff.sum(2)), power(shown.sum(1))
        den = np.where(listed, den, 0)
        pixel = num / np.maximum(den, EPS)
        tile = (py // 16) * (size // 16) + px // 16
        by_tile = lambda m: np.stack([m[..., tile == t].sum(-1) for t in range((size // 16) ** 2)], -1)
        per_tile = by_tile(num) / np.maximum(by_tile(den), EPS)
        for name, most, sum_ in (("channel", ratio.max((1, 2)), ratio.sum((1, 2))), ("pixel", pixel.max(1), pixel.sum(1)), ("tile", per_tile.max(1), per_tile.sum(1))):
            high[name][front] = np.maximum(high[name][front], most)
            total[name][front] += sum_
        tiles_of[front] += ((x1 - x0) * (y1 - y0))[:, 0]
        own = np.zeros(n)
        own[front] = num.sum(1)
        nums.append(own)
        dens.append(den.sum())
        seen.append(own > 0)
    nums, dens, seen = np.array(nums), np.array(dens), np.array(seen)
    count = np.maximum(tiles_of, 1)
    out = {k: (high[k], total[k] / (count * c)) for k, c in (("channel", 768), ("pixel", 256), ("tile", 1))}
    for name, group in (("image", np.arange(len(cams))), ("batch", np.arange(len(cams)) // per_batch), ("scene", np.zeros(len(cams), int))):
        ratios, weights = [], []
        for k in np.unique(group):
            ratios.append(nums[group == k].sum(0) / max(dens[group == k].sum(), EPS))
            weights.append(seen[group == k].sum(0))
        ratios, weights = np.array(ratios), np.array(weights)
        out[name] = (ratios.max(0), (ratios * weights).sum(0) / np.maximum(weights.sum(0), 1))
    return {k: (np.minimum(a, 1), np.minimum(b, 1)) for k, (a, b) in out.items()}


def classify(xyz, dc, alpha, p):
    """(label, p_outdoor, band) of one scene for the thresholds `p`, step by step on arrays."""
    low, high = np.quantile(xyz, [p["aabb_pct_low"], p["aabb_pct_high"]], axis=0)
    mid = (low + high) / 2
    lo, hi = mid + (low - mid) * p["aabb_mul"], mid + (high - mid) * p["aabb_mul"]
    diag = max(np.linalg.norm(hi - lo), 1e-8)
    below, above = np.abs(xyz - lo), np.abs(hi - xyz)

    def band(m):
        shell, strip = ((min(p[t] * diag * m, 0.12 * diag) if m > 1 else p[t] * diag) for t in ("tau_shell_frac", "tau_topbot_frac"))
        a, b = below <= shell, above <= shell
        near = a | b
        pair = np.minimum(a.mean(0), b.mean(0))
        return {"near": near.any(1), "any": near.any(1).mean(), "two": (near.sum(1) >= 2).mean(), "planes": near.mean(0), "px": pair[0], "pz": pair[2], "top": above[:, 1] <= strip, "bottom": (below[:, 1] <= strip).mean()}

    f = band(1)
    core = ((below > p["thr_core_frac"] * diag) & (above > p["thr_core_frac"] * diag)).all(1)
    rgb = np.clip(dc + 0.5, 0, 1)
    blue, top_alpha = 0.0, 1.0
    if f["top"].any():
        t = rgb[f["top"]]
        blue, top_alpha = np.maximum(t[:, 2] - np.maximum(t[:, 0], t[:, 1]), 0).mean(), alpha[f["top"]].mean()
    gap = max(0, f["any"] - core.mean())
    pick = core if core.any() else ~f["near"]
    centre = np.sort(xyz[pick], axis=0)[(pick.sum() - 1) // 2] if pick.any() else (lo + hi) / 2
    n = p["open_bins"]
    z = 1 - 2 * (np.arange(n) + 0.5) / n
    theta = math.pi * (1 + math.sqrt(5)) * (np.arange(n) + 0.5)
    dirs = np.stack([np.sqrt(1 - z * z) * np.cos(theta), np.sqrt(1 - z * z) * np.sin(theta), z], 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        exits = np.where(np.abs(dirs) < 1e-9, np.inf, np.maximum((lo - centre) / dirs, (hi - centre) / dirs)).min(1)
    reach = np.minimum(p["open_radius_frac"] * diag, np.maximum(exits, 0))
    v = (xyz - centre)[alpha >= p["open_alpha_min"]]
    dist = np.linalg.norm(v, axis=1)
    blocked = ((dirs @ (v / np.maximum(dist, 1e-8)[:, None]).T >= math.cos(math.radians(p["open_cone_deg"]))) & (dist <= reach[:, None])).any(1)
    free, up = (~blocked).mean(), (~blocked)[dirs[:, 1] > 0].mean()
    lock = up >= 0.45 or free >= 0.45
    ratio = (hi[1] - lo[1]) / diag
    walls = lambda f: f["px"] + f["pz"] >= 0.05 or f["planes"][0] + f["planes"][2] >= 0.18
    asks = not lock and f["any"] < 0.4 and not walls(f) and up < 0.25 and free < 0.3 and blue < 0.06 and top_alpha >= 0.15 and (gap >= 0.25 or core.mean() >= 0.04 or ratio <= 0.45)
    used = 0
    if p["io_fallback"] == "force" or p["io_fallback"] == "auto" and asks:
        for k, m in enumerate((1.5, 2.0), 1):
            g = band(m)
            if g["any"] >= 0.4 or walls(g):
                f, used = g, k
                break
    top = f["top"].mean()
    hole = top < 0.08 and walls(f)
    out = 1.4 * min(1, max(0, ratio / 0.25)) * max(0, f["bottom"] - top) + 0.5 * max(0, 0.25 - f["any"]) + 0.4 * max(0, 0.12 - f["two"])
    out += (0.9 * max(0, blue) + 0.7 * max(0, 0.35 - top_alpha)) * (top >= 0.08)
    out += 0.8 * (0.7 if hole else 1) * max(0, free - 0.35) + 1.1 * (0.6 if hole else 1) * max(0, up - 0.35)
    ins = 0.9 * max(0, f["any"] - 0.28) + 0.7 * max(0, f["two"] - 0.07) + f["px"] + f["pz"] + 0.8 * min(f["planes"][0], f["planes"][2]) + 0.5 * max(0, top + f["bottom"] - 0.18) + gap + 0.35 * hole
    prob = 1 / (1 + math.exp(-2 * (out - ins)))
    label = "outdoor" if prob > 0.5 else "indoor"
    if lock and label == "indoor":
        label = "outdoor" if prob >= 0.5 else "uncertain"
    return "uncertain" if abs(prob - 0.5) < p["io_uncertain_band"] else label, prob, used
