"""Small dense linear algebra on rows that Spark has already summed: planes, alignment, observability."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symmetric(upper: np.ndarray, n: int) -> np.ndarray:
    """Stack of n x n matrices from rows of their upper triangles."""
    out = np.zeros((len(upper), n, n))
    i, j = np.triu_indices(n)
    out[:, i, j] = upper
    out[:, j, i] = upper
    return out


def plane_of(cov: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """Planes from 3 x 3 covariances: normal (its largest component positive), eigenvalues, quality, radius.

    A plane's smallest eigenvalue is below ``threshold`` and apart from the middle one; points on a line or
    in one place are none. Quality falls from 1 to 0.15 as the smallest nears a quarter of the middle one.
    """
    values, vectors = np.linalg.eigh(cov)
    tol = np.maximum(1e-12, 1e-8 * np.maximum(np.abs(values[:, 2]), 1e-12))
    low, mid, high = (np.maximum(values[:, k], 0.0) for k in range(3))
    ok = (values[:, 0] >= -tol) & (values[:, 1] - values[:, 0] > tol) & (low < threshold)
    normal = vectors[:, :, 0]
    sign = np.sign(normal[np.arange(len(normal)), np.abs(normal).argmax(axis=1)])
    quality = np.maximum(1 - np.minimum(low / np.maximum(mid, tol) / 0.25, 1.0), 0.15)
    return {"is_plane": ok, "normal": normal * np.where(sign == 0, 1, sign)[:, None], "low": low, "mid": mid, "high": high, "quality": quality, "radius": np.sqrt(high)}


def fit_planes(moments: DataFrame, keys: list[str], threshold: float = 0.01) -> DataFrame:
    """Planes of groups whose moments (n, cx.., sxx..) are given: one Arrow batch of eigenproblems at a time, no shuffle."""
    kinds = ", ".join(f"{k} {moments.schema[k].dataType.simpleString()}" for k in keys)

    def fit(batches):
        for pdf in batches:
            p = plane_of(symmetric(pdf[["sxx", "sxy", "sxz", "syy", "syz", "szz"]].to_numpy(float), 3), threshold) if len(pdf) else None
            out = pdf[[*keys, "n", "cx", "cy", "cz"]].copy()
            normal = p["normal"] if p else np.empty((0, 3))
            for k, a in enumerate("xyz"):
                out[f"n{a}"] = normal[:, k]
            out["d"] = -(normal * out[["cx", "cy", "cz"]].to_numpy()).sum(axis=1)
            for c in ("low", "mid", "high", "quality", "radius", "is_plane"):
                out[c] = p[c] if p else []
            yield out

    return moments.mapInPandas(fit, f"{kinds}, n long, cx double, cy double, cz double, nx double, ny double, nz double, d double, low double, mid double, high double, quality double, radius double, is_plane boolean")


def octree_planes(points: DataFrame, voxel: float, max_layer: int, least: int, threshold: float) -> DataFrame:
    """Planes of the leaves of an octree in each voxel: what is no plane is split by octant, ``max_layer`` times.

    Each layer is one grouped sum and one join by leaf; the number of layers is the bound of the loop.
    """
    from lidarlake.operators.joins import with_voxel
    from lidarlake.plans.mapping import moments

    keys = ["vx", "vy", "vz", "path"]
    rows = with_voxel(points, voxel).withColumn("path", F.lit(""))
    for a in "xyz":
        rows = rows.withColumn(f"o{a}", (F.col(f"v{a}") + 0.5) * voxel)
    found, size = None, voxel / 4
    for layer in range(max_layer + 1):
        planes = fit_planes(moments(rows, keys).where(F.col("n") > least), keys, threshold)
        got = planes.where("is_plane")
        found = got if found is None else found.unionByName(got)
        if layer == max_layer:
            break
        rest = planes.where("not is_plane").select(*keys)
        rows = rows.join(rest, keys)
        bit = {a: F.when(F.col(a) > F.col(f"o{a}"), 1).otherwise(0) for a in "xyz"}
        rows = rows.withColumn("path", F.concat("path", (4 * bit["x"] + 2 * bit["y"] + bit["z"]).cast("string")))
        for a in "xyz":
            rows = rows.withColumn(f"o{a}", F.col(f"o{a}") + F.when(F.col(a) > F.col(f"o{a}"), size).otherwise(-size))
        size /= 2
    return found


def kabsch(cross: np.ndarray, reflect: bool = False) -> np.ndarray:
    """The rotation R that makes R a nearest to b, from the sum of b a' (3 x 3)."""
    u, _, vt = np.linalg.svd(cross)
    fix = np.diag([1.0, 1.0, 1.0 if reflect else np.sign(np.linalg.det(u @ vt)) or 1.0])
    return u @ fix @ vt


def align(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Rotation, translation and RMSE that take (ax, ay, az) to (bx, by, bz), per key: 16 sums are shuffled."""
    A, B = ("ax", "ay", "az"), ("bx", "by", "bz")
    sums = [F.count("*").alias("n")] + [F.sum(c).alias(f"s{c}") for c in A + B] + [F.sum(F.col(b) * F.col(a)).alias(f"m{b}{a}") for b in B for a in A] + [F.sum(sum((F.col(c) * F.col(c) for c in g[1:]), F.col(g[0]) * F.col(g[0]))).alias(f"q{g[0][0]}") for g in (A, B)]
    g = pairs.groupBy(*keys).agg(*sums)
    kinds = ", ".join(f"{k} {g.schema[k].dataType.simpleString()}" for k in keys)

    def solve(batches):
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                n = r["n"]
                ma, mb = np.array([r[f"s{c}"] for c in A]) / n, np.array([r[f"s{c}"] for c in B]) / n
                cross = np.array([[r[f"m{b}{a}"] for a in A] for b in B]) - n * np.outer(mb, ma)
                rot = kabsch(cross)
                var = r["qa"] - n * ma @ ma + r["qb"] - n * mb @ mb - 2 * np.trace(rot.T @ cross)
                out.append((*[r[k] for k in keys], int(n), rot.ravel().tolist(), (mb - rot @ ma).tolist(), math.sqrt(max(var, 0.0) / n)))
            yield pd.DataFrame(out, columns=[*keys, "n", "rotation", "translation", "rmse"])

    return g.mapInPandas(solve, f"{kinds}, n long, rotation array<double>, translation array<double>, rmse double")


def invert_symmetric(m: np.ndarray, floor: float = 1e-12) -> tuple[np.ndarray, np.ndarray] | None:
    """(repaired, inverse) of a symmetric matrix with eigenvalues raised to a floor; None if it is clearly negative or not finite."""
    m = 0.5 * (m + m.T)
    if not np.isfinite(m).all():
        return None
    values, vectors = np.linalg.eigh(m)
    top = max(abs(values[-1]), 1e-300)
    if values[0] < -1e-6 * top:
        return None
    values = np.maximum(values, max(floor * top, 1e-300))
    return (vectors * values) @ vectors.T, (vectors / values) @ vectors.T


def sigmoid_health(ratio: float, alpha: float, tau: float) -> float:
    f = lambda v: 1 / (1 + math.exp(-max(-40.0, min(v, 40.0))))
    low, high, r = f(-alpha * tau), f(alpha * (1 - tau)), max(0.0, min(ratio, 1.0))
    return r if high - low <= 1e-12 else max(0.0, min((f(alpha * (r - tau)) - low) / (high - low), 1.0))


def observability(information: np.ndarray, prior: np.ndarray, least: float = 0.05, alpha: float = 12.0, tau: float = 0.1, floor: float = 1e-6) -> dict | None:
    """Eigenvalues of a 6 x 6 information whitened by the prior, and how much each direction may count."""
    got = invert_symmetric(prior, floor)
    if got is None:
        return None
    low = np.linalg.cholesky(got[0])
    white = low.T @ information @ low
    values, vectors = np.linalg.eigh(0.5 * (white + white.T))
    if values[0] < -1e-9 * max(abs(values[-1]), 1.0):
        return None
    values = np.maximum(values, 0.0)
    top = values[-1]
    health = np.array([max(sigmoid_health(v / top if top > 1e-12 else 0.0, alpha, tau), v / (1 + v)) for v in values])
    factor = least + (1 - least) * np.clip(health, 0.0, 1.0)
    inv = np.linalg.inv(low)
    return {"values": values, "factors": factor, "information": inv.T @ (vectors * (factor * values)) @ vectors.T @ inv, "condition": values[0] / top if top > 1e-12 else 0.0}


def fit_rotation(pairs: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Rotation between paired rates (rows of 3 + 3): a robustly weighted fit, ``rounds`` times."""
    a, b = pairs[:, :3], pairs[:, 3:]
    w, rot = np.ones(len(a)), np.eye(3)
    for _ in range(rounds):
        rot = kabsch((b * w[:, None]).T @ a)
        r = np.linalg.norm(b - a @ rot.T, axis=1)
        w = 1 / (1 + (r / max(np.median(r), 1e-6)) ** 2)
    return rot


def icp(source: np.ndarray, target: np.ndarray, rounds: int = 30, radius: float = 1.0) -> dict:
    """Point-to-point registration of two clouds that fit one task: rotation, translation, RMSE, coverage."""
    rot, move, cells = np.eye(3), np.zeros(3), {}
    for k, c in enumerate(map(tuple, np.floor(target / radius).astype(int))):
        cells.setdefault(c, []).append(k)
    near = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
    rmse = coverage = 0.0
    for _ in range(rounds):
        now = source @ rot.T + move
        a, b = [], []
        for k, p in enumerate(now):
            c = np.floor(p / radius).astype(int)
            there = [t for d in near for t in cells.get(tuple(c + d), ())]
            if there:
                d2 = ((target[there] - p) ** 2).sum(axis=1)
                if d2.min() <= radius * radius:
                    a.append(k)
                    b.append(there[int(d2.argmin())])
        coverage = len(a) / max(1, len(source))
        if len(a) < 6:
            break
        s, t = source[a], target[b]
        rot = kabsch((t - t.mean(0)).T @ (s - s.mean(0)))
        move = t.mean(0) - rot @ s.mean(0)
        new = float(np.sqrt((((s @ rot.T + move) - t) ** 2).sum(axis=1).mean()))
        if abs(new - rmse) < 1e-12:
            rmse = new
            break
        rmse = new
    return {"rotation": rot, "translation": move, "rmse": rmse, "coverage": coverage}
