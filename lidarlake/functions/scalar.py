"""Scalar column functions: ranges, angles, distances, rotations, weights and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float


def col(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def finite(x: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def clamp(x: Num, low: Num, high: Num) -> Column:
    return F.greatest(col(low), F.least(col(x), col(high)))


def wrap_angle(a: Column) -> Column:
    """To [-pi, pi]; both ends stay as they are."""
    turned = a - 2 * math.pi * F.floor((a + math.pi) / (2 * math.pi))
    return F.when(F.abs(a) <= math.pi, a).when((a > 0) & (turned == -math.pi), F.lit(math.pi)).otherwise(turned)


def norm(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def point_segment_distance(p: list[Column], a: list[Column], b: list[Column]) -> Column:
    ab = [y - x for x, y in zip(a, b)]
    ap = [y - x for x, y in zip(a, p)]
    length = sum((x * x for x in ab[1:]), ab[0] * ab[0])
    dot = sum((x * y for x, y in zip(ab[1:], ap[1:])), ab[0] * ap[0])
    t = F.when(length <= 1e-12, F.lit(0.0)).otherwise(clamp(dot / length, 0.0, 1.0))
    return norm(*[x - t * y for x, y in zip(ap, ab)])


def yaw_of(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.atan2(2.0 * (w * z + x * y), 1.0 - 2.0 * (y * y + z * z))


def quaternion_of_yaw(yaw: Column) -> list[Column]:
    return [F.lit(0.0), F.lit(0.0), F.sin(yaw / 2), F.cos(yaw / 2)]


def rotation_of(x: Column, y: Column, z: Column, w: Column) -> list[Column]:
    """Row-major rotation of a quaternion of any length above 0."""
    n = norm(x, y, z, w)
    x, y, z, w = x / n, y / n, z / n, w / n
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]


def so3_exp(x: Column, y: Column, z: Column) -> list[Column]:
    """Row-major rotation of a rotation vector; a series below theta^2 = 1e-8, never the bare identity."""
    t2 = x * x + y * y + z * z
    t = F.sqrt(t2)
    a = F.when(t2 < 1e-8, 1 - t2 / 6).otherwise(F.sin(t) / t)
    b = F.when(t2 < 1e-8, 0.5 - t2 / 24).otherwise((1 - F.cos(t)) / t2)
    return [
        1 - b * (y * y + z * z), b * x * y - a * z, b * x * z + a * y,
        b * x * y + a * z, 1 - b * (x * x + z * z), b * y * z - a * x,
        b * x * z - a * y, b * y * z + a * x, 1 - b * (x * x + y * y)]


def so3_log(r: list[Column], small: float = 1e-3) -> list[Column]:
    trace = r[0] + r[4] + r[8]
    theta = F.when(trace > 3 - 1e-6, F.lit(0.0)).otherwise(F.acos(clamp((trace - 1) / 2, -1.0, 1.0)))
    k = F.when(F.abs(theta) < small, F.lit(0.5)).otherwise(0.5 * theta / F.sin(theta))
    return [k * (r[7] - r[5]), k * (r[2] - r[6]), k * (r[3] - r[1])]


def euler_of(r: list[Column]) -> list[Column]:
    """Roll, pitch, yaw (ZYX), with yaw 0 where pitch is a right angle."""
    flat = F.sqrt(r[0] * r[0] + r[3] * r[3])
    lock = flat < 1e-6
    roll = F.when(lock, F.atan2(-r[5], r[4])).otherwise(F.atan2(r[7], r[8]))
    return [roll, F.atan2(-r[6], flat), F.when(lock, F.lit(0.0)).otherwise(F.atan2(r[3], r[0]))]


def angle_between_deg(a: list[Column], b: list[Column]) -> Column:
    dot = sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])
    return F.degrees(F.acos(clamp(dot / (norm(*a) * norm(*b)), -1.0, 1.0)))


def beam_covariance(p: list[Column], range_sigma: float, angle_deg: float) -> list[Column]:
    """Row-major covariance of a beam's end: range variance along it, angular variance times range across it."""
    r = norm(*p)
    along, across = range_sigma * range_sigma, math.sin(math.radians(angle_deg)) ** 2
    short = F.coalesce(r <= 1e-9, F.lit(True)) | ~finite(r)
    out = []
    for i in range(3):
        for j in range(3):
            dd = p[i] / r * p[j] / r
            out.append(F.when(short, F.lit(max(along, 1e-12) * (i == j))).otherwise(along * dd + across * r * r * (float(i == j) - dd)))
    return out


# ---- weights -----------------------------------------------------------------------------------------


def sigmoid_health(ratio: Column, alpha: float, tau: float) -> Column:
    """Logistic of a ratio about ``tau``, scaled so that 0 and 1 stay themselves."""
    logistic = lambda v: 1 / (1 + math.exp(-max(-40.0, min(v, 40.0))))
    low, high = logistic(-alpha * tau), logistic(alpha * (1 - tau))
    r = clamp(ratio, 0.0, 1.0)
    if high - low <= 1e-12:
        return r
    v = 1 / (1 + F.exp(-clamp(alpha * (r - tau), -40.0, 40.0)))
    return clamp((v - low) / (high - low), 0.0, 1.0)


def return_weight(intensity: Column, distance: Column, density: Column, intensity_ref: float, saturation_ref: float, range_ref: float, least: float = 0.0, has_intensity: bool = True) -> Column:
    """0.45 intensity + 0.25 range + 0.30 density; without an intensity channel the others share its part."""
    ref, far = max(intensity_ref, 1e-3), max(range_ref, 1e-3)
    i = F.when(finite(intensity), F.greatest(intensity, F.lit(0.0))).otherwise(0.0)
    si = F.least(i / ref, F.lit(1.0))
    if saturation_ref > ref:
        si = F.when(i > saturation_ref, si * clamp(saturation_ref / F.greatest(i, F.lit(1e-3)), 0.0, 1.0)).otherwise(si)
    sr = F.when(~finite(distance), 0.0).when(distance > far, far / distance).otherwise(1.0)
    sd = F.when(finite(density), clamp(density, 0.0, 1.0)).otherwise(0.0)
    w = 0.45 * si + 0.25 * sr + 0.30 * sd if has_intensity else (0.25 * sr + 0.30 * sd) / 0.55
    return clamp(w, least, 1.0)


def dynamic_conflict(residual: Column, quality: Column, density: Column, sigma: float) -> Column:
    """x^2 / (1 + x^2) beyond half of ``sigma``, times how sure the plane is."""
    s = max(sigma, 1e-3)
    x = (F.greatest(residual, F.lit(0.0)) - 0.5 * s) / max(0.5 * s, 1e-3)
    structure = 0.5 * clamp(quality, 0.0, 1.0) + 0.5 * clamp(density, 0.0, 1.0)
    return F.when(x <= 0, 0.0).otherwise(clamp(x * x / (1 + x * x) * structure, 0.0, 1.0))


def robust_weight(normalized: Column, kind: str = "cauchy", delta: float = 1.0, least: float = 0.0) -> Column:
    d = max(delta, 1e-3)
    n = F.abs(normalized)
    w = F.when(n <= d, 1.0).otherwise(d / F.greatest(n, F.lit(1e-6))) if kind == "huber" else 1 / (1 + (n / d) * (n / d))
    return clamp(w, min(max(least, 0.0), 1.0), 1.0)


def incidence_weight(cosine: Column, power: float, least: float) -> Column:
    return F.greatest(F.pow(clamp(F.abs(cosine), 0.0, 1.0), F.lit(max(power, 0.1))), F.lit(min(max(least, 0.0), 1.0)))


def distortion_weight(risk: Column, offset: Column, span: Column, gain: float, least: float) -> Column:
    """Points early in a scan of much motion count less."""
    r = clamp(risk, 0.0, 1.0)
    left = clamp((span - F.greatest(offset, F.lit(0.0))) / span, 0.0, 1.0)
    local = F.when(span > 1e-4, r * (0.35 + 0.65 * left)).otherwise(r)
    return clamp(1 / (1 + max(gain, 0.0) * local * local), min(max(least, 0.01), 1.0), 1.0)


def balance_weight(bin_count: Column, total: Column, fraction: float, least: float) -> Column:
    target = F.greatest(F.lit(1.0), F.ceil(fraction * total).cast("double"))
    w = clamp(target / bin_count, min(max(least, 0.01), 1.0), 1.0)
    return F.when((total < 10) | (bin_count <= target), 1.0).otherwise(w)


def jet(v: Column) -> list[Column]:
    """Red, green, blue 0-255 of a value 0-1: blue, cyan, yellow, red, each cut to an integer."""
    # fixed values: where the ramps meet, and the dark ends
    a, b, c, d, dark = 0.1242, 0.3747, 0.6253, 0.8758, 0.504
    v = clamp(v, 0.0, 1.0)
    red = F.when(v < b, 0.0).when(v < c, (v - b) / (c - b)).when(v < d, 1.0).otherwise(1 - (v - d) * (1 - dark) / (1 - d))
    green = F.when(v < a, 0.0).when(v < b, (v - a) / (b - a)).when(v < c, 1.0).when(v < d, (d - v) / (d - c)).otherwise(0.0)
    blue = F.when(v < a, dark + (1 - dark) / a * v).when(v < b, 1.0).when(v < c, (c - v) / (c - b)).otherwise(0.0)
    return [F.floor(255 * x + 1e-9).cast("int") for x in (red, green, blue)]


#: Directions of surface normals, before they are normalised (fixed values).
NORMAL_BINS = ((1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, -1, 0), (1, 0, 1), (1, 0, -1), (0, 1, 1), (0, 1, -1), (1, 1, 1), (1, 1, -1), (1, -1, 1), (-1, 1, 1))


def normal_bin(n: list[Column]) -> Column:
    """The direction nearest to a normal of either sign; of equals the first."""
    best, where = None, None
    for k, b in enumerate(NORMAL_BINS):
        score = F.abs(sum((x * float(c) for x, c in zip(n[1:], b[1:])), n[0] * float(b[0]))) / math.sqrt(sum(c * c for c in b))
        if best is None:
            best, where = score, F.lit(k)
        else:
            where, best = F.when(score > best, k).otherwise(where), F.greatest(score, best)
    return where
