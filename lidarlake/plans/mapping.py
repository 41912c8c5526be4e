"""Mapping: decode and quality of scans, voxels and planes, association, weights and normal equations."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from lidarlake.functions import scalar as S
from lidarlake.operators.joins import grid_neighbours, with_voxel
from lidarlake.plans.audit import r6
from lidarlake.sources.adapters import POINTS, points, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_C = F.col
BLIND, VOXEL = 0.5, 1.0
_VOXEL = "v AS (SELECT *, CAST(floor(x) AS BIGINT) AS vx, CAST(floor(y) AS BIGINT) AS vy, CAST(floor(z) AS BIGINT) AS vz FROM points)"
_R2 = "(x * x + y * y + z * z)"


def r2():
    return _C("x") * _C("x") + _C("y") * _C("y") + _C("z") * _C("z")


@query(f"""WITH {POINTS}, k AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY idx) AS n FROM points WHERE {_R2} >= 0.25)
  SELECT scan, idx, round(intensity, 6) AS intensity FROM k WHERE n % 3 = 0""")
def every_nth_sample(spark, sf_dir):
    """Every third of the valid returns of a scan, counted after the blind filter."""
    p = points(spark, sf_dir).where(r2() >= BLIND * BLIND)
    n = F.row_number().over(Window.partitionBy("scan").orderBy("idx"))
    return p.withColumn("n", n).where("n % 3 = 0").select("scan", "idx", r6(_C("intensity"), "intensity"))


@query(f"""WITH {POINTS} SELECT scan, count(*) AS n, round(avg(CASE WHEN {_R2} < 4 THEN 1.0 ELSE 0.0 END), 6) AS near_ratio, round(avg(CASE WHEN {_R2} > 16 THEN 1.0 ELSE 0.0 END), 6) AS far_ratio,
  round(avg(intensity), 6) AS intensity_mean,
  round(greatest(0.4 * least(count(*) / 3000.0, 1.0) + 0.4 * least(avg(CASE WHEN {_R2} >= 0.25 THEN 1.0 ELSE 0.0 END) / 0.5, 1.0)
    + 0.2 * avg(least(intensity / 40.0, 1.0) * CASE WHEN intensity > 60 THEN 60.0 / intensity ELSE 1.0 END), 0.05), 6) AS quality FROM points GROUP BY scan""")
def scan_quality_stats(spark, sf_dir):
    i = _C("intensity")
    score = F.least(i / 40.0, F.lit(1.0)) * F.when(i > 60, 60.0 / i).otherwise(1.0)
    flag = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    quality = 0.4 * F.least(F.count("*") / 3000.0, F.lit(1.0)) + 0.4 * F.least(flag(r2() >= 0.25) / 0.5, F.lit(1.0)) + 0.2 * F.avg(score)
    return points(spark, sf_dir).groupBy("scan").agg(
        F.count("*").alias("n"), r6(flag(r2() < 4), "near_ratio"), r6(flag(r2() > 16), "far_ratio"), r6(F.avg("intensity"), "intensity_mean"), r6(F.greatest(quality, F.lit(0.05)), "quality"))


@query(f"""WITH {POINTS} SELECT scan, idx, round(offset_ms, 6) AS offset_ms, CAST(row_number() OVER (PARTITION BY scan ORDER BY offset_ms, idx) AS INTEGER) AS place
  FROM (SELECT scan, idx, least(greatest(offset_ms, 0), 60) AS offset_ms FROM points WHERE offset_ms BETWEEN -0.001 AND 60.001)""")
def scan_time_window(spark, sf_dir):
    """Returns inside the scan's time window (a tolerance of 1e-3 ms), clamped to it and put in order of time."""
    p = points(spark, sf_dir).where("offset_ms between -0.001 and 60.001").withColumn("offset_ms", S.clamp(_C("offset_ms"), 0.0, 60.0))
    place = F.row_number().over(Window.partitionBy("scan").orderBy("offset_ms", "idx"))
    return p.select("scan", "idx", r6(_C("offset_ms"), "offset_ms"), place.alias("place"))


@query(f"""WITH {POINTS}, n AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, lead(z) OVER w - z AS dz FROM points WINDOW w AS (PARTITION BY scan ORDER BY idx))
  SELECT scan, idx, round(sqrt(dx * dx + dy * dy + dz * dz), 6) AS gap, coalesce(dx * dx + dy * dy + dz * dz > 1.0, false) AS jump FROM n""")
def neighbour_gaps(spark, sf_dir):
    """Distance to the next return of the line, and where it jumps."""
    w = Window.partitionBy("scan").orderBy("idx")
    d = [F.lead(a).over(w) - _C(a) for a in "xyz"]
    return points(spark, sf_dir).withColumns(dict(zip(("dx", "dy", "dz"), d))).select("scan", "idx", r6(S.norm(_C("dx"), _C("dy"), _C("dz")), "gap"), F.coalesce(S.norm(_C("dx"), _C("dy"), _C("dz")) > 1.0, F.lit(False)).alias("jump"))


@query(f"""WITH {POINTS}, {_VOXEL} SELECT vx, vy, vz, count(*) AS n, CAST(((vx + vy + vz) + 100000) % 3 AS BIGINT) AS colour FROM v GROUP BY vx, vy, vz""")
def voxel_counts(spark, sf_dir):
    v = with_voxel(points(spark, sf_dir), VOXEL).groupBy("vx", "vy", "vz").agg(F.count("*").alias("n"))
    return v.withColumn("colour", (_C("vx") + _C("vy") + _C("vz") + 100000) % 3)


_AXES = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]


def moments(df, keys: list[str]):
    """Count, centroid and the six population covariances: plain sums, combined before the shuffle."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"c{a}") for a in "xyz"], *[F.avg(_C(a) * _C(b)).alias(f"m{a}{b}") for a, b in _AXES])
    return g.select(*keys, "n", "cx", "cy", "cz", *[(_C(f"m{a}{b}") - _C(f"c{a}") * _C(f"c{b}")).alias(f"s{a}{b}") for a, b in _AXES])


@query(f"""WITH {POINTS}, {_VOXEL} SELECT vx, vy, vz, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz,
  {', '.join(f'round(avg({a} * {b}) - avg({a}) * avg({b}), 6) + 0.0 AS s{a}{b}' for a, b in _AXES)} FROM v GROUP BY vx, vy, vz HAVING count(*) >= 2""")
def voxel_moments(spark, sf_dir):
    m = moments(with_voxel(points(spark, sf_dir), VOXEL), ["vx", "vy", "vz"]).where("n >= 2")
    return m.select("vx", "vy", "vz", "n", *[r6(_C(c), c) for c in m.columns[4:7]], *[(F.round(_C(c), 6) + 0.0).alias(c) for c in m.columns[7:]])


@query(f"""WITH {POINTS}, {_VOXEL} SELECT idx, CAST(4 * (CASE WHEN x > vx + 0.5 THEN 1 ELSE 0 END) + 2 * (CASE WHEN y > vy + 0.5 THEN 1 ELSE 0 END) + (CASE WHEN z > vz + 0.5 THEN 1 ELSE 0 END) AS INTEGER) AS octant FROM v""")
def octant_codes(spark, sf_dir):
    """4x + 2y + z of a point's side of its voxel's centre; on the centre is the low side."""
    v = with_voxel(points(spark, sf_dir), VOXEL)
    bit = lambda a: F.when(_C(a) > (_C(f"v{a}") + 0.5) * VOXEL, 1).otherwise(0)
    return v.select("idx", (4 * bit("x") + 2 * bit("y") + bit("z")).alias("octant"))


_BINS = ", ".join(f"({k}, {b[0] / sum(c * c for c in b) ** 0.5!r}, {b[1] / sum(c * c for c in b) ** 0.5!r}, {b[2] / sum(c * c for c in b) ** 0.5!r})" for k, b in enumerate(S.NORMAL_BINS))


@query(f"""WITH {POINTS}, bins(b, bx, by_, bz) AS (VALUES {_BINS}), s AS (SELECT scan, idx, b, abs(x * bx + y * by_ + z * bz) AS score FROM points, bins),
  best AS (SELECT scan, idx, b, row_number() OVER (PARTITION BY idx ORDER BY round(score, 9) DESC, b) AS k FROM s), c AS (SELECT scan, b, count(*) AS n FROM best WHERE k = 1 GROUP BY scan, b)
  SELECT scan, max(n) AS dominant, CAST(sum(n) AS BIGINT) AS total, round(max(n)::DOUBLE / sum(n), 6) AS ratio FROM c GROUP BY scan HAVING sum(n) >= 10""")
def dominant_normal_bin(spark, sf_dir):
    """The share of the fullest of 13 direction bins, per scan."""
    p = points(spark, sf_dir).select("scan", S.normal_bin([_C("x"), _C("y"), _C("z")]).alias("bin")).groupBy("scan", "bin").agg(F.count("*").alias("n"))
    g = p.groupBy("scan").agg(F.max("n").alias("dominant"), F.sum("n").alias("total")).where("total >= 10")
    return g.withColumn("ratio", F.round(_C("dominant") / _C("total"), 6))


@query(f"""WITH {POINTS}, q AS (SELECT idx, intensity AS i, sqrt({_R2}) AS r, least(vn / 5.0, 1.0) AS d FROM (SELECT *, count(*) OVER (PARTITION BY floor(x), floor(y), floor(z)) AS vn FROM points))
  SELECT idx, round(least(greatest(0.45 * (least(i / 40.0, 1.0) * CASE WHEN i > 60 THEN 60.0 / i ELSE 1.0 END) + 0.25 * CASE WHEN r > 4 THEN 4.0 / r ELSE 1.0 END + 0.30 * d, 0.05), 1.0), 6) AS w FROM q""")
def return_quality_weight(spark, sf_dir):
    p = with_voxel(points(spark, sf_dir), VOXEL)
    w = S.return_weight(_C("intensity"), F.sqrt(r2()), _C("n") / 5.0, 40.0, 60.0, 4.0, 0.05)
    counts = p.groupBy("vx", "vy", "vz").agg(F.count("*").alias("n"))  # counted before it meets the points: a full voxel is one row
    return p.join(counts, ["vx", "vy", "vz"]).select("idx", r6(w, "w"))


@query(f"""WITH {POINTS}, c AS (SELECT idx, offset_ms, intensity, abs(z) / 0.5 AS n, abs(z) / sqrt({_R2}) AS cosine FROM points)
  SELECT idx, round(greatest(1 / (1 + (n / 1.5) * (n / 1.5)), 0.1), 6) AS cauchy, round(greatest(CASE WHEN n <= 1.5 THEN 1.0 ELSE 1.5 / n END, 0.1), 6) AS huber,
  round(greatest(pow(least(cosine, 1.0), 1.5), 0.2), 6) AS incidence,
  round(CASE WHEN n <= 0.5 THEN 0.0 ELSE ((n - 0.5) / 0.5) * ((n - 0.5) / 0.5) / (1 + ((n - 0.5) / 0.5) * ((n - 0.5) / 0.5)) * (0.5 * least(cosine, 1.0) + 0.5 * least(intensity / 255.0, 1.0)) END, 6) AS dynamic,
  round(greatest(1 / (1 + 4.0 * pow(least(intensity / 255.0, 1.0) * (0.35 + 0.65 * least(greatest((100.0 - greatest(offset_ms, 0)) / 100.0, 0.0), 1.0)), 2)), 0.2), 6) AS distortion FROM c""")
def robust_kernel_weights(spark, sf_dir):
    p = points(spark, sf_dir).withColumns({"n": F.abs("z") / 0.5, "cosine": F.abs("z") / F.sqrt(r2())})
    return p.select(
        "idx", r6(S.robust_weight(_C("n"), "cauchy", 1.5, 0.1), "cauchy"), r6(S.robust_weight(_C("n"), "huber", 1.5, 0.1), "huber"), r6(S.incidence_weight(_C("cosine"), 1.5, 0.2), "incidence"),
        r6(S.dynamic_conflict(_C("n"), _C("cosine"), _C("intensity") / 255.0, 1.0), "dynamic"), r6(S.distortion_weight(_C("intensity") / 255.0, _C("offset_ms"), F.lit(100.0), 4.0, 0.2), "distortion"))


def write_gate(matched, residual, ret, quality, density, dynamic, pose_risk, write_risk, stable, *, min_score=0.35, min_return=0.20, sigma=3.0, unmatched_risk=0.45, max_dynamic=0.80):
    """(score, rejected): whether a point may enter the map. Matched points are judged on their residual,
    structure and motion; unmatched ones on the risk of the frame."""
    ratio = F.greatest(residual, F.lit(0.0)) / sigma
    hit = (0.40 / (1 + ratio * ratio) + 0.20 * ret + 0.20 * (0.5 * S.clamp(quality, 0.0, 1.0) + 0.5 * S.clamp(density, 0.0, 1.0)) + 0.20 * (1 - dynamic)) * (1 - 0.25 * pose_risk)
    miss = ret * (1 - 0.50 * write_risk) * (1 - 0.60 * dynamic)
    reject_hit = ((residual > 1.5 * sigma) & (hit < min(min_score + 0.10, 1.0))) | (hit < min_score)
    conflict = (miss < F.least(min_score + 0.25 + 0.25 * write_risk, F.lit(1.0))) | (write_risk > 0.75)
    reject_miss = F.when(stable, conflict).otherwise((write_risk > unmatched_risk) & (miss < min(min_score + 0.15, 1.0)))
    rejected = F.when(matched, reject_hit).otherwise(reject_miss) | (ret < min_return) | (dynamic > max_dynamic)
    return F.when(matched, hit).otherwise(miss), rejected


@query(f"""WITH {POINTS}, g AS (SELECT idx, scan % 2 = 0 AS matched, abs(x) AS residual, least(intensity / 100.0, 1.0) AS ret, least(abs(y) / 5.0, 1.0) AS quality, least(abs(z) / 5.0, 1.0) AS density,
    least(abs(x * y) / 10.0, 1.0) AS dyn, (scan % 5) / 5.0 AS risk, scan % 3 = 0 AS stable FROM points),
  s AS (SELECT *, CASE WHEN matched THEN (0.40 / (1 + (residual / 3.0) * (residual / 3.0)) + 0.20 * ret + 0.20 * (0.5 * quality + 0.5 * density) + 0.20 * (1 - dyn)) * (1 - 0.25 * risk)
    ELSE ret * (1 - 0.50 * risk) * (1 - 0.60 * dyn) END AS score FROM g)
  SELECT idx, round(score, 6) AS score, (CASE WHEN matched THEN (residual > 4.5 AND score < 0.45) OR score < 0.35 WHEN stable THEN score < least(0.60 + 0.25 * risk, 1.0) OR risk > 0.75
    ELSE risk > 0.45 AND score < 0.50 END) OR ret < 0.20 OR dyn > 0.80 AS rejected FROM s""")
def map_write_gate(spark, sf_dir):
    p = points(spark, sf_dir)
    one = F.lit(1.0)
    risk = (_C("scan") % 5) / 5.0
    score, rejected = write_gate(
        _C("scan") % 2 == 0, F.abs("x"), F.least(_C("intensity") / 100.0, one), F.least(F.abs("y") / 5.0, one), F.least(F.abs("z") / 5.0, one), F.least(F.abs(_C("x") * _C("y")) / 10.0, one), risk, risk, _C("scan") % 3 == 0)
    return p.select("idx", r6(score, "score"), rejected.alias("rejected"))


_H = ["y * 0.6 - z * 0.8", "z * 0.0 - x * 0.6", "x * 0.8", "0.0 * x", "0.8 + 0.0 * x", "0.6 + 0.0 * x"]


def normal_equations(df, keys: list[str], rows: list, weight, residual):
    """The 21 different sums of H' W H and the 6 of H' W z: one partial aggregation, no matrix in a shuffle."""
    n = len(rows)
    sums = [F.sum(rows[i] * weight * rows[j]).alias(f"a{i}{j}") for i in range(n) for j in range(i, n)]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *sums, *[F.sum(rows[i] * weight * residual).alias(f"b{i}") for i in range(n)])


@query(f"""WITH {POINTS}, h AS (SELECT scan, {', '.join(f'{e} AS h{k}' for k, e in enumerate(_H))}, 1 / (1 + z * z) AS w, x * 0.1 AS r FROM points)
  SELECT scan, count(*) AS n, {', '.join(f'round(sum(h{i} * w * h{j}), 5) + 0.0 AS a{i}{j}' for i in range(6) for j in range(i, 6))}, {', '.join(f'round(sum(h{i} * w * r), 5) + 0.0 AS b{i}' for i in range(6))} FROM h GROUP BY scan""")
def normal_equation_sums(spark, sf_dir):
    p = points(spark, sf_dir)
    s = normal_equations(p, ["scan"], [F.expr(e) for e in _H], 1 / (1 + _C("z") * _C("z")), _C("x") * 0.1)
    return s.select("scan", "n", *[(F.round(_C(c), 5) + 0.0).alias(c) for c in s.columns[2:]])


@query(f"""WITH {POINTS}, a AS (SELECT * FROM points WHERE scan % 2 = 0), b AS (SELECT * FROM points WHERE scan % 2 = 1),
  d AS (SELECT a.idx, b.idx AS nn, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM a, b)
  SELECT idx, arg_min(nn, round(d2, 9) + nn * 1e-15) AS nn, round(min(d2), 6) AS d2 FROM d WHERE d2 <= 2.25 GROUP BY idx""")
def grid_nn_1nn(spark, sf_dir):
    """The nearest target within 1.5 of each query: 27-cell equi-join, exact because a cell is as wide as the radius."""
    p = points(spark, sf_dir)
    pairs = grid_neighbours(p.where("scan % 2 = 0").select("idx", "x", "y", "z"), p.where("scan % 2 = 1").select(_C("idx").alias("nn"), "x", "y", "z"), 1.5)
    return pairs.groupBy("idx").agg(F.min_by("nn", F.struct("d2", "nn")).alias("nn"), r6(F.min("d2"), "d2"))


@query(f"""WITH {POINTS} SELECT CAST(floor(x / 2) AS BIGINT) AS gx, CAST(floor(y / 2) AS BIGINT) AS gy, arg_max(idx, {{'s': -({_R2}), 'i': idx}}) AS nearest, arg_max(idx, {{'s': intensity, 'i': -idx}}) AS brightest FROM points GROUP BY 1, 2""")
def top1_per_cell(spark, sf_dir):
    """Per image cell: the nearest point (of equals the later) and the best score (of equals the first)."""
    p = points(spark, sf_dir).groupBy(F.floor(_C("x") / 2).alias("gx"), F.floor(_C("y") / 2).alias("gy"))
    return p.agg(F.max_by("idx", F.struct(-r2(), _C("idx"))).alias("nearest"), F.max_by("idx", F.struct(_C("intensity"), -_C("idx"))).alias("brightest"))


@query(f"""WITH {POINTS}, {_VOXEL}, g AS (SELECT vx, vy, vz, count(*) AS n, round(avg(intensity), 6) AS priority FROM v GROUP BY vx, vy, vz),
  c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY priority DESC, vx, vy, vz ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
  SELECT vx, vy, vz, priority, CAST(least(n, 25 - before) AS BIGINT) AS promoted FROM c WHERE before < 25""")
def budgeted_promotion(spark, sf_dir):
    """Voxels by priority until a budget of 25 points is used up; the last one only in part.

    A top-k report: at most 25 voxels can be promoted, so only the best 25 meet in one task."""
    g = with_voxel(points(spark, sf_dir), VOXEL).groupBy("vx", "vy", "vz").agg(F.count("*").alias("n"), r6(F.avg("intensity"), "priority"))
    best = g.orderBy(F.desc("priority"), "vx", "vy", "vz").limit(25)
    w = Window.orderBy(F.desc("priority"), "vx", "vy", "vz").rowsBetween(Window.unboundedPreceding, -1)
    c = best.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where("before < 25")
    return c.select("vx", "vy", "vz", "priority", F.least(_C("n"), 25 - _C("before")).alias("promoted"))


@query(f"""WITH {POINTS} SELECT idx, CAST(floor(255 * r + 1e-9) AS INTEGER) AS red, CAST(floor(255 * g + 1e-9) AS INTEGER) AS green, CAST(floor(255 * b + 1e-9) AS INTEGER) AS blue FROM (SELECT idx,
   CASE WHEN v < 0.3747 THEN 0.0 WHEN v < 0.6253 THEN (v - 0.3747) / (0.6253 - 0.3747) WHEN v < 0.8758 THEN 1.0 ELSE 1 - (v - 0.8758) * (1 - 0.504) / (1 - 0.8758) END AS r,
   CASE WHEN v < 0.1242 THEN 0.0 WHEN v < 0.3747 THEN (v - 0.1242) / (0.3747 - 0.1242) WHEN v < 0.6253 THEN 1.0 WHEN v < 0.8758 THEN (0.8758 - v) / (0.8758 - 0.6253) ELSE 0.0 END AS g,
   CASE WHEN v < 0.1242 THEN 0.504 + (1 - 0.504) / 0.1242 * v WHEN v < 0.3747 THEN 1.0 WHEN v < 0.6253 THEN (0.6253 - v) / (0.6253 - 0.3747) ELSE 0.0 END AS b
  FROM (SELECT idx, least(greatest(intensity / 100.0, 0), 1) AS v FROM points))""")
def jet_colours(spark, sf_dir):
    r, g, b = S.jet(_C("intensity") / 100.0)
    return points(spark, sf_dir).select("idx", r.alias("red"), g.alias("green"), b.alias("blue"))


#: Observations of a block: two blocks of a point meet in one task.
PATCH_BLOCK, PATCH_SIZE = 1000, 64


def patches(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select(_C("label").alias("point_id"), _C("vec_id").alias("obs"), _C("embedding").alias("patch"))
    return p.where("point_id is not null and obs is not null")


def in_blocks(p):
    """Rows of ``p`` for each two blocks (i, j) of a point's observations, and for each block with itself."""
    blocks = p.groupBy("point_id").agg(F.ceil(F.count("*") / PATCH_BLOCK).cast("long").alias("blocks"))
    p = p.join(blocks, "point_id").withColumn("block", F.pmod(F.xxhash64("obs"), _C("blocks")))
    p = p.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), _C("blocks") - 1)))
    return p.select("point_id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "obs", "patch").groupBy("point_id", "i", "j")


def odd_blocks(p):
    """As ``in_blocks``, but only pairs of blocks with ``odd`` observations in the first: those have blocks of their own."""
    count = lambda x: F.ceil(F.count_if(x) / PATCH_BLOCK).cast("long")
    blocks = p.groupBy("point_id").agg(count(_C("odd")).alias("odds"), count(~_C("odd")).alias("evens")).where("odds > 0")
    at = lambda n: F.pmod(F.xxhash64("obs"), F.greatest(n, F.lit(1)))
    p = p.join(blocks, "point_id").withColumn("block", F.when(_C("odd"), at(_C("odds"))).otherwise(_C("odds") + at(_C("evens"))))
    upto = F.when(_C("odd"), _C("odds") + _C("evens")).otherwise(_C("odds"))
    p = p.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), upto - 1)))
    return p.select("point_id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "obs", "patch").groupBy("point_id", "i", "j")


def _matrix(patch: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of each patch (0 where it has none) and which are there: patches may be null, shorter, longer or lack values."""
    p = pa.concat_arrays(patch.chunks) if patch.num_chunks else pa.array([], patch.type)
    sizes, flat = pc.fill_null(pc.list_value_length(p), 0).to_numpy(zero_copy_only=False), p.flatten()
    at = np.repeat(np.arange(len(p)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values = np.zeros((len(p), max(PATCH_SIZE, sizes.max(initial=0))))
    there = np.zeros(values.shape, bool)
    values[at], there[at] = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)
    return values, there


def _ncc(t: pa.Table) -> pa.Table:
    """All pairs of two blocks (or inside one) of a point's observations, each once, the smaller obs first; null without common values."""
    obs, block = t["obs"].to_numpy(), t["block"].to_numpy()
    i, j = t["i"][0].as_py(), t["j"][0].as_py()
    d, there = _matrix(t["patch"])
    d -= d.sum(axis=1, keepdims=True) / np.maximum(there.sum(axis=1, keepdims=True), 1)
    d[~there] = 0.0
    s = (d * d).sum(axis=1)
    a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
    x, y = np.nonzero(obs[a][:, None] < obs[b] if i == j else obs[a][:, None] != obs[b])
    d, there = d[:, :PATCH_SIZE], there[:, :PATCH_SIZE].astype(np.float64)
    none = None if there.all() else (there[a] @ there[b].T)[x, y] == 0
    ncc = (d[a] @ d[b].T)[x, y]
    x, y = a[x], b[y]
    ncc = np.round(ncc / (np.sqrt(s[x] * s[y]) + 1e-10), 6) + 0.0
    point = pa.array(np.full(len(x), t["point_id"][0].as_py(), np.int32))
    return pa.table({"point_id": point, "obs": np.minimum(obs[x], obs[y]), "obs2": np.maximum(obs[x], obs[y]), "ncc": pa.array(ncc, pa.float64(), mask=none)})


def _ssd(t: pa.Table) -> pa.Table:
    """For each observation of two blocks (or one) how many of the other have values in common with it, and the sum of squared differences."""
    obs, block = t["obs"].to_numpy(), t["block"].to_numpy()
    i, j = t["i"][0].as_py(), t["j"][0].as_py()
    values, there = (x[:, :PATCH_SIZE] for x in _matrix(t["patch"]))
    pairs, total = np.zeros(len(obs), np.int64), np.zeros(len(obs))
    b = np.flatnonzero(block == j)
    with np.errstate(invalid="ignore", over="ignore"):
        for k in np.flatnonzero(block == i):
            common = there[k] & there[b]
            d = np.where(common, values[k] - values[b], 0.0)
            some = common.any(axis=1) & (obs[b] != obs[k])
            d = np.where(some, (d * d).sum(axis=1), 0.0)
            pairs[k] += some.sum()
            total[k] += d.sum()
            if i != j:
                pairs[b] += some
                total[b] += d
    point = pa.array(np.full(len(obs), t["point_id"][0].as_py(), np.int32))
    return pa.table({"point_id": point, "obs": obs, "pairs": pairs, "total": total})


_PATCH = "p AS (SELECT label AS point_id, vec_id AS obs, embedding::DOUBLE[] AS e FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) WHERE k <= 8)"


@query(f"""WITH {_PATCH}, c AS (SELECT point_id, obs, list_transform(e, lambda v: v - list_avg(e)) AS d FROM p)
  SELECT a.point_id, a.obs, b.obs AS obs2, round(list_sum(list_transform(range(1, 65), lambda i: a.d[i] * b.d[i])) / (sqrt(list_sum(list_transform(a.d, lambda v: v * v)) * list_sum(list_transform(b.d, lambda v: v * v))) + 1e-10), 6) AS ncc
  FROM c a JOIN c b ON a.point_id = b.point_id AND a.obs < b.obs""")
def patch_ncc_pairs(spark, sf_dir):
    """Normalised cross correlation of all of a point's observations, two by two.

    Quadratic in a point's observations, as its result is; a point's blocks meet two by two, so no task has more than two."""
    return in_blocks(patches(spark, sf_dir)).applyInArrow(_ncc, "point_id int, obs long, obs2 long, ncc double")


@query(f"""WITH {_PATCH}, s AS (SELECT a.point_id, a.obs, avg(list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i])))) AS ssd FROM p a JOIN p b ON a.point_id = b.point_id AND a.obs <> b.obs GROUP BY ALL)
  SELECT point_id, arg_min(obs, {{'s': round(ssd, 9), 'o': obs}}) AS best, round(min(ssd), 6) AS ssd FROM s GROUP BY point_id""")
def patch_ssd_best_ref(spark, sf_dir):
    """The observation with the least mean squared difference to all of the point's others.

    From sums over the point (count, patches, squares): no pairs. A patch differs by (n - m) q - 2 s (S - s) + m (Q - q).
    Patches that lack values or hold infinite ones meet all of the point's, block by block; a null patch differs by nothing."""
    e = [F.get("patch", F.lit(k)).cast("double") for k in range(PATCH_SIZE)]
    p = patches(spark, sf_dir).withColumn("q", reduce(lambda a, x: a + x * x, e, F.lit(0.0)))
    p = p.withColumn("odd", ~F.coalesce(_C("q") < float("inf"), F.lit(False)))
    there = p.where("patch is not null")
    sums = [F.sum(x).alias(f"s{k}") for k, x in enumerate(e)]
    o = there.where("not odd").groupBy("point_id", "obs").agg(F.count("*").alias("m"), F.sum("q").alias("q"), *sums)
    o = o.select("point_id", "obs", "m", "q", F.array(*[f"s{k}" for k in range(PATCH_SIZE)]).alias("s"))
    everything = o.groupBy("point_id").agg(F.sum("m").alias("n"), F.sum("q").alias("all_q"), *[F.sum(_C("s")[k]).alias(f"s{k}") for k in range(PATCH_SIZE)])
    everything = everything.select("point_id", "n", "all_q", F.array(*[f"s{k}" for k in range(PATCH_SIZE)]).alias("all_s"))
    cross = F.aggregate(F.zip_with("s", "all_s", lambda a, b: a * (b - a)), F.lit(0.0), lambda s, v: s + v)
    ssd = (_C("n") - _C("m")) * _C("q") - 2 * cross + _C("m") * (_C("all_q") - _C("q"))
    whole = o.join(everything, "point_id").select("point_id", "obs", (_C("m") * (_C("n") - _C("m"))).alias("pairs"), ssd.alias("total"))
    odd = odd_blocks(there).applyInArrow(_ssd, "point_id int, obs long, pairs long, total double")
    none = p.where("patch is null").select("point_id", "obs", F.lit(0).cast("long").alias("pairs"), F.lit(0.0).alias("total"))
    both = whole.unionByName(odd).unionByName(none).groupBy("point_id", "obs").agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total"))
    both = both.select("point_id", "obs", F.when(_C("pairs") > 0, _C("total") / _C("pairs")).alias("ssd"))
    best = F.min_by("obs", F.struct(_C("ssd").isNull(), F.round("ssd", 9), "obs")).alias("best")
    both = both.groupBy("point_id").agg(best, r6(F.min("ssd"), "ssd"), F.count("*").alias("n"))
    return both.where("n > 1").drop("n")


@query(f"""WITH {POINTS} SELECT idx, {', '.join(f'round({e}, 6) + 0.0 AS w{a}' for a, e in (('x', 'x * cos(0.3) - y * sin(0.3) + 0.18'), ('y', 'x * sin(0.3) + y * cos(0.3) - 0.06'), ('z', 'z + 0.04')))} FROM points""")
def rigid_transform(spark, sf_dir):
    """Body to world: a rotation of 0.3 about z and a translation."""
    r = S.so3_exp(F.lit(0.0), F.lit(0.0), F.lit(0.3))
    t, p = (0.18, -0.06, 0.04), [_C(a) for a in "xyz"]
    moved = [reduce(lambda s, k: s + r[3 * i + k] * p[k], range(3), F.lit(t[i])) for i in range(3)]
    return points(spark, sf_dir).select("idx", *[(F.round(m, 6) + 0.0).alias(f"w{a}") for a, m in zip("xyz", moved)])
