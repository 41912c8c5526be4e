"""Retrieval and upkeep of maps: rays, visibility, buckets, eviction, merging, paths and expiry."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from lidarlake.functions import scalar as S
from lidarlake.operators.joins import with_voxel
from lidarlake.plans.audit import r6
from lidarlake.plans.planner import _EVIDENCE, NOW, SIZE, evidence, voxel_states
from lidarlake.sources.adapters import DIAG, POINTS, diagnostics, points

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


@query(f"""WITH {_EVIDENCE}, r AS (SELECT idx, x, y, z, sqrt(x * x + y * y + z * z) AS d FROM points WHERE idx % 5 = 0), s AS (SELECT *, unnest(range(30)) AS k FROM r WHERE d > 1e-6),
  c AS (SELECT idx, k, CAST(floor(x / d * (0.1 + 0.2 * k) / 2.0) AS BIGINT) AS vx, CAST(floor(y / d * (0.1 + 0.2 * k) / 2.0) AS BIGINT) AS vy, CAST(floor(z / d * (0.1 + 0.2 * k) / 2.0) AS BIGINT) AS vz FROM s)
  SELECT idx, CAST(min(k) AS INTEGER) AS step FROM c JOIN st ON c.vx = st.vx AND c.vy = st.vy AND c.vz = st.vz WHERE state = 'OCCUPIED' GROUP BY idx""")
def raycast_first_hit(spark, sf_dir):
    """The first occupied voxel along the ray of each point, 30 samples a ray; samples meet voxels by equi-join."""
    d = S.norm(_C("x"), _C("y"), _C("z"))
    p = points(spark, sf_dir).withColumn("d", d).where(S.finite(_C("d")) & (_C("d") > 1e-6))  # else no direction; floor(NaN) would be voxel 0
    s = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(29))))
    reach = (2 * _C("k") + 1) / F.lit(10.0)  # 0.1 + 0.2 k would be off by rounding, which puts samples on a face into the next voxel
    s = s.select("idx", "k", *[F.floor(_C(a) / _C("d") * reach / SIZE).alias(f"v{a}") for a in "xyz"])
    occupied = voxel_states(evidence(spark, sf_dir), NOW).where("state = 'OCCUPIED'").select("vx", "vy", "vz")
    return s.join(occupied, ["vx", "vy", "vz"]).groupBy("idx").agg(F.min("k").alias("step"))


@query(f"""WITH {_EVIDENCE}, o AS (SELECT (vx + 0.5) * 2 AS ox, (vy + 0.5) * 2 AS oy, (vz + 0.5) * 2 AS oz FROM st WHERE state = 'OCCUPIED')
  SELECT CAST(h AS INTEGER) AS band, CAST(round(min(ox * ox + oy * oy), 6) AS DOUBLE) AS d2, round(arg_min(atan2(oy, ox), ox * ox + oy * oy + 1e-9 * (atan2(oy, ox) + 4)), 4) AS yaw FROM o, (SELECT unnest([-2, 0, 2]) AS h) WHERE abs(oz - h) <= 1.5 AND ox * ox + oy * oy >= 1e-6 GROUP BY h""")
def nearest_occupied_in_band(spark, sf_dir):
    """Nearest occupied voxel around the origin in each band of height, and the way to it."""
    o = voxel_states(evidence(spark, sf_dir), NOW).where("state = 'OCCUPIED'").select(*[((_C(f"v{a}") + 0.5) * SIZE).alias(f"o{a}") for a in "xyz"])
    o = o.withColumns({"d2": _C("ox") * _C("ox") + _C("oy") * _C("oy"), "yaw": F.atan2("oy", "ox")}).where("d2 >= 1e-6")
    o = o.withColumn("band", F.explode(F.array(*map(F.lit, (-2, 0, 2))))).where(F.abs(_C("oz") - _C("band")) <= 1.5)
    return o.groupBy("band").agg(r6(F.min("d2"), "d2"), F.round(F.min_by("yaw", F.struct("d2", "yaw")), 4).alias("yaw"))


@query(f"""WITH {POINTS}, v AS (SELECT *, CAST(floor(x / 2.0) AS BIGINT) AS vx, CAST(floor(y / 2.0) AS BIGINT) AS vy, CAST(floor(z / 2.0) AS BIGINT) AS vz FROM points)
  SELECT idx FROM v m WHERE scan >= 5 AND EXISTS (SELECT 1 FROM v s WHERE s.scan < 5 AND s.vx = m.vx AND s.vy = m.vy AND s.vz = m.vz)""")
def visible_map_points(spark, sf_dir):
    """Map points in voxels that the scan touches: a semi-join on distinct voxels."""
    p = with_voxel(points(spark, sf_dir), SIZE)
    touched = p.where("scan < 5").select("vx", "vy", "vz").distinct()
    return p.where("scan >= 5").join(touched, ["vx", "vy", "vz"], "left_semi").select("idx")


@query(f"""WITH {POINTS} SELECT CAST(floor(x / 4.0) AS BIGINT) AS vx, count(*) AS n, round(sum(intensity), 5) AS score, array_to_string(list_slice(list(idx ORDER BY idx), 1, 3), ',') AS first_points FROM points GROUP BY 1""")
def candidate_buckets(spark, sf_dir):
    """Count, sum and the first three points (by arrival) of each bucket; a bucket's least ids, not its list, are kept."""
    p = points(spark, sf_dir).withColumn("vx", F.floor(_C("x") / 4.0))
    sums = p.groupBy("vx").agg(F.count("*").alias("n"), F.round(F.sum("intensity"), 5).alias("score"))
    k = F.row_number().over(Window.partitionBy("vx").orderBy("idx"))
    first = p.withColumn("k", k).where("k <= 3").groupBy("vx").agg(F.array_join(F.array_sort(F.collect_list("idx")).cast("array<string>"), ",").alias("first_points"))
    return sums.join(first, "vx")


@query(f"""WITH {_EVIDENCE}, s AS (SELECT vx, vy, vz, round(0.70 * ((vx + 0.5) * 2 * (vx + 0.5) * 2 + (vy + 0.5) * 2 * (vy + 0.5) * 2) / 64.0 + 0.30 * least(greatest(0, coalesce(28.0 - lf, 20.0)), greatest(0, coalesce(28.0 - lo, 20.0))) / 20.0, 9) AS score FROM ev)
  SELECT vx, vy, vz, round(score, 6) AS score FROM s ORDER BY s.score DESC, vx, vy, vz LIMIT 20""")
def overflow_eviction(spark, sf_dir):
    """The 20 voxels to give up first: far and old. A top-k report, so each task keeps 20."""
    e = evidence(spark, sf_dir)
    age = lambda c: F.greatest(F.lit(0.0), F.coalesce(NOW - _C(c), F.lit(20.0)))
    far = ((_C("vx") + 0.5) * SIZE) ** 2 + ((_C("vy") + 0.5) * SIZE) ** 2
    e = e.withColumn("score", F.round(0.70 * far / 64.0 + 0.30 * F.least(age("last_free"), age("last_occupied")) / 20.0, 9))
    return e.orderBy(F.desc("score"), "vx", "vy", "vz").limit(20).select("vx", "vy", "vz", r6(_C("score"), "score"))


@query(f"""WITH {POINTS}, v AS (SELECT scan % 2 AS side, CAST(floor(x / 2.0) AS BIGINT) AS vx, CAST(floor(y / 2.0) AS BIGINT) AS vy, count(*) AS n FROM points GROUP BY ALL)
  SELECT vx, vy, n, 'candidate' AS origin FROM v WHERE side = 1 UNION ALL SELECT vx, vy, n, 'formal' FROM v f WHERE side = 0 AND NOT EXISTS (SELECT 1 FROM v c WHERE c.side = 1 AND c.vx = f.vx AND c.vy = f.vy)""")
def map_merge_replace(spark, sf_dir):
    """Recovered voxels replace formal ones that they overlap; the rest of the map stays."""
    v = points(spark, sf_dir).groupBy((_C("scan") % 2).alias("side"), F.floor(_C("x") / SIZE).alias("vx"), F.floor(_C("y") / SIZE).alias("vy")).agg(F.count("*").alias("n"))
    new, old = v.where("side = 1").drop("side"), v.where("side = 0").drop("side")
    return new.withColumn("origin", F.lit("candidate")).unionByName(old.join(new, ["vx", "vy"], "left_anti").withColumn("origin", F.lit("formal")))


@query(f"""WITH {POINTS}, m AS (SELECT scan, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM points GROUP BY scan)
  SELECT p.scan, count(*) AS n, count(CASE WHEN abs(x - cx) <= 2 AND abs(y - cy) <= 2 AND abs(z - cz) <= 2 THEN 1 END) AS kept FROM points p JOIN m ON p.scan = m.scan GROUP BY p.scan""")
def sliding_map(spark, sf_dir):
    """What stays when the map moves to each scan's middle and drops all beyond half its width."""
    p = points(spark, sf_dir)
    m = p.groupBy("scan").agg(*[F.avg(a).alias(f"c{a}") for a in "xyz"])
    inside = (F.abs(_C("x") - _C("cx")) <= 2) & (F.abs(_C("y") - _C("cy")) <= 2) & (F.abs(_C("z") - _C("cz")) <= 2)
    return p.join(m, "scan").groupBy("scan").agg(F.count("*").alias("n"), F.count(F.when(inside, 1)).alias("kept"))


@query(f"""WITH {POINTS}, g AS (SELECT *, idx - row_number() OVER (PARTITION BY scan, intensity > 30 ORDER BY idx) AS island, row_number() OVER (PARTITION BY scan ORDER BY idx) AS k FROM points),
  h AS (SELECT scan, intensity, idx, k - row_number() OVER (PARTITION BY scan, intensity > 30 ORDER BY idx) AS island, intensity > 30 AS bright FROM g)
  SELECT scan, min(idx) AS first_idx, count(*) AS n, round(avg(intensity), 6) AS mean FROM h WHERE bright GROUP BY scan, island HAVING count(*) >= 2""")
def surface_runs(spark, sf_dir):
    """Runs of bright returns along a line (islands by the difference of two row numbers) and their means."""
    w = Window.partitionBy("scan").orderBy("idx")
    p = points(spark, sf_dir).withColumns({"bright": _C("intensity") > 30})
    p = p.withColumns({"k": F.row_number().over(w), "j": F.row_number().over(Window.partitionBy("scan", "bright").orderBy("idx"))}).withColumn("island", _C("k") - _C("j"))
    return p.where("bright").groupBy("scan", "island").agg(F.min("idx").alias("first_idx"), F.count("*").alias("n"), r6(F.avg("intensity"), "mean")).where("n >= 2").drop("island")


@query(f"""WITH {DIAG}, f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY stamp, row_id) AS k FROM diag) SELECT run, round(avg(metric), 6) AS mean, count(*) AS samples FROM f WHERE k <= 20 GROUP BY run HAVING count(*) = 20""")
def init_running_mean(spark, sf_dir):
    """The mean of a run's first 20 samples; runs that have fewer are not initialised."""
    k = F.row_number().over(Window.partitionBy("run").orderBy("stamp", "row_id"))
    return diagnostics(spark, sf_dir).withColumn("k", k).where("k <= 20").groupBy("run").agg(r6(F.avg("metric"), "mean"), F.count("*").alias("samples")).where("samples = 20")


@query(f"""WITH {POINTS}, c AS (SELECT scan, CASE WHEN abs(z) / sqrt(x * x + y * y + z * z) >= 0.866 THEN 'ground' WHEN abs(z) / sqrt(x * x + y * y + z * z) <= 0.5 THEN 'facade' ELSE 'other' END AS class, x * 0.1 AS r FROM points)
  SELECT scan, class, count(*) AS n, round(avg(r), 6) AS mean, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive, round(avg(CASE WHEN abs(r) > 0.3 THEN 1.0 ELSE 0.0 END), 6) AS bad, round(sqrt(avg(r * r)), 6) AS rms FROM c GROUP BY scan, class""")
def class_residuals(spark, sf_dir):
    """Residuals by the class of their surface: signed mean, share of positive and of bad ones, RMS."""
    cosine = F.abs("z") / S.norm(_C("x"), _C("y"), _C("z"))
    p = points(spark, sf_dir).select("scan", F.when(cosine >= 0.866, "ground").when(cosine <= 0.5, "facade").otherwise("other").alias("class"), (_C("x") * 0.1).alias("r"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return p.groupBy("scan", "class").agg(F.count("*").alias("n"), r6(F.avg("r"), "mean"), r6(share(_C("r") > 0), "positive"), r6(share(F.abs("r") > 0.3), "bad"), r6(F.sqrt(F.avg(_C("r") * _C("r"))), "rms"))


@query(f"""WITH {POINTS} SELECT scan, round(count(DISTINCT floor(x) * 1000 + floor(y)) / 400.0, 6) AS coverage FROM points GROUP BY scan""")
def grid_coverage(spark, sf_dir):
    cells = points(spark, sf_dir).groupBy("scan").agg(F.countDistinct(F.floor("x") * 1000 + F.floor("y")).alias("n"))
    return cells.select("scan", F.round(_C("n") / 400.0, 6).alias("coverage"))


@query(f"""WITH s AS (SELECT CAST(k AS INTEGER) AS k, CAST(i AS INTEGER) AS i, k * {math.pi / 4!r} + 0.1 AS yaw, i / 10.0 AS t FROM (SELECT unnest(range(8)) AS k), (SELECT unnest(range(11)) AS i)),
  d AS (SELECT *, yaw - 0.5 - 2 * pi() * floor((yaw - 0.5 + pi()) / (2 * pi())) AS turn FROM s), w AS (SELECT *, 0.5 + t * turn AS a FROM d)
  SELECT k, i, round(3.0 * cos(yaw) * t, 6) + 0.0 AS px, round(3.0 * sin(yaw) * t, 6) + 0.0 AS py, round(a - 2 * pi() * floor((a + pi()) / (2 * pi())), 6) AS heading FROM w""")
def path_interpolation(spark, sf_dir):
    """Straight ways to eight goals in ten steps; the heading turns the short way round."""
    s = spark.range(8).select(_C("id").cast("int").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(10))).alias("i")).withColumns({"yaw": _C("k") * (math.pi / 4) + 0.1, "t": _C("i") / 10.0})
    heading = S.wrap_angle(0.5 + _C("t") * S.wrap_angle(_C("yaw") - 0.5))
    return s.select("k", "i", (F.round(3.0 * F.cos("yaw") * _C("t"), 6) + 0.0).alias("px"), (F.round(3.0 * F.sin("yaw") * _C("t"), 6) + 0.0).alias("py"), r6(heading, "heading"))


@query(f"""WITH {DIAG}, e AS (SELECT run, row_id, mode, stamp, metric, CASE WHEN row_id % 3 = 0 THEN 0.0 ELSE metric * 1000 END AS duration, lead(stamp) OVER (PARTITION BY run ORDER BY stamp, row_id) AS n FROM diag)
  SELECT row_id, CASE WHEN duration = 0 THEN n WHEN n IS NULL THEN stamp + duration ELSE least(n, stamp + duration) END AS until FROM e""")
def intent_expiry(spark, sf_dir):
    """Until when each intent holds: to its end, or the next one's begin; duration 0 never ends by itself."""
    d = diagnostics(spark, sf_dir).withColumns({"duration": F.when(_C("row_id") % 3 == 0, 0.0).otherwise(_C("metric") * 1000), "n": F.lead("stamp").over(Window.partitionBy("run").orderBy("stamp", "row_id"))})
    return d.select("row_id", F.when(_C("duration") == 0, _C("n")).otherwise(F.least("n", _C("stamp") + _C("duration"))).alias("until"))


@query(f"""WITH {POINTS} SELECT idx, round(x * x * 4e-4 / (x * x + y * y + z * z) + pow(sin(radians(0.05)), 2) * (y * y + z * z), 12) AS cxx, round(x * y / (x * x + y * y + z * z) * 4e-4 - pow(sin(radians(0.05)), 2) * x * y, 12) AS cxy FROM points""")
def beam_covariances(spark, sf_dir):
    c = S.beam_covariance([_C("x"), _C("y"), _C("z")], 0.02, 0.05)
    return points(spark, sf_dir).select("idx", F.round(c[0], 12).alias("cxx"), F.round(c[1], 12).alias("cxy"))
