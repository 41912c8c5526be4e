"""The estimator's joins and diagnostics: points against planes, weights, structure of normals, line features, observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lidarlake.functions import scalar as S
from lidarlake.functions.eigen import VALUES, VECTOR
from lidarlake.operators.joins import with_voxel
from lidarlake.plans.audit import r6
from lidarlake.plans.catalog import Catalog, run_steps, steps_sql
from lidarlake.plans.mapping import moments
from lidarlake.sources.adapters import DIAG, POINTS, diagnostics, points

_catalog = Catalog()
query, QUERIES, SQL = _catalog.query, _catalog.queries, _catalog.sql
_C = F.col

# ---- planes of voxels, and points against them ---------------------------------------------------------

#: Edge of a map voxel; a plane needs LEAST points and a least eigenvalue under FLAT; acceptance in deviations.
EDGE, LEAST, FLAT, SIGMA = 4.0, 4, 6.0, 3.0
#: The two lower eigenvalues of a plane must be so far apart; else (points on a line, or one point) it has no normal.
APART = 1e-9
#: Plane quality: 1 - l0 / l1 / 0.25, at least 0.15 (fixed values).
_PLANE = [*VALUES, *VECTOR, ("d", "-(nx * cx + ny * cy + nz * cz)"), ("radius", "sqrt(greatest(l2, 0.0))"), ("quality", "greatest(1 - least(l0 / greatest(l1, 1e-12) / 0.25, 1.0), 0.15)")]
_AXES = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
_PLANES_SQL = f"""v AS (SELECT *, CAST(floor(x / {EDGE}) AS BIGINT) AS vx, CAST(floor(y / {EDGE}) AS BIGINT) AS vy, CAST(floor(z / {EDGE}) AS BIGINT) AS vz FROM points),
  m AS (SELECT vx, vy, vz, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, {", ".join(f"avg({a} * {b}) - avg({a}) * avg({b}) AS s{a}{b}" for a, b in _AXES)} FROM v GROUP BY vx, vy, vz),
  planes AS (SELECT vx, vy, vz, n, cx, cy, cz, l0, l1, l2, nx, ny, nz, d, radius, quality, n >= {LEAST} AND l0 < {FLAT} AND l1 - l0 > {APART} AS is_plane FROM {steps_sql("m", _PLANE)})"""


def planes(cloud: DataFrame) -> DataFrame:
    """A row for each voxel with points: its moments' plane in closed form, and whether it is flat enough."""
    out = run_steps(moments(with_voxel(cloud, EDGE), ["vx", "vy", "vz"]), _PLANE)
    return out.select("vx", "vy", "vz", "n", "cx", "cy", "cz", "l0", "l1", "l2", "nx", "ny", "nz", "d", "radius", "quality", ((_C("n") >= LEAST) & (_C("l0") < FLAT) & (_C("l1") - _C("l0") > APART)).alias("is_plane"))


@query(f"""WITH {POINTS}, {_PLANES_SQL} SELECT vx, vy, vz, n, round(l0, 5) + 0.0 AS l0, round(l1, 5) AS l1, round(l2, 5) AS l2, round(quality, 5) AS quality, is_plane FROM planes WHERE n >= 3""")
def voxel_planes(spark, sf_dir):
    return planes(points(spark, sf_dir)).where("n >= 3").select("vx", "vy", "vz", "n", (F.round("l0", 5) + 0.0).alias("l0"), *[F.round(c, 5).alias(c) for c in ("l1", "l2", "quality")], "is_plane")


def measured(pairs: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """Rows of a point and a plane: signed distance, deviation, whether the pair is accepted, probability.

    The deviation has the beam's part (range and direction) and the plane's (uncertainty of normal and centre, from its
    eigenvalues); a point counts within three radii of the centre, in the plane, and within ``sigma`` deviations."""
    return run_steps(pairs, _measure(sigma))


def _measure(sigma: float) -> list[tuple[str, str]]:
    return [
        ("signed", "nx * x + ny * y + nz * z + d"),
        ("from_centre", "(x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)"),
        ("in_plane", "sqrt(greatest(from_centre - signed * signed, 0.0))"),
        ("variance", "0.0004 + 0.000001 * (x * x + y * y + z * z) + greatest(l0, 0.0) / n * (1 + from_centre / greatest(l1, 1e-6))"),
        ("accepted", f"in_plane <= 3 * radius AND abs(signed) < {sigma} * sqrt(variance)"),
        ("probability", "exp(-0.5 * signed * signed / variance) / sqrt(variance)"),
    ]


_PAIR = "idx, x, y, z, v.vx, v.vy, v.vz, n, cx, cy, cz, l0, l1, l2, nx, ny, nz, d, radius"


@query(f"""WITH {POINTS}, {_PLANES_SQL}, pairs AS (SELECT {_PAIR} FROM v JOIN planes p ON v.vx = p.vx AND v.vy = p.vy AND v.vz = p.vz WHERE is_plane)
  SELECT idx, round(abs(signed), 5) AS residual, round(sqrt(variance), 5) AS deviation, accepted, round(probability, 4) AS probability FROM {steps_sql("pairs", _measure(SIGMA))}""")
def point_plane_residuals(spark, sf_dir):
    """Points against the plane of their voxel: an equi-join, then the acceptance test."""
    cloud = points(spark, sf_dir)
    pairs = with_voxel(cloud, EDGE).join(planes(cloud).where("is_plane"), ["vx", "vy", "vz"])
    return measured(pairs).select("idx", F.round(F.abs("signed"), 5).alias("residual"), F.round(F.sqrt("variance"), 5).alias("deviation"), "accepted", F.round("probability", 4).alias("probability"))


def _near(a: str) -> str:
    """The neighbouring voxel on an axis for a point beyond a quarter of the edge from its voxel's centre."""
    return f"v{a} + CASE WHEN {a} > (v{a} + 0.75) * {EDGE} THEN 1 WHEN {a} < (v{a} + 0.25) * {EDGE} THEN -1 ELSE 0 END"


@query(f"""WITH {POINTS}, {_PLANES_SQL}, own AS (SELECT {_PAIR}, is_plane FROM v JOIN planes p ON v.vx = p.vx AND v.vy = p.vy AND v.vz = p.vz),
  first_ AS (SELECT *, is_plane AND accepted AS ok FROM {steps_sql("own", _measure(1.0))}),
  moved AS (SELECT idx, x, y, z, {", ".join(f"{_near(a)} AS w{a}" for a in "xyz")} FROM first_ WHERE NOT ok),
  other AS (SELECT idx, x, y, z, n, cx, cy, cz, l0, l1, l2, nx, ny, nz, d, radius FROM moved JOIN planes p ON wx = p.vx AND wy = p.vy AND wz = p.vz WHERE is_plane)
  SELECT idx, 'own' AS source, round(signed, 5) + 0.0 AS residual FROM first_ WHERE ok
  UNION ALL SELECT idx, 'near' AS source, round(signed, 5) + 0.0 FROM {steps_sql("other", _measure(1.0))} WHERE accepted""")
def neighbour_voxel_fallback(spark, sf_dir):
    """Points matched in their own voxel or else in one neighbour, chosen axis by axis; points of no voxel have no fallback."""
    cloud = points(spark, sf_dir)
    known = planes(cloud)
    tried = measured(with_voxel(cloud, EDGE).join(known, ["vx", "vy", "vz"]), 1.0).withColumn("ok", F.expr("is_plane AND accepted"))
    moved = tried.where("NOT ok").select("idx", "x", "y", "z", *[F.expr(_near(a)).alias(f"v{a}") for a in "xyz"])
    again = measured(moved.join(known.where("is_plane"), ["vx", "vy", "vz"]), 1.0).where("accepted")
    out = [df.select("idx", F.lit(name).alias("source"), (F.round("signed", 5) + 0.0).alias("residual")) for df, name in ((tried.where("ok"), "own"), (again, "near"))]
    return out[0].unionByName(out[1])


def _octant(a: str, layer: int) -> str:
    """Which half of its node a coordinate is in, at a layer: on the centre is the low side."""
    size = EDGE / 2 ** (layer - 1)
    return f"CASE WHEN {a} - floor({a} / {size}) * {size} > {size / 2} THEN 1 ELSE 0 END"


_PATHS = [(f"o{k}", f"CAST(4 * {_octant('x', k)} + 2 * {_octant('y', k)} + {_octant('z', k)} AS INT)") for k in (1, 2)]


@query(f"""WITH {POINTS}, {_PLANES_SQL}, o AS (SELECT * FROM {steps_sql("v", _PATHS)}),
  l1_ AS (SELECT vx, vy, vz, o1, count(*) AS n1 FROM o GROUP BY ALL), l2_ AS (SELECT vx, vy, vz, o1, o2, count(*) AS n2 FROM o GROUP BY ALL),
  moved AS (SELECT idx, x + 0.9 AS x, y - 0.7 AS y, z + 0.5 AS z FROM points),
  w AS (SELECT * FROM {steps_sql(f"(SELECT *, CAST(floor(x / {EDGE}) AS BIGINT) AS vx, CAST(floor(y / {EDGE}) AS BIGINT) AS vy, CAST(floor(z / {EDGE}) AS BIGINT) AS vz FROM moved)", _PATHS)})
  SELECT idx, CASE WHEN p.n IS NULL THEN 'none' WHEN p.is_plane OR n1 IS NULL THEN 'root' WHEN n2 IS NULL THEN CAST(w.o1 AS VARCHAR) ELSE CAST(w.o1 AS VARCHAR) || CAST(w.o2 AS VARCHAR) END AS leaf
  FROM w LEFT JOIN planes p ON w.vx = p.vx AND w.vy = p.vy AND w.vz = p.vz
  LEFT JOIN l1_ ON w.vx = l1_.vx AND w.vy = l1_.vy AND w.vz = l1_.vz AND w.o1 = l1_.o1
  LEFT JOIN l2_ ON w.vx = l2_.vx AND w.vy = l2_.vy AND w.vz = l2_.vz AND w.o1 = l2_.o1 AND w.o2 = l2_.o2""")
def octree_leaf_lookup(spark, sf_dir):
    """The deepest node of the voxel's tree that holds a moved point: planes are not descended into, missing children end the walk."""
    cloud = points(spark, sf_dir)
    tree = run_steps(with_voxel(cloud, EDGE), _PATHS)
    one = tree.groupBy("vx", "vy", "vz", "o1").agg(F.count("*").alias("n1"))
    two = tree.groupBy("vx", "vy", "vz", "o1", "o2").agg(F.count("*").alias("n2"))
    asked = run_steps(with_voxel(cloud.select("idx", (_C("x") + 0.9).alias("x"), (_C("y") - 0.7).alias("y"), (_C("z") + 0.5).alias("z")), EDGE), _PATHS)
    found = asked.join(planes(cloud).select("vx", "vy", "vz", "n", "is_plane"), ["vx", "vy", "vz"], "left").join(one, ["vx", "vy", "vz", "o1"], "left").join(two, ["vx", "vy", "vz", "o1", "o2"], "left")
    leaf = F.when(_C("n").isNull(), "none").when(_C("is_plane") | _C("n1").isNull(), "root").when(_C("n2").isNull(), _C("o1").cast("string")).otherwise(F.concat(_C("o1").cast("string"), _C("o2").cast("string")))
    return found.select("idx", leaf.alias("leaf"))


# ---- weights of constraints ---------------------------------------------------------------------------

_WEIGHTS = f"""w AS (SELECT scan, idx, abs(z) / 0.5 AS residual, least(abs(x * y) / 10.0, 1.0) AS dyn, 1 / (1 + z * z) AS weight FROM points)"""


@query(f"""WITH {POINTS}, {_WEIGHTS} SELECT scan, idx, residual >= 2.75 AND dyn >= 0.40 AS rejected,
  round(CASE WHEN residual >= 2.75 AND dyn >= 0.40 THEN 0.0 ELSE greatest(weight, 0.08) END, 6) AS weight, NOT (residual >= 2.75 AND dyn >= 0.40) AND greatest(weight, 0.08) <= greatest(0.05, 0.08 * 1.5) AS low FROM w""")
def outlier_and_floor(spark, sf_dir):
    """Hard outliers (far and moving) carry nothing; all others at least the least total weight."""
    w = constraint_weights(points(spark, sf_dir))
    return w.select("scan", "idx", "rejected", r6(_C("weight"), "weight"), "low")


def constraint_weights(cloud: DataFrame, sigma: float = 2.75, dynamic: float = 0.40, least: float = 0.08) -> DataFrame:
    w = cloud.withColumns({"residual": F.abs("z") / 0.5, "dyn": F.least(F.abs(_C("x") * _C("y")) / 10.0, F.lit(1.0)), "raw": 1 / (1 + _C("z") * _C("z"))})
    w = w.withColumn("rejected", (_C("residual") >= sigma) & (_C("dyn") >= dynamic))
    floor = F.greatest(_C("raw"), F.lit(least))
    return w.select("scan", "idx", "rejected", F.when(_C("rejected"), 0.0).otherwise(floor).alias("weight"), (~_C("rejected") & (floor <= max(0.05, least * 1.5))).alias("low"), "dyn")


@query(f"""WITH {POINTS}, {_WEIGHTS}, e AS (SELECT *, residual >= 2.75 AND dyn >= 0.40 AS rejected FROM w)
  SELECT scan, count(*) AS n, CAST(count(*) FILTER (WHERE rejected) AS BIGINT) AS rejected, round(coalesce(avg(greatest(weight, 0.08)) FILTER (WHERE NOT rejected), 1.0), 6) AS mean_weight,
  round(coalesce(avg(CASE WHEN greatest(weight, 0.08) <= 0.12 THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT rejected), 0.0), 6) AS low_ratio, round(coalesce(avg(dyn), 0.0), 6) AS dynamic_mean FROM e GROUP BY scan""")
def weight_diagnostics(spark, sf_dir):
    """Means of the weights of a scan; without constraints a mean weight is 1 and a mean score 0."""
    w, kept = constraint_weights(points(spark, sf_dir)), lambda c: F.when(~_C("rejected"), c)
    return w.groupBy("scan").agg(
        F.count("*").alias("n"), F.count(F.when(_C("rejected"), 1)).alias("rejected"), r6(F.coalesce(F.avg(kept(_C("weight"))), F.lit(1.0)), "mean_weight"),
        r6(F.coalesce(F.avg(kept(_C("low").cast("double"))), F.lit(0.0)), "low_ratio"), r6(F.coalesce(F.avg("dyn"), F.lit(0.0)), "dynamic_mean"))


@query(f"""WITH {POINTS}, b AS (SELECT scan, idx, CAST(floor(z / 2.0) AS BIGINT) AS bin FROM points), c AS (SELECT scan, bin, count(*) AS n FROM b GROUP BY scan, bin), t AS (SELECT scan, sum(n) AS total FROM c GROUP BY scan)
  SELECT b.idx, round(CASE WHEN total < 10 OR n <= greatest(1, ceil(0.15 * total)) THEN 1.0 ELSE greatest(0.25, least(greatest(1, ceil(0.15 * total)) / n, 1.0)) END, 6) AS weight FROM b JOIN c USING (scan, bin) JOIN t USING (scan)""")
def normal_balance_weight(spark, sf_dir):
    """Constraints of a direction bin fuller than its share weigh less: target over count, floored."""
    b = points(spark, sf_dir).select("scan", "idx", F.floor(_C("z") / 2.0).alias("bin"))
    c = b.groupBy("scan", "bin").agg(F.count("*").alias("n"))
    c = c.join(c.groupBy("scan").agg(F.sum("n").alias("total")), "scan")
    return b.join(c, ["scan", "bin"]).select("idx", r6(F.when(_C("total") < 10, 1.0).otherwise(S.balance_weight(_C("n"), _C("total"), 0.15, 0.25)), "weight"))


# ---- structure of normals -----------------------------------------------------------------------------

_UNIT = "u AS (SELECT scan, idx, x / r AS x, y / r AS y, z / r AS z, abs(z / r) AS up FROM (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM points) WHERE r > 1e-6)"
_SCATTER = ", ".join(f"avg({a} * {b}) AS s{a}{b}" for a, b in _AXES)


def unit_normals(cloud: DataFrame) -> DataFrame:
    r = S.norm(_C("x"), _C("y"), _C("z"))
    u = cloud.withColumn("r", r).where("r > 1e-6")
    return u.select("scan", "idx", *[(_C(a) / _C("r")).alias(a) for a in "xyz"]).withColumn("up", F.abs("z"))


def scatter(normals: DataFrame, keys: list[str]) -> DataFrame:
    """Mean outer product of each group, and its eigenvalues."""
    return run_steps(normals.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(_C(a) * _C(b)).alias(f"s{a}{b}") for a, b in _AXES]), VALUES)


@query(f"""WITH {POINTS}, {_UNIT}, m AS (SELECT scan, count(*) AS n, {_SCATTER} FROM u GROUP BY scan)
  SELECT scan, n, round(CASE WHEN l2 > 1e-10 THEN greatest(least(l0 / l2, 1.0), 0.0) ELSE 0.0 END, 6) AS anisotropy FROM {steps_sql("m", VALUES)}""")
def normal_anisotropy(spark, sf_dir):
    s = scatter(unit_normals(points(spark, sf_dir)), ["scan"])
    return s.select("scan", "n", r6(F.when(_C("l2") > 1e-10, S.clamp(_C("l0") / _C("l2"), 0.0, 1.0)).otherwise(0.0), "anisotropy"))


def structure_class(up):
    """Ground: normals within 30 degrees of gravity; facade: beyond 60 (fixed values)."""
    return F.when(up >= 0.8660254038, "ground").when(up <= 0.5, "facade").otherwise("other")


@query(f"""WITH {POINTS}, {_UNIT}, c AS (SELECT *, CASE WHEN up >= 0.8660254038 THEN 'ground' WHEN up <= 0.5 THEN 'facade' ELSE 'other' END AS class FROM u),
  m AS (SELECT scan, class, count(*) AS n, {_SCATTER} FROM c GROUP BY scan, class UNION ALL SELECT scan, 'all', count(*), {_SCATTER} FROM c GROUP BY scan)
  SELECT scan, class, n, round(greatest(l2, 0.0) / (greatest(l0, 0.0) + greatest(l1, 0.0) + greatest(l2, 0.0)), 5) AS concentration,
  round(-({" + ".join(f"CASE WHEN l{k} / (l0 + l1 + l2) > 1e-12 THEN l{k} / (l0 + l1 + l2) * ln(l{k} / (l0 + l1 + l2)) ELSE 0.0 END" for k in range(3))}) / ln(3.0), 5) + 0.0 AS entropy FROM {steps_sql("m", VALUES)} WHERE n >= 4""")
def structure_split(spark, sf_dir):
    """Scatter of ground, facade, other and all normals of a scan: concentration of the largest eigenvalue, entropy of the three."""
    u = unit_normals(points(spark, sf_dir)).withColumn("class", structure_class(_C("up")))
    s = scatter(u, ["scan", "class"]).unionByName(scatter(u.withColumn("class", F.lit("all")), ["scan", "class"])).where("n >= 4")
    whole = F.greatest(_C("l0"), F.lit(0.0)) + F.greatest(_C("l1"), F.lit(0.0)) + F.greatest(_C("l2"), F.lit(0.0))
    share = [_C(f"l{k}") / (_C("l0") + _C("l1") + _C("l2")) for k in range(3)]
    entropy = -sum((F.when(p > 1e-12, p * F.log(p)).otherwise(0.0) for p in share), F.lit(0.0)) / F.log(F.lit(3.0))
    return s.select("scan", "class", "n", F.round(F.greatest(_C("l2"), F.lit(0.0)) / whole, 5).alias("concentration"), (F.round(entropy, 5) + 0.0).alias("entropy"))


_ROW = ["-z * uy + y * uz", "z * ux - x * uz", "-y * ux + x * uy", "ux", "uy", "uz"]


@query(f"""WITH {POINTS}, n AS (SELECT scan, x, y, z, x / r AS ux, y / r AS uy, z / r AS uz, x * 0.1 AS e, 1 / (1 + z * z) AS w FROM (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM points) WHERE r > 1e-6)
  SELECT scan, CASE WHEN abs(uz) >= 0.8660254038 THEN 'ground' WHEN abs(uz) <= 0.5 THEN 'facade' ELSE 'other' END AS class, count(*) AS n,
  {", ".join(f"round(sum(({h}) * w * e), 5) + 0.0 AS g{k}" for k, h in enumerate(_ROW))} FROM n GROUP BY ALL""")
def class_gradients(spark, sf_dir):
    """The gradient of the weighted normal equations, split by structure class: six sums a class, combined before the shuffle."""
    r = S.norm(_C("x"), _C("y"), _C("z"))
    n = points(spark, sf_dir).withColumn("r", r).where("r > 1e-6").withColumns({f"u{a}": _C(a) / _C("r") for a in "xyz"})
    we = _C("x") * 0.1 / (1 + _C("z") * _C("z"))
    return n.groupBy("scan", structure_class(F.abs("uz")).alias("class")).agg(F.count("*").alias("n"), *[(F.round(F.sum(F.expr(h) * we), 5) + 0.0).alias(f"g{k}") for k, h in enumerate(_ROW)])


# ---- rotations ------------------------------------------------------------------------------------------

_JACOBIAN = [
    ("t2", "x * x + y * y + z * z"), ("t", "sqrt(t2)"),
    ("a", "CASE WHEN t2 < 1e-8 THEN 0.5 - t2 / 24.0 + t2 * t2 / 720.0 ELSE (1 - cos(t)) / t2 END"),
    ("b", "CASE WHEN t2 < 1e-8 THEN 1.0 / 6 - t2 / 120.0 + t2 * t2 / 5040.0 ELSE (t - sin(t)) / (t2 * t) END"),
]


def skew(x, y, z) -> list:
    """Rows of the matrix whose product with a vector is the cross product (x, y, z) x vector."""
    o = F.lit(0.0)
    return [o, -z, y, z, o, -x, -y, x, o]


def right_jacobian(x, y, z) -> list:
    """Rows of the right Jacobian of a rotation vector: I - a [v] + b [v]^2, with series below an angle of 1e-4."""
    t2 = x * x + y * y + z * z
    t = F.sqrt(t2)
    a = F.when(t2 < 1e-8, 0.5 - t2 / 24.0 + t2 * t2 / 720.0).otherwise((1 - F.cos(t)) / t2)
    b = F.when(t2 < 1e-8, 1.0 / 6 - t2 / 120.0 + t2 * t2 / 5040.0).otherwise((t - F.sin(t)) / (t2 * t))
    k = skew(x, y, z)
    square = [sum((k[3 * i + m] * k[3 * m + j] for m in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)]
    return [float(i % 4 == 0) - a * u + b * v for i, (u, v) in enumerate(zip(k, square))]


_ENTRIES = ["1 - b * (y * y + z * z)", "a * z + b * x * y", "-a * y + b * x * z", "-a * z + b * x * y", "1 - b * (x * x + z * z)", "a * x + b * y * z", "a * y + b * x * z", "-a * x + b * y * z", "1 - b * (x * x + y * y)"]


@query(f"""WITH {POINTS}, s AS (SELECT idx, x * f AS x, y * f AS y, z * f AS z, f AS scale FROM points, (VALUES (0.1), (1e-6)) k(f))
  SELECT idx, CAST(scale AS DOUBLE) AS scale, {", ".join(f"round({e}, 9) + 0.0 AS j{k}" for k, e in enumerate(_ENTRIES))} FROM {steps_sql("s", _JACOBIAN)}""")
def right_jacobians(spark, sf_dir):
    s = points(spark, sf_dir).withColumn("scale", F.explode(F.array(F.lit(0.1), F.lit(1e-6))))
    v = [_C(a) * _C("scale") for a in "xyz"]
    return s.select("idx", "scale", *[(F.round(e, 9) + 0.0).alias(f"j{k}") for k, e in enumerate(right_jacobian(*v))])


def rotation_error(r: list) -> tuple:
    """(distance of R'R from the identity, determinant) of nine columns in row order."""
    dots = [sum((r[3 * m + i] * r[3 * m + j] for m in range(3)), F.lit(0.0)) - float(i == j) for i in range(3) for j in range(3)]
    det = r[0] * (r[4] * r[8] - r[5] * r[7]) - r[1] * (r[3] * r[8] - r[5] * r[6]) + r[2] * (r[3] * r[7] - r[4] * r[6])
    return F.sqrt(sum((x * x for x in dots), F.lit(0.0))), det


@query(f"""WITH {POINTS}, q AS (SELECT idx, cos(x) AS c, sin(x) AS s, 1 + 0.001 * (idx % 3) AS k FROM points), m AS (SELECT idx, c * k AS c, s * k AS s, k FROM q)
  SELECT idx, round(sqrt(2 * pow(c * c + s * s - 1, 2) + pow(k * k - 1, 2)), 9) + 0.0 AS error, round(k * (c * c + s * s), 9) AS determinant,
  sqrt(2 * pow(c * c + s * s - 1, 2) + pow(k * k - 1, 2)) <= 0.001 AND abs(k * (c * c + s * s) - 1) <= 0.001 AS valid FROM m""")
def rotation_validity(spark, sf_dir):
    """Turns about z, some of them scaled: distance from a rotation and determinant."""
    k = 1 + 0.001 * (_C("idx") % 3)
    c, s, o = F.cos("x") * k, F.sin("x") * k, F.lit(0.0)
    error, det = rotation_error([c, -s, o, s, c, o, o, o, k])
    return points(spark, sf_dir).select("idx", (F.round(error, 9) + 0.0).alias("error"), F.round(det, 9).alias("determinant"), ((error <= 0.001) & (F.abs(det - 1) <= 0.001)).alias("valid"))


# ---- features of scan lines and observations ------------------------------------------------------------

_LINE = "WINDOW w AS (PARTITION BY scan ORDER BY idx)"


@query(f"""WITH {POINTS}, r AS (SELECT scan, idx, x * x + y * y + z * z AS r2, pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2) + pow(lead(z) OVER w - z, 2) AS gap FROM points {_LINE}),
  n AS (SELECT *, lag(r2, 1) OVER w AS p1, lag(r2, 2) OVER w AS p2, lead(r2, 1) OVER w AS f1, lead(r2, 2) OVER w AS f2, sqrt(lag(gap, 1) OVER w) AS b1, sqrt(lag(gap, 2) OVER w) AS b2, sqrt(gap) AS a1, sqrt(lead(gap, 1) OVER w) AS a2 FROM r {_LINE})
  SELECT idx, coalesce(p1 >= 4 AND p2 >= 4 AND NOT (greatest(b1, b2) > 2 * least(b1, b2) OR greatest(b1, b2) - least(b1, b2) > 1.5), false) AS steady_before,
  coalesce(f1 >= 4 AND f2 >= 4 AND NOT (greatest(a1, a2) > 2 * least(a1, a2) OR greatest(a1, a2) - least(a1, a2) > 1.5), false) AS steady_after FROM n""")
def edge_jumps(spark, sf_dir):
    """Whether the two gaps before and after a point are alike (ratio and difference), beyond the blind radius."""
    w = Window.partitionBy("scan").orderBy("idx")
    r = points(spark, sf_dir).withColumn("r2", _C("x") ** 2 + _C("y") ** 2 + _C("z") ** 2).withColumn("gap", S.norm(*[F.lead(a).over(w) - _C(a) for a in "xyz"]))
    n = r.select("idx", "scan", *[F.lag("r2", k).over(w).alias(f"p{k}") for k in (1, 2)], *[F.lead("r2", k).over(w).alias(f"f{k}") for k in (1, 2)], F.lag("gap", 1).over(w).alias("b1"), F.lag("gap", 2).over(w).alias("b2"), _C("gap").alias("a1"), F.lead("gap", 1).over(w).alias("a2"))

    def steady(near, far, one, two):
        high, low = F.greatest(one, two), F.least(one, two)
        known = one.isNotNull() & two.isNotNull()
        return F.coalesce(known & (near >= 4) & (far >= 4) & ~((high > 2 * low) | (high - low > 1.5)), F.lit(False))

    return n.select("idx", steady(_C("p1"), _C("p2"), _C("b1"), _C("b2")).alias("steady_before"), steady(_C("f1"), _C("f2"), _C("a1"), _C("a2")).alias("steady_after"))


@query(f"""WITH {POINTS}, b AS (SELECT *, first_value(x) OVER w AS bx, first_value(y) OVER w AS by_, first_value(z) OVER w AS bz FROM points {_LINE}),
  c AS (SELECT scan, idx, (x * bx + y * by_ + z * bz) / (sqrt(x * x + y * y + z * z) * sqrt(bx * bx + by_ * by_ + bz * bz)) AS c FROM b)
  SELECT scan, idx, round(degrees(acos(least(greatest(c, -1.0), 1.0))), 4) AS angle FROM c""")
def baseline_angle(spark, sf_dir):
    """Angle of each vector of a scan to the first: the first is one row a scan and is joined back."""
    p = points(spark, sf_dir)
    first = p.groupBy("scan").agg(F.min(F.struct("idx", "x", "y", "z")).alias("b"))
    p = p.join(first, "scan")
    return p.select("scan", "idx", F.round(S.angle_between_deg([_C(a) for a in "xyz"], [_C("b")[a] for a in "xyz"]), 4).alias("angle"))


@query(f"""WITH {POINTS}, d AS (SELECT scan, idx, (x * 0.6 + y * 0.0 + z * 0.8) / sqrt(x * x + y * y + z * z) AS c FROM points), b AS (SELECT scan, idx, c, row_number() OVER (PARTITION BY scan ORDER BY round(c, 9) DESC, idx) AS k FROM d WHERE c > 0)
  SELECT scan, idx, round(c, 6) AS cosine, c >= 0.5 AS usable FROM b WHERE k = 1""")
def closest_view(spark, sf_dir):
    """Per point the observation whose direction is nearest to the frame's (the first of equals); beyond 60 degrees it is of no use."""
    c = (_C("x") * 0.6 + _C("z") * 0.8) / S.norm(_C("x"), _C("y"), _C("z"))
    d = points(spark, sf_dir).select("scan", "idx", c.alias("c")).where("c > 0")
    best = d.groupBy("scan").agg(F.max(F.struct(F.round("c", 9).alias("r"), (-_C("idx")).alias("o"), "c")).alias("b"))
    return best.select("scan", (-_C("b.o")).alias("idx"), r6(_C("b.c"), "cosine"), (_C("b.c") >= 0.5).alias("usable"))


@query(f"""WITH {POINTS}, l AS (SELECT scan, idx, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS moved, abs(intensity - lag(intensity) OVER w) / 100.0 AS turned,
    abs(offset_ms - lag(offset_ms) OVER w) AS pixels FROM points {_LINE})
  SELECT scan, idx, coalesce(moved > 0.5 OR turned > 0.3 OR pixels > 40, true) AS added FROM l""")
def observation_added(spark, sf_dir):
    """A new observation is kept if the view moved by 0.5, turned by 0.3 or the pixel by 40 since the last; the first always."""
    w = Window.partitionBy("scan").orderBy("idx")
    moved = S.norm(*[_C(a) - F.lag(a).over(w) for a in "xyz"])
    turned = F.abs(_C("intensity") - F.lag("intensity").over(w)) / 100.0
    pixels = F.abs(_C("offset_ms") - F.lag("offset_ms").over(w))
    return points(spark, sf_dir).select("scan", "idx", F.coalesce((moved > 0.5) | (turned > 0.3) | (pixels > 40), F.lit(True)).alias("added"))


@query(f"""WITH {POINTS}, {_PLANES_SQL} SELECT 0 AS source, idx AS id, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, round(z, 5) + 0.0 AS z FROM points
  UNION ALL SELECT 1, vx * 1000000 + vy * 1000 + vz, round(cx, 5) + 0.0, round(cy, 5) + 0.0, round(cz, 5) + 0.0 FROM planes WHERE is_plane""")
def candidate_sources(spark, sf_dir):
    """Candidates of the scan first, then centres of map planes."""
    cloud = points(spark, sf_dir)
    r5 = lambda c, a: (F.round(c, 5) + 0.0).alias(a)
    scan = cloud.select(F.lit(0).alias("source"), _C("idx").alias("id"), *[r5(_C(a), a) for a in "xyz"])
    held = planes(cloud).where("is_plane").select(F.lit(1).alias("source"), (_C("vx") * 1000000 + _C("vy") * 1000 + _C("vz")).alias("id"), *[r5(_C(f"c{a}"), a) for a in "xyz"])
    return scan.unionByName(held)


# ---- metrics of variants --------------------------------------------------------------------------------

_FIRST = "min(CASE WHEN {p} THEN stamp END)"


@query(f"""WITH {DIAG}, w AS (SELECT run, stamp, row_id, metric, min(CASE WHEN metric < 60 THEN 1 ELSE 0 END) OVER k AS low3, count(*) OVER k AS n3, first_value(metric) OVER (PARTITION BY run ORDER BY stamp, row_id) AS first_ FROM diag
    WINDOW k AS (PARTITION BY run ORDER BY stamp, row_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
  SELECT run, max(stamp) AS last_time, min(CASE WHEN metric > 80 THEN stamp END) AS first_high, min(CASE WHEN low3 = 1 AND n3 = 3 THEN stamp END) AS first_low_3, max(metric) AS most,
  round(max(abs(metric - first_)), 6) AS most_from_first, round(sqrt(avg(metric * metric)), 6) AS rms FROM w GROUP BY run""")
def variant_metrics(spark, sf_dir):
    """Of each variant: when a limit is first passed, alone and in three rows in a row, largest values, root mean square."""
    by = Window.partitionBy("run").orderBy("stamp", "row_id")
    ahead = by.rowsBetween(0, 2)
    low = F.when(_C("metric") < 60, 1).otherwise(0)
    w = diagnostics(spark, sf_dir).withColumns({"low3": F.min(low).over(ahead), "n3": F.count("*").over(ahead), "first_": F.first("metric").over(by)})
    return w.groupBy("run").agg(
        F.max("stamp").alias("last_time"), F.min(F.when(_C("metric") > 80, _C("stamp"))).alias("first_high"), F.min(F.when((_C("low3") == 1) & (_C("n3") == 3), _C("stamp"))).alias("first_low_3"),
        F.max("metric").alias("most"), r6(F.max(F.abs(_C("metric") - _C("first_"))), "most_from_first"), r6(F.sqrt(F.avg(_C("metric") * _C("metric"))), "rms"))
