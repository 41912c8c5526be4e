"""What the planner decides and says: intents, best candidates and their acceptance, clouds, output rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lidarlake.functions import scalar as S
from lidarlake.plans.audit import r6
from lidarlake.plans.catalog import Catalog
from lidarlake.sources.adapters import DIAG, POINTS, diagnostics, points, table

_catalog = Catalog()
query, QUERIES, SQL = _catalog.query, _catalog.queries, _catalog.sql
_C = F.col

# ---- intents ------------------------------------------------------------------------------------------

#: Names that must match (fixed values).
INTENTS = ("FREE", "FORWARD_SCAN", "LEFT_ORBIT", "RIGHT_ORBIT", "UP_SCAN", "DOWN_SCAN", "PULL_BACK", "HOLD_STABLE", "RESCAN_LOCAL")
DIRECTIONAL = ("FORWARD_SCAN", "LEFT_ORBIT", "RIGHT_ORBIT", "UP_SCAN", "DOWN_SCAN", "PULL_BACK")
STATES = ("NORMAL", "WATCH", "WARNING", "RECOVERING", "CRITICAL")
PILOT_MODES = {"FREE": "FREE_ASSIST", "RESCAN_LOCAL": "RESCAN_ASSIST", "HOLD_STABLE": "HOLD", "PULL_BACK": "RECOVERY_ASSIST"}


def pilot_mode(intent: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, mode in PILOT_MODES.items():
        out = out.when(intent == name, mode)
    return out.otherwise("INTENT_ASSIST")


def _nth(words: tuple, by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(by, F.lit(len(words))) + 1).cast("int"))


def _nth_sql(words: tuple, by: str) -> str:
    return "([" + ", ".join(f"'{w}'" for w in words) + f"])[CAST({by} % {len(words)} + 1 AS INTEGER)]"


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_INTENT = f"i AS (SELECT event_id, {_nth_sql(INTENTS, 'event_id')} AS intent, {_nth_sql(STATES, 'user_id')} AS state, value / 100.0 AS yaw, value FROM events)"


def intents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", _nth(INTENTS, _C("event_id")).alias("intent"), _nth(STATES, _C("user_id")).alias("state"), (_C("value") / 100.0).alias("yaw"), "value")


@query(f"""WITH {_INTENT} SELECT event_id, intent IN ({_quoted(DIRECTIONAL)}) AS directional,
  CASE intent WHEN 'FREE' THEN 'FREE_ASSIST' WHEN 'RESCAN_LOCAL' THEN 'RESCAN_ASSIST' WHEN 'HOLD_STABLE' THEN 'HOLD' WHEN 'PULL_BACK' THEN 'RECOVERY_ASSIST' ELSE 'INTENT_ASSIST' END AS pilot_mode,
  intent = 'FREE' AND state IN ('NORMAL', 'WATCH', 'RECOVERING') AS suppressed FROM i""")
def intent_predicates(spark, sf_dir):
    """Directional or not, the pilot mode, and whether nothing is suggested because the pilot asked for nothing."""
    i = intents(spark, sf_dir)
    return i.select("event_id", _C("intent").isin(*DIRECTIONAL).alias("directional"), pilot_mode(_C("intent")).alias("pilot_mode"), ((_C("intent") == "FREE") & _C("state").isin("NORMAL", "WATCH", "RECOVERING")).alias("suppressed"))


def wrapped(sql: str) -> str:
    return f"atan2(sin({sql}), cos({sql}))"


@query(f"""WITH {_INTENT}, y AS (SELECT event_id, intent, state, yaw, CASE WHEN event_id % 3 = 0 THEN yaw * 0.7 END AS away FROM i),
  w AS (SELECT *, CASE WHEN intent = 'LEFT_ORBIT' THEN {wrapped("coalesce(away, yaw) + pi() / 2")} WHEN intent = 'RIGHT_ORBIT' THEN {wrapped("coalesce(away, yaw) - pi() / 2")}
    WHEN intent = 'PULL_BACK' OR state = 'WARNING' THEN coalesce(away, {wrapped("yaw + pi()")}) ELSE yaw END AS aim FROM y)
  SELECT event_id, round(aim, 6) + 0.0 AS aim, CASE WHEN intent NOT IN ({_quoted(DIRECTIONAL)}) OR state = 'WARNING' THEN true WHEN intent = 'UP_SCAN' AND yaw <= 0.5 + 1e-3 THEN false WHEN intent = 'DOWN_SCAN' AND yaw >= 0.5 - 1e-3 THEN false
    ELSE abs({wrapped("2 * yaw - aim")}) <= CASE WHEN intent IN ('LEFT_ORBIT', 'RIGHT_ORBIT') THEN radians(70.0) WHEN intent IN ('UP_SCAN', 'DOWN_SCAN') THEN radians(90.0) ELSE radians(60.0) END END AS allowed FROM w""")
def intent_aim(spark, sf_dir):
    """Where an intent points (orbits go along the surface, if one is near; retreats away from it), and whether a candidate lies in its corridor."""
    i = intents(spark, sf_dir).withColumn("away", F.when(_C("event_id") % 3 == 0, _C("yaw") * 0.7))
    wrap = lambda a: F.atan2(F.sin(a), F.cos(a))
    base, turn = F.coalesce("away", "yaw"), math.pi / 2
    aim = F.when(_C("intent") == "LEFT_ORBIT", wrap(base + turn)).when(_C("intent") == "RIGHT_ORBIT", wrap(base - turn))
    aim = aim.when((_C("intent") == "PULL_BACK") | (_C("state") == "WARNING"), F.coalesce(_C("away"), wrap(_C("yaw") + math.pi))).otherwise(_C("yaw"))
    corridor = F.when(_C("intent").isin("LEFT_ORBIT", "RIGHT_ORBIT"), math.radians(70)).when(_C("intent").isin("UP_SCAN", "DOWN_SCAN"), math.radians(90)).otherwise(math.radians(60))
    # a candidate at twice the yaw, its height the yaw against 0.5
    allowed = (
        F.when(~_C("intent").isin(*DIRECTIONAL) | (_C("state") == "WARNING"), True).when((_C("intent") == "UP_SCAN") & (_C("yaw") <= 0.5 + 1e-3), False)
        .when((_C("intent") == "DOWN_SCAN") & (_C("yaw") >= 0.5 - 1e-3), False).otherwise(F.abs(wrap(2 * _C("yaw") - _C("aim"))) <= corridor))
    return i.withColumn("aim", aim).select("event_id", (F.round("aim", 6) + 0.0).alias("aim"), allowed.alias("allowed"))


# ---- clouds and grids ----------------------------------------------------------------------------------


def cylinder(dx: Column, dy: Column, dz: Column, radius: float, height: float) -> Column:
    return (dx * dx + dy * dy <= radius * radius) & (F.abs(dz) <= height)


@query(f"""WITH {POINTS} SELECT scan, count(*) AS n, CAST(count(*) FILTER (WHERE x * x + y * y <= 9.0 AND abs(z) <= 2.0) AS BIGINT) AS inside FROM points GROUP BY scan""")
def local_cylinder(spark, sf_dir):
    return points(spark, sf_dir).groupBy("scan").agg(F.count("*").alias("n"), F.count(F.when(cylinder(_C("x"), _C("y"), _C("z"), 3.0, 2.0), 1)).alias("inside"))


@query(f"""WITH {POINTS}, s AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY idx) - 1 AS place, count(*) OVER (PARTITION BY scan) AS total FROM points),
  c AS (SELECT scan, idx, row_number() OVER (PARTITION BY scan ORDER BY idx) AS k FROM s WHERE place % greatest(1, total // 20) = 0 AND isfinite(x) AND sqrt(x * x + y * y) <= 4.0 AND abs(z) <= 3.0) SELECT scan, idx FROM c WHERE k <= 20""")
def planner_cloud(spark, sf_dir, most: int = 20):
    """The planner's view of a scan: every n-th point (so that about ``most`` are left), those in the cylinder, the first ``most`` of them in order."""
    by = Window.partitionBy("scan").orderBy("idx")
    p = points(spark, sf_dir).withColumn("place", F.row_number().over(by) - 1).withColumn("total", F.count("*").over(Window.partitionBy("scan")))
    stride = F.greatest(F.lit(1), F.floor(_C("total") / most))
    near = ~F.isnan("x") & (S.norm(_C("x"), _C("y"), F.lit(0.0)) <= 4.0) & (F.abs("z") <= 3.0)
    kept = p.where((_C("place") % stride == 0) & near).withColumn("k", F.row_number().over(by))
    return kept.where(_C("k") <= most).select("scan", "idx")


#: Least values of the evidence grid's settings (fixed values).
GRID_FLOORS = {"voxel_size": 0.1, "local_radius": 1.0, "local_z_radius": 0.5, "free_ttl": 0.1, "occupied_ttl": 0.1, "max_ray_length": 1.0, "ray_step": 0.1, "free_ray_stride": 1.0, "min_occupied_hits": 1.0, "max_voxels": 1000.0}


@query(f"""SELECT event_id, {", ".join(f"greatest({low}, (value - 50) * {k + 1} / 10.0) AS {name}" for k, (name, low) in enumerate(GRID_FLOORS.items()))} FROM events""".replace("greatest(1.0,", "greatest(CAST(1.0 AS DOUBLE),"))
def grid_settings(spark, sf_dir):
    """Settings below their least value are raised to it."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", *[F.greatest(F.lit(low), (_C("value") - 50) * (k + 1) / 10.0).alias(name) for k, (name, low) in enumerate(GRID_FLOORS.items())])


def with_level(offsets: Column) -> Column:
    """Height offsets with 0 put first if none is within 1e-6 of it."""
    return F.when(F.exists(offsets, lambda z: F.abs(z) < 1e-6), offsets).otherwise(F.concat(F.array(F.lit(0.0)), offsets))


@query("""WITH o AS (SELECT event_id, [value / 100.0, CASE WHEN event_id % 2 = 0 THEN 0.0 ELSE -0.5 END] AS z FROM events), f AS (SELECT event_id, CASE WHEN len(list_filter(z, lambda v: abs(v) < 1e-6)) > 0 THEN z ELSE list_concat([CAST(0 AS DOUBLE)], z) END AS z FROM o)
  SELECT event_id, CAST(len(z) AS INTEGER) AS n, CAST(z[1] AS DOUBLE) AS first_, greatest(list_max(list_transform(z, lambda v: abs(v))), 1e-3) AS step FROM f""")
def height_offsets(spark, sf_dir):
    z = with_level(F.array(_C("value") / 100.0, F.when(_C("event_id") % 2 == 0, 0.0).otherwise(-0.5)))
    e = table(spark, sf_dir, "events").select("event_id", z.alias("z"))
    return e.select("event_id", F.size("z").alias("n"), _C("z")[0].alias("first_"), F.greatest(F.array_max(F.transform("z", F.abs)), F.lit(1e-3)).alias("step"))


# ---- candidates -----------------------------------------------------------------------------------------

#: Least score of a mode, and most unknown share of a path by state; WATCH: at most 0.25 (fixed values).
ACCEPT = {"EXPLORE": 0.05, "CONSERVATIVE": 0.0, "RECOVER": -0.05, "RETREAT_OR_HOLD": -0.10}
ACCEPT_ELSE, UNKNOWN, UNKNOWN_ELSE = -0.25, {"WARNING": 0.18, "RECOVERING": 0.22}, 0.30


def _case(value: Column, table_: dict, other: float) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for k, v in table_.items():
        out = out.when(value == k, v)
    return out.otherwise(other)


def _case_sql(value: str, table_: dict, other: float) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table_.items()) + f" ELSE {other} END"


_MODES = ("EXPLORE", "CONSERVATIVE", "RECOVER", "RETREAT_OR_HOLD", "OTHER")
_CAND = f"c AS (SELECT scan, idx, round(x * 0.05 + y * 0.02 - abs(z) * 0.01, 2) AS score, {_nth_sql(_MODES, 'scan')} AS mode FROM points)"


def candidates(spark, sf_dir) -> DataFrame:
    return points(spark, sf_dir).select("scan", "idx", F.round(_C("x") * 0.05 + _C("y") * 0.02 - F.abs("z") * 0.01, 2).alias("score"), _nth(_MODES, _C("scan")).alias("mode"))


@query(f"""WITH {POINTS}, {_CAND}, b AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY score DESC, idx) AS k, count(*) OVER (PARTITION BY scan) AS n FROM c)
  SELECT scan, idx, n, score, score >= {_case_sql("mode", ACCEPT, ACCEPT_ELSE)} AS accepted FROM b WHERE k = 1""")
def best_candidate(spark, sf_dir):
    """The first candidate of the largest score, and whether its mode takes that score."""
    b = candidates(spark, sf_dir).groupBy("scan", "mode").agg(F.max(F.struct("score", (-_C("idx")).alias("o"))).alias("b"), F.count("*").alias("n"))
    return b.select("scan", (-_C("b.o")).alias("idx"), "n", _C("b.score").alias("score"), (_C("b.score") >= _case(_C("mode"), ACCEPT, ACCEPT_ELSE)).alias("accepted"))


@query(f"""SELECT event_id, CASE WHEN s = 'WATCH' THEN least({UNKNOWN_ELSE}, 0.25) ELSE {_case_sql("s", UNKNOWN, UNKNOWN_ELSE)} END::DOUBLE AS limit_, value / 200.0 <= CASE WHEN s = 'WATCH' THEN least({UNKNOWN_ELSE}, 0.25) ELSE {_case_sql("s", UNKNOWN, UNKNOWN_ELSE)} END AS inside
  FROM (SELECT *, {_nth_sql(STATES, 'user_id')} AS s FROM events)""")
def unknown_path_limit(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("s", _nth(STATES, _C("user_id")))
    limit = F.when(_C("s") == "WATCH", min(UNKNOWN_ELSE, 0.25)).otherwise(_case(_C("s"), UNKNOWN, UNKNOWN_ELSE))
    return e.select("event_id", limit.alias("limit_"), (_C("value") / 200.0 <= limit).alias("inside"))


_GAIN = "g AS (SELECT scan, idx, CASE WHEN scan % 2 = 0 THEN 0.0 ELSE greatest(least(abs(x) / 8.0 - 0.05, 1.0), 0.0) END AS gain, abs(y) / 8.0 AS density FROM points)"


@query(f"""WITH {POINTS}, {_GAIN}, m AS (SELECT scan, max(gain) AS best FROM g GROUP BY scan) SELECT idx, round(CASE WHEN best > 1e-6 THEN gain ELSE greatest(least(0.35 * density, 1.0), 0.0) END, 6) AS gain, best <= 1e-6 AS fallback FROM g JOIN m USING (scan)""")
def surface_gain_fallback(spark, sf_dir, scale: float = 0.35):
    """Where no candidate of a scan sees any surface, scaled point density stands in; the repeat penalty is taken off the gain."""
    g = points(spark, sf_dir).select("scan", "idx", F.when(_C("scan") % 2 == 0, 0.0).otherwise(S.clamp(F.abs("x") / 8.0 - 0.05, 0.0, 1.0)).alias("gain"), (F.abs("y") / 8.0).alias("density"))
    g = g.join(g.groupBy("scan").agg(F.max("gain").alias("best")), "scan")
    return g.select("idx", r6(F.when(_C("best") > 1e-6, _C("gain")).otherwise(S.clamp(scale * _C("density"), 0.0, 1.0)), "gain"), (_C("best") <= 1e-6).alias("fallback"))


# ---- time and output ------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN -1.0 ELSE round(1.8e9 - epoch_us(ts) / 1e6, 3) END AS age FROM events""")
def stamp_age(spark, sf_dir):
    """Seconds since a stamp; -1 for one that was never set (0)."""
    stamp = F.when(_C("event_id") % 7 == 0, 0.0).otherwise(F.unix_micros(_C("ts").cast("timestamp")) / 1e6)
    return table(spark, sf_dir, "events").select("event_id", F.when(stamp == 0, -1.0).otherwise(F.round(1.8e9 - stamp, 3)).alias("age"))


@query(f"""WITH {DIAG}, r AS (SELECT run, row_id, stamp, CASE WHEN stamp < lag(stamp) OVER (PARTITION BY run ORDER BY row_id) THEN 1 ELSE 0 END AS back FROM diag)
  SELECT run, row_id, back = 1 AS reset, CAST(sum(back) OVER (PARTITION BY run ORDER BY row_id) AS BIGINT) AS session FROM r""")
def time_rewind(spark, sf_dir):
    """Rows in order of arrival: a stamp before the last one starts a new session, in which nothing of the old is left."""
    by = Window.partitionBy("run").orderBy("row_id")
    back = F.when(_C("stamp") < F.lag("stamp").over(by), 1).otherwise(0)
    r = diagnostics(spark, sf_dir).withColumn("back", back)
    return r.select("run", "row_id", (_C("back") == 1).alias("reset"), F.sum("back").over(by).alias("session"))


#: Columns of the planner's output table, in order (fixed values).
CSV_COLUMNS = (
    "stamp health_state planning_state mode pilot_mode pilot_intent intent_age_s intent_yaw_deg intent_bearing_deg pilot_intent_strength reason pilot_prompt candidate_count top_score coverage_gain collision_risk "
    "health_penalty unknown_risk task_progress path_unknown_ratio path_occupied_count path_length_cost turn_cost target_distance_m target_bearing_deg reliability_score confidence_score confidence_level "
    "health_action_code health_primary_reason motion_flags cloud_points grid_voxels grid_free grid_occupied odom_age_s health_age_s cloud_age_s cloud_frame_ok cloud_frame retreat_base_yaw_deg retreat_base_source control_authority"
).split()
_NUMBERS = {"stamp": "event_id", "top_score": "value", "target_distance_m": "value / 10.0"}
_TEXTS = {"health_state": "event_type", "reason": "'low, \"' || event_type || '\"'", "control_authority": "'pilot_only'"}


def csv_row(columns: dict[str, Column]) -> Column:
    """A line of the table: numbers with six decimals, texts quoted where they must be, what is not given is empty."""
    return F.concat_ws(",", *[columns.get(name, F.lit("")) for name in CSV_COLUMNS])


def _cell_sql(e: str) -> str:
    return f"CASE WHEN regexp_matches({e}, '[,\"]') THEN '\"' || replace({e}, '\"', '\"\"') || '\"' ELSE {e} END"


@query("SELECT event_id, concat_ws(',', " + ", ".join(f"printf('%.6f', CAST({_NUMBERS[c]} AS DOUBLE))" if c in _NUMBERS else _cell_sql(_TEXTS[c]) if c in _TEXTS else "''" for c in CSV_COLUMNS) + ") AS line FROM events")
def planner_csv(spark, sf_dir):
    numbers = {"stamp": _C("event_id").cast("double"), "top_score": _C("value"), "target_distance_m": _C("value") / 10.0}
    quoted = F.concat(F.lit('low, "'), "event_type", F.lit('"'))
    cell = lambda c: F.when(c.rlike('[,"]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    given = {k: F.format_string("%.6f", v) for k, v in numbers.items()} | {"health_state": cell(_C("event_type")), "reason": cell(quoted), "control_authority": F.lit("pilot_only")}
    return table(spark, sf_dir, "events").select("event_id", csv_row(given).alias("line"))


@query(f"""WITH {POINTS}, {_CAND}, b AS (SELECT scan, max(score) AS score, any_value(mode) AS mode FROM c GROUP BY scan)
  SELECT scan, CASE WHEN score < {_case_sql("mode", ACCEPT, ACCEPT_ELSE)} THEN 'LOW_ACCEPT_SCORE' ELSE '' END AS reason, CASE WHEN score < {_case_sql("mode", ACCEPT, ACCEPT_ELSE)} THEN -1.0 ELSE score END AS top_score,
  CASE WHEN score < {_case_sql("mode", ACCEPT, ACCEPT_ELSE)} THEN 0 ELSE 1 END AS goals FROM b""")
def suppressed_output(spark, sf_dir):
    """A scan whose best candidate is refused puts out a row of sentinels: a reason, the score -1, no goal."""
    b = best_candidate(spark, sf_dir)
    return b.select("scan", F.when(_C("accepted"), "").otherwise("LOW_ACCEPT_SCORE").alias("reason"), F.when(_C("accepted"), _C("score")).otherwise(-1.0).alias("top_score"), _C("accepted").cast("int").alias("goals"))
