"""The machines of the streaming package over stored events, in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from lidarlake.operators.fold import ordered_fold
from lidarlake.plans.audit import r6
from lidarlake.sources.adapters import DIAG, diagnostics
from lidarlake.streaming import machines as M

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_BAD, _RE, _CON, _OK = "e = 'invalid'", "e = 'reinit'", "e = 'constraint'", "e = 'valid'"
_STREAK = "CASE WHEN s.state = 2 THEN 1 ELSE s.streak + 1 END"
_DONE = f"{_OK} AND s.state IN (2, 3) AND {_STREAK} >= 3"
_TAKES = "e = 'reinit' AND s.attempts < 6"
#: Column by column: what the next state is, given the event and the state before (4 is final).
_NEXT = {
    "state": f"CASE WHEN {_BAD} THEN CASE WHEN s.degraded + 1 >= 300 THEN 4 WHEN s.state IN (2, 3) OR (s.state = 1 AND s.degraded + 1 >= 3) THEN 2 ELSE 1 END WHEN {_TAKES} OR {_CON} THEN 2 WHEN {_OK} THEN CASE WHEN s.state IN (0, 1) OR {_STREAK} >= 3 THEN 0 ELSE 3 END ELSE s.state END",
    "degraded": f"CASE WHEN {_BAD} THEN s.degraded + 1 WHEN {_CON} OR ({_OK} AND (s.state IN (0, 1, 2) OR {_STREAK} >= 3)) THEN 0 ELSE s.degraded END",
    "streak": f"CASE WHEN {_BAD} OR {_TAKES} OR {_CON} OR ({_DONE}) THEN 0 WHEN {_OK} AND s.state IN (2, 3) THEN {_STREAK} ELSE s.streak END",
    "attempts": f"CASE WHEN {_TAKES} THEN s.attempts + 1 WHEN ({_DONE}) OR ({_OK} AND s.state = 1) THEN 0 ELSE s.attempts END",
    "rollbacks": f"CASE WHEN {_TAKES} THEN s.rollbacks + 1 ELSE s.rollbacks END",
    "successes": f"CASE WHEN {_DONE} THEN s.successes + 1 ELSE s.successes END",
    "failures": f"CASE WHEN {_BAD} AND s.degraded + 1 >= 300 THEN s.failures + 1 ELSE s.failures END",
}


@query(f"""WITH RECURSIVE {DIAG}, o AS (SELECT run, row_id, row_number() OVER (PARTITION BY run ORDER BY stamp, row_id) AS k,
    CASE WHEN metric > 80 THEN 'invalid' WHEN row_id % 11 = 0 THEN 'reinit' WHEN row_id % 13 = 0 THEN 'constraint' ELSE 'valid' END AS e FROM diag),
  s AS (SELECT DISTINCT run, CAST(NULL AS BIGINT) AS row_id, CAST(0 AS BIGINT) AS k, {", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in _NEXT)} FROM diag
    UNION ALL SELECT o.run, o.row_id, o.k, {", ".join(f"CAST(CASE WHEN s.state = 4 THEN s.{c} ELSE {e} END AS BIGINT)" for c, e in _NEXT.items())} FROM s JOIN o ON o.run = s.run AND o.k = s.k + 1)
  SELECT run, row_id, {", ".join(_NEXT)} FROM s WHERE k > 0""")
def supervisor_fsm(spark, sf_dir):
    """Large values are invalid frames, click and purchase others are valid, a few begin a reinitialisation."""
    event = F.when(F.col("metric") > 80, "invalid").when((F.col("row_id") % 11) == 0, "reinit").when((F.col("row_id") % 13) == 0, "constraint").otherwise("valid")
    d = diagnostics(spark, sf_dir).withColumn("event", event)
    return ordered_fold(d, ["run"], ["stamp", "row_id"], ["row_id", "event"], None, M.supervise, "row_id long, state long, degraded long, streak long, attempts long, rollbacks long, successes long, failures long")


@query()
def adaptive_sampler(spark, sf_dir):
    m = F.col("metric") / 200.0
    d = diagnostics(spark, sf_dir).withColumns({"motion": F.least(m, F.lit(1.0)), "valid": 1 - F.least(m, F.lit(1.0)) * 0.5, "quality": 1 - F.least(m, F.lit(1.0)) * 0.6, "degeneracy": 1 - F.least(m, F.lit(1.0)) * 0.7})
    return ordered_fold(d, ["run"], ["stamp", "row_id"], ["row_id", "motion", "valid", "quality", "degeneracy"], None, M.adapt_sampler, "row_id long, stride long")


def _admit(state, row):
    return M.admit(state, row, late=3600.0, gap=200_000.0)


@query(f"""WITH RECURSIVE {DIAG}, o AS (SELECT run, row_id, stamp, row_number() OVER (PARTITION BY run ORDER BY row_id) AS k FROM diag),
  s AS (SELECT run, row_id, k, stamp AS last, CAST(0 AS BIGINT) AS session, 'ready' AS status FROM o WHERE k = 1
    UNION ALL SELECT o.run, o.row_id, o.k, CASE WHEN o.stamp < s.last - 1e-6 AND s.last - o.stamp < 3600 THEN s.last ELSE o.stamp END,
      CASE WHEN o.stamp < s.last - 1e-6 AND s.last - o.stamp >= 3600 THEN s.session + 1 ELSE s.session END,
      CASE WHEN o.stamp < s.last - 1e-6 THEN CASE WHEN s.last - o.stamp < 3600 THEN 'late' ELSE 'reset' END WHEN o.stamp - s.last > 200000 THEN 'gap' ELSE 'ready' END
    FROM s JOIN o ON o.run = s.run AND o.k = s.k + 1)
  SELECT run, row_id, session, status FROM s""")
def late_data_tiers(spark, sf_dir):
    """Rows in order of arrival: little late is dropped, much late resets the session, long gaps are marked."""
    d = diagnostics(spark, sf_dir)
    return ordered_fold(d, ["run"], ["row_id"], ["row_id", "stamp"], None, _admit, "row_id long, session long, status string")


def _commit(state, row):
    return M.commit_goal(state, row, 10_000.0, 300_000.0, 20.0, 18.0)


_BEARING = "abs((CAST(o.row_id * 7 % 360 AS DOUBLE) - s.direction + 540.0) % 360.0 - 180.0) >= 18.0"
_SWITCH = f"o.stamp - s.since >= 10000.0 AND o.metric > s.score + 20.0 AND (o.stamp - s.since > 300000.0 OR {_BEARING})"


@query(f"""WITH RECURSIVE {DIAG}, o AS (SELECT run, row_id, stamp, mode, metric, row_number() OVER (PARTITION BY run ORDER BY stamp, row_id) AS k FROM diag),
  s AS (SELECT run, row_id, k, mode AS goal, metric AS score, CAST(row_id * 7 % 360 AS DOUBLE) AS direction, stamp AS since FROM o WHERE k = 1
    UNION ALL SELECT o.run, o.row_id, o.k, CASE WHEN {_SWITCH} THEN o.mode ELSE s.goal END, CASE WHEN {_SWITCH} THEN o.metric ELSE s.score END,
      CASE WHEN {_SWITCH} THEN CAST(o.row_id * 7 % 360 AS DOUBLE) ELSE s.direction END, CASE WHEN {_SWITCH} THEN o.stamp ELSE s.since END
    FROM s JOIN o ON o.run = s.run AND o.k = s.k + 1)
  SELECT run, row_id, goal, round(score, 6) AS score FROM s""")
def goal_commitment(spark, sf_dir):
    """The goal that each run keeps to, row by row: better goals elsewhere, and much better ones after a long hold, take its place."""
    d = diagnostics(spark, sf_dir).withColumn("direction", (F.col("row_id") * 7 % 360).cast("double"))
    out = ordered_fold(d, ["run"], ["stamp", "row_id"], ["row_id", "stamp", "mode", "metric", "direction"], None, _commit, "row_id long, goal string, score double")
    return out.select("run", "row_id", "goal", r6(F.col("score"), "score"))
