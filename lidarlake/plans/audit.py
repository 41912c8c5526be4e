"""Run audit: statistics of diagnostics, integrity of series, alignment in time."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from lidarlake.operators.fold import consecutive_true, ema_clamped, monotonic_violations, ordered_fold
from lidarlake.operators.joins import asof_join, interval_join
from lidarlake.sources.adapters import DIAG, diagnostics

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r6(c, name: str):
    return F.round(c, 6).alias(name)


@query(f"""WITH {DIAG} SELECT mode, count(*) AS n, round(avg(metric), 6) AS mean, round(quantile_cont(metric, 0.95), 6) AS p95,
  round(quantile_cont(metric, 0.99), 6) AS p99, max(metric) AS high, min(metric) AS low FROM diag WHERE isfinite(metric) GROUP BY mode""")
def diag_stats_by_mode(spark, sf_dir):
    """count, mean, p95, p99 (linear between order statistics), max, min of each mode: one shuffle."""
    d = diagnostics(spark, sf_dir).where("not isnan(metric) and abs(metric) < double('inf')")
    return d.groupBy("mode").agg(
        F.count("*").alias("n"), r6(F.avg("metric"), "mean"), r6(F.percentile("metric", 0.95), "p95"), r6(F.percentile("metric", 0.99), "p99"), F.max("metric").alias("high"), F.min("metric").alias("low"))


@query(f"""WITH {DIAG} SELECT mode, round(avg(CASE WHEN metric > 50 THEN 1.0 ELSE 0.0 END), 6) AS high_ratio, max(CAST(floor(metric) AS BIGINT)) AS top,
  CAST(sum(CASE WHEN metric < 10 THEN 1 ELSE 0 END) AS BIGINT) AS low_frames, count(DISTINCT run) AS runs FROM diag GROUP BY mode""")
def diag_ratio_metrics(spark, sf_dir):
    return diagnostics(spark, sf_dir).groupBy("mode").agg(
        r6(F.avg(F.when(F.col("metric") > 50, 1.0).otherwise(0.0)), "high_ratio"), F.max(F.floor("metric")).alias("top"),
        F.sum(F.when(F.col("metric") < 10, 1).otherwise(0)).alias("low_frames"), F.countDistinct("run").alias("runs"))


@query(f"""WITH {DIAG}, s AS (SELECT mode, CAST(round_even(metric / 25.0, 0) AS BIGINT) AS state FROM diag),
  grid AS (SELECT mode, state FROM (SELECT DISTINCT mode FROM diag), (SELECT unnest([0, 1, 2, 3, 4]) AS state))
  SELECT g.mode, CAST(g.state AS BIGINT) AS state, count(s.state) AS n FROM grid g LEFT JOIN s ON g.mode = s.mode AND g.state = s.state GROUP BY ALL""")
def state_hist_zero_filled(spark, sf_dir):
    """Rows of each state 0 to 4, rounded half to even; states that never occur count 0."""
    d = diagnostics(spark, sf_dir).select("mode", F.bround(F.col("metric") / 25.0, 0).cast("long").alias("state"))
    n = d.groupBy("mode").agg(*[F.count(F.when(F.col("state") == k, 1)).alias(str(k)) for k in range(5)])
    pairs = F.array(*[F.struct(F.lit(k).cast("long").alias("state"), F.col(str(k)).alias("n")) for k in range(5)])
    return n.select("mode", F.inline(pairs))


@query(f"""WITH {DIAG}, o AS (SELECT mode, metric, row_number() OVER (PARTITION BY mode ORDER BY metric) - 1 AS k, count(*) OVER (PARTITION BY mode) AS n FROM diag WHERE metric > 1e-3)
  SELECT mode, metric AS value, n FROM o WHERE k = CAST(floor(0.7 * (n - 1)) AS BIGINT) AND n >= 20""")
def quantile_lower_order_stat(spark, sf_dir):
    """The order statistic at floor(q * (n - 1)) for q = 0.7; none below 20 values.

    percentile_disc takes the least value whose rank share is at least p: at p = k / n - 1 / (2 n) the k-th."""
    d = diagnostics(spark, sf_dir).where("metric > 1e-3")
    n = d.groupBy("mode").agg(F.count("*").alias("n")).where("n >= 20").withColumn("k", F.floor(0.7 * (F.col("n") - 1)) + 1)
    # histogram of values, running count: a mode's rows are counted before they meet
    values = d.groupBy("mode", "metric").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("mode").orderBy("metric"))
    hit = values.withColumn("upto", upto).join(F.broadcast(n), "mode").where("upto >= k and upto - c < k")
    return hit.select("mode", F.col("metric").alias("value"), "n")


def _ema_step(state, row, alpha, low, high):
    e = ema_clamped(state, row[1], alpha, low, high)
    return e, (row[0], e)


@query(f"""WITH RECURSIVE {DIAG}, o AS (SELECT run, row_id, metric, row_number() OVER (PARTITION BY run ORDER BY stamp, row_id) AS k FROM diag),
  e AS (SELECT run, row_id, k, least(greatest(20.0 + 0.15 * (metric - 20.0), 20.0), 60.0) AS ema FROM o WHERE k = 1
    UNION ALL SELECT o.run, o.row_id, o.k, least(greatest(e.ema + 0.15 * (o.metric - e.ema), 20.0), 60.0) FROM e JOIN o ON o.run = e.run AND o.k = e.k + 1)
  SELECT run, row_id, round(ema, 6) AS ema FROM e""")
def ema_reference(spark, sf_dir):
    """Exponential mean, clamped to [20, 60] after each step, in the order of each run."""
    d = diagnostics(spark, sf_dir)
    out = ordered_fold(d, ["run"], ["stamp", "row_id"], ["row_id", "metric"], None, partial(_ema_step, alpha=0.15, low=20.0, high=60.0), "row_id long, ema double")
    return out.select("run", "row_id", r6("ema", "ema"))


@query(f"""WITH {DIAG}, w AS (SELECT mode, stamp, min(CASE WHEN metric > 30 THEN 1 ELSE 0 END) OVER f AS ok, count(*) OVER f AS c FROM diag
    WINDOW f AS (PARTITION BY mode ORDER BY stamp, row_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
  SELECT mode, min(CASE WHEN ok = 1 AND c = 4 THEN stamp END) AS first_time FROM w GROUP BY mode""")
def consecutive_true_first_time(spark, sf_dir):
    return consecutive_true(diagnostics(spark, sf_dir), ["mode"], ["stamp", "row_id"], F.col("metric") > 30, 4, "stamp")


@query(f"""WITH {DIAG}, w AS (SELECT run, stamp, lag(stamp) OVER (PARTITION BY run ORDER BY row_id) AS p FROM diag)
  SELECT run, count(CASE WHEN stamp < p - 1e-9 THEN 1 END) AS violations, count(*) AS n FROM w GROUP BY run""")
def monotonic_violation_counts(spark, sf_dir):
    return monotonic_violations(diagnostics(spark, sf_dir), ["run"], ["row_id"], "stamp", 1e-9)




@query(f"""WITH {DIAG}, o AS (SELECT run, row_id, stamp, lead(stamp) OVER (PARTITION BY run ORDER BY stamp, row_id) AS n FROM diag)
  SELECT run, row_id, stamp FROM o WHERE n IS NULL OR n - stamp > 36000""")
def collapse_duplicate_times(spark, sf_dir):
    """Of rows that follow each other within the tolerance the last stays: it replaces the one kept before."""
    d = diagnostics(spark, sf_dir)
    after = F.lead("stamp").over(Window.partitionBy("run").orderBy("stamp", "row_id")) - F.col("stamp")
    return d.withColumn("gap", after).where("gap is null or gap > 36000").select("run", "row_id", "stamp")


@query(f"""WITH {DIAG}, pose AS (SELECT run, stamp, max(metric) AS pose FROM diag WHERE mode = 'click' GROUP BY run, stamp)
  SELECT p.run, p.row_id, x.stamp AS pose_time, x.pose FROM (SELECT * FROM diag WHERE mode <> 'click') p ASOF LEFT JOIN pose x ON p.run = x.run AND p.stamp > x.stamp""")
def asof_latest_pose(spark, sf_dir):
    """Each row with the latest pose of its run strictly before it."""
    d = diagnostics(spark, sf_dir)
    pose = d.where("mode = 'click'").select("run", "stamp", F.col("metric").alias("pose"))
    out = asof_join(d.where("mode <> 'click'").select("run", "row_id", "stamp"), pose, ["run"], "stamp", ["pose"], strict=True)
    return out.select("run", "row_id", F.col("right_time").alias("pose_time"), "pose")


@query(f"""WITH {DIAG}, o AS (SELECT run, stamp AS t0, lead(stamp) OVER (PARTITION BY run ORDER BY stamp, row_id) AS t1, row_id FROM diag WHERE mode IN ('click', 'view'))
  SELECT o.run, o.row_id, count(*) AS samples, round(avg(i.metric), 6) AS mean FROM o JOIN diag i ON i.run = o.run AND i.stamp BETWEEN t0 AND t1
  WHERE t1 - t0 < 500000 GROUP BY o.run, o.row_id HAVING count(*) >= 3""")
def range_join_imu_batch(spark, sf_dir):
    """Spans between poses with at least three samples inside, ends included."""
    d = diagnostics(spark, sf_dir)
    spans = d.where("mode in ('click', 'view')").select("run", "row_id", F.col("stamp").alias("t0"), F.lead("stamp").over(Window.partitionBy("run").orderBy("stamp", "row_id")).alias("t1")).where("t1 - t0 < 500000")
    both = interval_join(d.select("run", "stamp", "metric"), spans, ["run"], "stamp", "t0", "t1", 250_000.0)
    return both.groupBy("run", "row_id").agg(F.count("*").alias("samples"), r6(F.avg("metric"), "mean")).where("samples >= 3")


_SERIES = "a AS (SELECT run, stamp, avg(metric) AS v FROM diag GROUP BY run, stamp)"


@query(f"""WITH {DIAG}, {_SERIES}, ends AS (SELECT run, min(stamp) AS t0, max(stamp) AS t1 FROM a GROUP BY run HAVING count(*) > 1),
  ticks AS (SELECT run, k, t0 + (t1 - t0) * k / 9.0 AS t FROM ends, (SELECT unnest(range(10)) AS k)),
  lo AS (SELECT t.run, t.k, t.t, a.stamp AS ta, a.v AS va FROM ticks t ASOF LEFT JOIN a ON t.run = a.run AND t.t >= a.stamp),
  hi AS (SELECT l.*, a.stamp AS tb, a.v AS vb FROM lo l ASOF LEFT JOIN a ON l.run = a.run AND l.t <= a.stamp)
  SELECT run, CAST(k AS INTEGER) AS k, round(CASE WHEN tb IS NULL OR tb = ta THEN va ELSE va + (vb - va) * (t - ta) / (tb - ta) END, 5) AS v FROM hi""")
def lerp_resample(spark, sf_dir):
    """Ten uniform times of each run, linear between the samples around."""
    d = diagnostics(spark, sf_dir).groupBy("run", "stamp").agg(F.avg("metric").alias("v"))
    ends = d.groupBy("run").agg(F.min("stamp").alias("t0"), F.max("stamp").alias("t1"), F.count("*").alias("n")).where("n > 1")
    ticks = ends.select("run", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"), "t0", "t1")
    ticks = ticks.select("run", "k", (F.col("t0") + (F.col("t1") - F.col("t0")) * F.col("k") / 9.0).alias("stamp"))
    low = asof_join(ticks, d, ["run"], "stamp", ["v"]).withColumnsRenamed({"right_time": "ta", "v": "va"})
    both = asof_join(low, d, ["run"], "stamp", ["v"], forward=True).withColumnsRenamed({"right_time": "tb", "v": "vb"})
    lerp = F.col("va") + (F.col("vb") - F.col("va")) * (F.col("stamp") - F.col("ta")) / (F.col("tb") - F.col("ta"))
    return both.select("run", "k", F.round(F.when(F.col("tb").isNull() | (F.col("tb") == F.col("ta")), F.col("va")).otherwise(lerp), 5).alias("v"))


@query(f"""WITH {DIAG}, s AS (SELECT run, row_id, stamp, metric, metric - lag(metric) OVER w AS d, first_value(metric) OVER w AS f FROM diag WINDOW w AS (PARTITION BY run ORDER BY stamp, row_id))
  SELECT run, count(*) AS n, round(coalesce(sum(abs(d)), 0.0), 5) AS path_length, round(abs(arg_max(metric, {{'t': stamp, 'i': row_id}}) - any_value(f)), 6) AS displacement, max(stamp) - min(stamp) AS duration FROM s GROUP BY run""")
def path_length(spark, sf_dir):
    w = Window.partitionBy("run").orderBy("stamp", "row_id")
    s = diagnostics(spark, sf_dir).withColumn("d", F.col("metric") - F.lag("metric").over(w))
    at = F.struct("stamp", "row_id")
    return s.groupBy("run").agg(
        F.count("*").alias("n"), F.round(F.coalesce(F.sum(F.abs("d")), F.lit(0.0)), 5).alias("path_length"),
        r6(F.abs(F.max_by("metric", at) - F.min_by("metric", at)), "displacement"), (F.max("stamp") - F.min("stamp")).alias("duration"))


@query(f"""WITH {DIAG}, j AS (SELECT run, row_id, (metric - lag(metric) OVER w) / nullif(stamp - lag(stamp) OVER w, 0) AS jerk FROM diag WINDOW w AS (PARTITION BY run ORDER BY stamp, row_id))
  SELECT run, row_id, round(coalesce(jerk, 0.0), 6) AS jerk FROM j""")
def jerk_series(spark, sf_dir):
    """Change over time between samples; 0 at the first."""
    w = Window.partitionBy("run").orderBy("stamp", "row_id")
    dt = F.col("stamp") - F.lag("stamp").over(w)
    return diagnostics(spark, sf_dir).select("run", "row_id", r6(F.coalesce((F.col("metric") - F.lag("metric").over(w)) / F.nullif(dt, F.lit(0.0)), F.lit(0.0)), "jerk"))


@query(f"""WITH {DIAG}, m AS (SELECT run, row_id, lead(stamp) OVER w - stamp AS dt, (metric + lead(metric) OVER w) / 2 AS mid FROM diag WINDOW w AS (PARTITION BY run ORDER BY stamp, row_id))
  SELECT run, row_id, round(mid, 6) AS mid, dt FROM m WHERE dt > 0 AND dt < 600000""")
def midpoint_average(spark, sf_dir):
    w = Window.partitionBy("run").orderBy("stamp", "row_id")
    d = diagnostics(spark, sf_dir).select("run", "row_id", (F.lead("stamp").over(w) - F.col("stamp")).alias("dt"), r6((F.col("metric") + F.lead("metric").over(w)) / 2, "mid"))
    return d.where("dt > 0 and dt < 600000").select("run", "row_id", "mid", "dt")


def starvation_step(state: int | None, ratio: float) -> int:
    """Frames of starvation: under 0.02 one more, over 0.10 none, between as before."""
    n = state or 0
    return min(n + 1, 1_000_000) if ratio < 0.02 else 0 if ratio > 0.10 else n


def _starve(state, row):
    n = starvation_step(state, row[1])
    return n, (row[0], n)


@query(f"""WITH RECURSIVE {DIAG}, o AS (SELECT run, row_id, metric / 500.0 AS ratio, row_number() OVER (PARTITION BY run ORDER BY stamp, row_id) AS k FROM diag),
  s AS (SELECT run, row_id, k, CASE WHEN ratio < 0.02 THEN 1 ELSE 0 END AS frames FROM o WHERE k = 1
    UNION ALL SELECT o.run, o.row_id, o.k, CASE WHEN o.ratio < 0.02 THEN s.frames + 1 WHEN o.ratio > 0.10 THEN 0 ELSE s.frames END FROM s JOIN o ON o.run = s.run AND o.k = s.k + 1)
  SELECT run, row_id, CAST(frames AS BIGINT) AS frames FROM s""")
def starvation_counter(spark, sf_dir):
    d = diagnostics(spark, sf_dir).withColumn("ratio", F.col("metric") / 500.0)
    return ordered_fold(d, ["run"], ["stamp", "row_id"], ["row_id", "ratio"], None, _starve, "row_id long, frames long")


@query("""SELECT length(props) AS width, count(*) AS n, count(CASE WHEN NOT isfinite(value) THEN 1 END) AS nonfinite FROM events GROUP BY 1""")
def width_histogram(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    bad = F.isnan("value") | (F.abs("value") == float("inf"))
    return e.groupBy(F.length("props").cast("long").alias("width")).agg(F.count("*").alias("n"), F.count(F.when(bad, 1)).alias("nonfinite"))
