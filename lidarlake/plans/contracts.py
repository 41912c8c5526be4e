"""Contracts of runs over the tables at hand: users are runs, their events are settings and manifest lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lidarlake.operators import contracts as K
from lidarlake.plans.catalog import Catalog
from lidarlake.sources.adapters import table

_catalog = Catalog()
query, QUERIES, SQL = _catalog.query, _catalog.queries, _catalog.sql
_C = F.col

SWITCHES = ("degeneracy_aware_en", "coupled_degeneracy_en", "normal_balance_en", "robust_kernel_en", "vio_quality_en")
_MODES = ("full", "all_off", "legacy_3x3", "coupled_6x6", "stock_baseline")
ARTIFACTS = ("mapping", "liblio.so", "libvio.so", "libpre.so")


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _nth(words, by):
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(by, F.lit(len(words))) + 1).cast("int"))


_RUNS = f"runs AS (SELECT DISTINCT user_id AS run, {_list(_MODES)}[CAST(user_id % 5 + 1 AS INTEGER)] AS mode FROM events)"
_ACTUAL = f"""actual AS (SELECT user_id AS run, {_list(SWITCHES)}[CAST(event_id % 5 + 1 AS INTEGER)] AS name, CASE WHEN max(value) > 160 THEN 'maybe' WHEN count(*) % 2 = 0 THEN 'true' ELSE 'false' END AS value FROM events GROUP BY 1, 2)"""
_EXPECTED = "CASE WHEN mode = 'legacy_3x3' AND name = 'degeneracy_aware_en' OR mode = 'coupled_6x6' AND name IN ('degeneracy_aware_en', 'coupled_degeneracy_en') THEN 'true' WHEN mode = 'full' THEN 'true' ELSE 'false' END"


def runs(spark, sf_dir):
    return table(spark, sf_dir, "events").select(_C("user_id").alias("run")).distinct().withColumn("mode", _nth(_MODES, _C("run")))


def actual(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(_C("user_id").alias("run"), _nth(SWITCHES, _C("event_id")).alias("name"))
    return e.agg(F.when(F.max("value") > 160, "maybe").when(F.count("*") % 2 == 0, "true").otherwise("false").alias("value"))


_SWITCH_SQL = f"""WITH {_RUNS}, {_ACTUAL}, w AS (SELECT run, mode, unnest({_list(SWITCHES)}) AS name FROM runs),
  b AS (SELECT w.run, w.name, {_EXPECTED.replace("name", "w.name")} AS expected, value FROM w LEFT JOIN actual a ON w.run = a.run AND w.name = a.name),
  v AS (SELECT run, CASE WHEN value IS NULL OR value NOT IN ('true', 'false') THEN 'type' WHEN value <> expected THEN 'value' END AS rule, name AS subject FROM b)"""


@query(f"{_SWITCH_SQL} SELECT run, rule, subject FROM v WHERE rule IS NOT NULL")
def switch_matrix(spark, sf_dir):
    """Switches of each run that are not what its mode asks for."""
    return K.switch_violations(runs(spark, sf_dir), actual(spark, sf_dir), SWITCHES)


@query(f"""{_SWITCH_SQL}, n AS (SELECT run, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY run)
  SELECT runs.run, coalesce(n, 0) AS n_errors, n IS NULL AS valid, CASE WHEN n IS NULL THEN 0 ELSE 1 END AS exit_code FROM runs LEFT JOIN n ON runs.run = n.run""")
def run_verdicts(spark, sf_dir):
    """Errors, validity and exit code of each run."""
    return K.verdicts(runs(spark, sf_dir), switch_matrix(spark, sf_dir))


@query(f"""{_SWITCH_SQL}, ok AS (SELECT DISTINCT mode FROM runs WHERE run NOT IN (SELECT run FROM v WHERE rule IS NOT NULL))
  SELECT CASE WHEN count(*) FILTER (WHERE mode = 'stock_baseline') > 0 THEN 'stock_baseline' WHEN count(*) FILTER (WHERE mode = 'all_off') > 0 THEN 'all_off' END AS reference FROM ok""")
def reference_selection(spark, sf_dir):
    """The valid run that the others are compared with."""
    ok = runs(spark, sf_dir).join(switch_matrix(spark, sf_dir), "run", "left_anti").select("mode").distinct()
    return K.reference_run(ok)


_TREES = f"""flat AS (SELECT s_nationkey AS run, CASE s_suppkey % 7 WHEN 0 THEN 'run_id' WHEN 1 THEN 'adaptive/robust_kernel_en' ELSE 'lio/p' || (s_suppkey % 23) END AS path, CAST(min(s_suppkey % 3) AS VARCHAR) AS value FROM supplier GROUP BY 1, 2),
  t AS (SELECT * FROM flat WHERE path <> 'run_id' AND path <> 'adaptive/robust_kernel_en'), ref AS (SELECT path, value FROM t WHERE run = 3), o AS (SELECT * FROM t WHERE run <> 3)"""


@query(f"""WITH {_TREES} SELECT run, CASE WHEN ref.path IS NULL THEN 'extra' ELSE 'value' END AS rule, o.path AS subject FROM o LEFT JOIN ref ON o.path = ref.path WHERE ref.path IS NULL OR o.value IS DISTINCT FROM ref.value
  UNION ALL SELECT r.run, 'missing', ref.path FROM (SELECT DISTINCT run FROM o) r, ref WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.run = r.run AND o.path = ref.path)""")
def parameter_trees(spark, sf_dir):
    """Parameters of each run that differ from the reference run's, volatile keys and switches aside."""
    s = _C("s_suppkey")
    path = F.when(s % 7 == 0, "run_id").when(s % 7 == 1, "adaptive/robust_kernel_en").otherwise(F.concat(F.lit("lio/p"), (s % 23).cast("string")))
    flat = table(spark, sf_dir, "supplier").groupBy(_C("s_nationkey").alias("run"), path.alias("path")).agg(F.min(s % 3).cast("string").alias("value"))
    return K.tree_differences(K.stable_parameters(flat, SWITCHES), 3)


_LINE = f"""lines AS (SELECT user_id AS run, event_id AS line_no, {_list((*ARTIFACTS, "stray.so"))}[CAST(event_id % 5 + 1 AS INTEGER)] || CASE event_id % 9 WHEN 0 THEN '  one two' WHEN 1 THEN ' ABC' ELSE '  ' || sha256(event_type) END AS line FROM events)"""


@query(f"""WITH {_LINE}, f AS (SELECT run, line_no, string_split(trim(regexp_replace(line, '\\s+', ' ', 'g')), ' ') AS f FROM lines), n AS (SELECT run, f[1] AS name, f[2] AS digest FROM f WHERE len(f) = 2), c AS (SELECT run, name, count(*) AS n FROM n GROUP BY ALL)
  SELECT run, 'fields' AS rule, CAST(line_no AS VARCHAR) AS subject FROM f WHERE len(f) <> 2 UNION ALL SELECT run, 'digest', name FROM n WHERE NOT regexp_full_match(digest, '[0-9a-f]{{64}}')
  UNION ALL SELECT run, 'duplicate', name FROM c WHERE n > 1 UNION ALL SELECT run, 'extra', name FROM c WHERE name NOT IN ({_list(ARTIFACTS)[1:-1]})
  UNION ALL SELECT r.run, 'missing', a.name FROM (SELECT DISTINCT run FROM lines) r, (SELECT unnest({_list(ARTIFACTS)}) AS name) a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.run = r.run AND c.name = a.name)""")
def manifest_lines(spark, sf_dir):
    """What is wrong with each run's list of artifacts and digests."""
    e = table(spark, sf_dir, "events")
    tail = F.when(_C("event_id") % 9 == 0, "  one two").when(_C("event_id") % 9 == 1, " ABC").otherwise(F.concat(F.lit("  "), F.sha2("event_type", 256)))
    lines = e.select(_C("user_id").alias("run"), _C("event_id").alias("line_no"), F.concat(_nth((*ARTIFACTS, "stray.so"), _C("event_id")), tail).alias("line"))
    return K.manifest_violations(lines, ARTIFACTS)


@query("SELECT event_type AS mode, count(*) AS n, count(*) = count(DISTINCT user_id) AS distinct_ FROM events GROUP BY event_type")
def requested_once(spark, sf_dir):
    """Whether what was requested is named once each."""
    return table(spark, sf_dir, "events").groupBy(_C("event_type").alias("mode")).agg(F.count("*").alias("n"), (F.count("*") == F.countDistinct("user_id")).alias("distinct_"))


#: Settings with the range outside of which a configuration is refused (fixed values).
RANGES = {"max_layer": (0, 64), "voxel_size": (1e-4, 1e4), "sigma_num": (1e-3, 1e3), "max_points_num": (1, 1e7), "sliding_thresh": (1e-6, 1e9)}
_RANGE = ", ".join(f"('{k}', CAST({low} AS DOUBLE), CAST({high} AS DOUBLE))" for k, (low, high) in RANGES.items())


@query(f"""WITH r(name, low, high) AS (VALUES {_RANGE}), s AS (SELECT event_id, {_list(RANGES)}[CAST(event_id % 5 + 1 AS INTEGER)] AS name, CASE WHEN event_id % 50 = 0 THEN CAST('nan' AS DOUBLE) ELSE value - 30 END AS value FROM events)
  SELECT event_id, s.name, isnan(value) OR value < low OR value > high AS refused, CASE WHEN isnan(value) THEN low ELSE least(greatest(value, low), high) END AS clamped FROM s JOIN r ON s.name = r.name""")
def setting_ranges(spark, sf_dir):
    """Settings against their ranges: refused by the strict policy, brought to the nearest bound (the lower, if no number) by the lenient one."""
    value = F.when(_C("event_id") % 50 == 0, float("nan")).otherwise(_C("value") - 30)
    s = table(spark, sf_dir, "events").select("event_id", _nth(tuple(RANGES), _C("event_id")).alias("name"), value.alias("value"))
    low, high = (F.element_at(F.create_map(*[F.lit(x) for k, r in RANGES.items() for x in (k, float(r[side]))]), _C("name")) for side in (0, 1))
    s = s.withColumns({"low": low, "high": high})
    return s.select("event_id", "name", (F.isnan("value") | (_C("value") < _C("low")) | (_C("value") > _C("high"))).alias("refused"), F.when(F.isnan("value"), _C("low")).otherwise(F.least(F.greatest("value", "low"), "high")).alias("clamped"))
