"""Contracts of experiment runs as relations: switches, parameter trees, manifests, aggregate verdicts.

All inputs are long tables of (run, name, value); every rule gives rows of (run, rule, subject), so that a report is a union."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs are compared with the first of these that is valid (fixed values).
REFERENCES = ("stock_baseline", "all_off")
#: Modes that turn some switches on against their default (fixed values); in "full" all are on, elsewhere off.
MODE_SWITCHES = {"legacy_3x3": {"degeneracy_aware_en": True, "coupled_degeneracy_en": False}, "coupled_6x6": {"degeneracy_aware_en": True, "coupled_degeneracy_en": True}}
#: Parameter keys that differ from run to run anyway (fixed values).
VOLATILE = ("rosdistro", "roslaunch", "rosversion", "run_id")

_C = F.col


def expected_switches(modes: DataFrame, switches: tuple[str, ...]) -> DataFrame:
    """(mode, name, expected) of each mode of ``modes(mode)`` and each switch."""
    out = modes.select("mode", F.explode(F.array(*map(F.lit, switches))).alias("name"))
    value = _C("mode") == "full"
    for mode, special in MODE_SWITCHES.items():
        for name, on in special.items():
            value = F.when((_C("mode") == mode) & (_C("name") == name), on).otherwise(value)
    return out.withColumn("expected", value)


def switch_violations(runs: DataFrame, actual: DataFrame, switches: tuple[str, ...]) -> DataFrame:
    """(run, rule, subject): switches that are missing or no boolean ("type") or have another value than the mode asks for ("value").

    ``runs(run, mode)``; ``actual(run, name, value)`` with values as text."""
    wanted = runs.join(F.broadcast(expected_switches(runs.select("mode").distinct(), switches)), "mode")  # modes x switches
    both = wanted.join(actual, ["run", "name"], "left")
    boolean = F.coalesce(_C("value").isin("true", "false"), F.lit(False))
    rule = F.when(~boolean, "type").when(_C("value") != _C("expected").cast("string"), "value")
    return both.withColumn("rule", rule).where("rule is not null").select("run", "rule", _C("name").alias("subject"))


def stable_parameters(flat: DataFrame, switches: tuple[str, ...]) -> DataFrame:
    """``flat(run, path, value)`` without volatile keys and without the switches of the adaptive subtree: what must agree across runs."""
    root = F.substring_index("path", "/", 1)
    return flat.where(~root.isin(*VOLATILE) & ~_C("path").isin(*[f"adaptive/{s}" for s in switches]))


def tree_differences(trees: DataFrame, reference: str) -> DataFrame:
    """(run, rule, subject): paths that a run has and the reference run has not ("extra"), lacks ("missing") or has another value of ("value").

    One grouping by path of the reference, one equi-join; null equals null."""
    ref = trees.where(_C("run") == reference).select("path", _C("value").alias("wanted"), F.lit(True).alias("known"))
    others = trees.where(_C("run") != reference)
    here = others.join(ref, "path", "left")
    rule = F.when(_C("known").isNull(), "extra").when(~_C("value").eqNullSafe(_C("wanted")), "value")
    here = here.withColumn("rule", rule).where("rule is not null").select("run", "rule", _C("path").alias("subject"))
    pairs = others.select("run").distinct().join(ref.select("path"))  # runs x the parameters of one run
    return here.unionByName(pairs.join(others, ["run", "path"], "left_anti").select("run", F.lit("missing").alias("rule"), _C("path").alias("subject")))


def manifest_violations(lines: DataFrame, artifacts: tuple[str, ...]) -> DataFrame:
    """(run, rule, subject) of ``lines(run, line_no, line)``: "fields" unless a name and a digest, "digest" unless 64 lower-case hex digits,
    "duplicate" for a name met before, "missing" and "extra" against the exact set of artifacts."""
    fields = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    rows = lines.withColumn("fields", fields)
    odd = rows.where(F.size("fields") != 2).select("run", F.lit("fields").alias("rule"), _C("line_no").cast("string").alias("subject"))
    named = rows.where(F.size("fields") == 2).select("run", "line_no", _C("fields")[0].alias("name"), _C("fields")[1].alias("digest"))
    digest = named.where(~_C("digest").rlike("^[0-9a-f]{64}$")).select("run", F.lit("digest").alias("rule"), _C("name").alias("subject"))
    counts = named.groupBy("run", "name").agg(F.count("*").alias("n"))
    again = counts.where("n > 1").select("run", F.lit("duplicate").alias("rule"), _C("name").alias("subject"))
    extra = counts.where(~_C("name").isin(*artifacts)).select("run", F.lit("extra").alias("rule"), _C("name").alias("subject"))
    wanted = lines.select("run").distinct().select("run", F.explode(F.array(*map(F.lit, artifacts))).alias("name"))
    missing = wanted.join(counts, ["run", "name"], "left_anti").select("run", F.lit("missing").alias("rule"), _C("name").alias("subject"))
    out = odd
    for part in (digest, again, extra, missing):
        out = out.unionByName(part)
    return out


def reference_run(valid: DataFrame) -> DataFrame:
    """(reference) of ``valid(mode)``: the first of REFERENCES that is there, else null; always one row."""
    place = F.array_position(F.array(*map(F.lit, REFERENCES)), _C("mode"))
    return valid.where(_C("mode").isin(*REFERENCES)).agg(F.min_by("mode", place).alias("reference"))


def verdicts(runs: DataFrame, violations: DataFrame) -> DataFrame:
    """(run, n_errors, valid, exit_code) of every run, those without violations included."""
    n = violations.groupBy("run").agg(F.count("*").alias("n"))
    return runs.select("run").join(n, "run", "left").select("run", F.coalesce("n", F.lit(0)).alias("n_errors"), _C("n").isNull().alias("valid"), F.when(_C("n").isNull(), 0).otherwise(1).alias("exit_code"))
