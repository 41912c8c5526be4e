"""Text files of runs: ragged CSV, poses, key=value status, timing, manifests; and the sinks of reports."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_number from 1, line); files are read whole, one task each, so numbers are right."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", r"\r\n?", "\n").alias("text"))
    rows = whole.select("path", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return rows.select("path", (F.col("k") + 1).alias("line_number"), "line")


def ragged_csv(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_number, header, cells): rows as wide as their file's header; others are left out."""
    rows = lines(spark, path).withColumn("cells", F.split("line", ","))
    head = rows.where("line_number = 1").select("path", F.col("cells").alias("header"))
    return rows.where("line_number > 1").join(head, "path").where(F.size("cells") == F.size("header")).select("path", "line_number", "header", "cells")


def cell(prefix: str) -> Column:
    """The cell of the first column whose name begins with ``prefix``, as a number."""
    at = F.array_position(F.transform("header", lambda h: F.startswith(F.trim(h), F.lit(prefix))), True)
    return F.get("cells", (at - 1).cast("int")).try_cast("double")


def poses(spark: SparkSession, path: str) -> DataFrame:
    """stamp, px, py, pz, qx, qy, qz, qw: lines of exactly eight numbers."""
    parts = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.try_cast("double"))
    rows = lines(spark, path).withColumn("v", parts).where((F.size("v") == 8) & ~F.exists("v", lambda x: x.isNull()))
    return rows.select(*[F.col("v")[k].alias(n) for k, n in enumerate(("stamp", "px", "py", "pz", "qx", "qy", "qz", "qw"))])


def key_values(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(path, key, value) with the last of repeated keys, and (path, line_number, error)."""
    rows = lines(spark, path).where("line != '' and not startswith(line, '#')")
    rows = rows.withColumns({"at": F.instr("line", "="), "key": F.trim(F.substring_index("line", "=", 1))})
    good = rows.where("at > 0 and key != ''").withColumn("value", F.trim(F.expr("substring(line, at + 1)")))
    values = good.groupBy("path", "key").agg(F.max_by("value", "line_number").alias("value"))
    first = good.groupBy("path", "key").agg(F.min("line_number").alias("first"))
    bad = rows.where("at = 0").select("path", "line_number", F.lit("expected key=value").alias("error"))
    bad = bad.unionByName(rows.where("at > 0 and key = ''").select("path", "line_number", F.lit("empty key").alias("error")))
    again = good.join(first, ["path", "key"]).where("line_number > first").select("path", "line_number", F.concat(F.lit("duplicate key "), "key").alias("error"))
    return values, bad.unionByName(again)


def timing(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value): lines cut at their last ``": "``."""
    rows = lines(spark, path).select("path", F.regexp_extract("line", r"^\s*(.*): (.*)$", 1).alias("key"), F.regexp_extract("line", r"^\s*(.*): (.*)$", 2).alias("value"))
    return rows.where("key != ''")


#: What a complete run's status must say (fixed values).
STATUS_EQUAL = {"stage": "complete", "success": "true", "script_exit": "0", "player_exit": "0", "node_exit": "0", "record_exit": "0", "player_timed_out": "false", "node_timed_out": "false", "record_timed_out": "false", "health_failure": "none", "contract_version": "3", "use_sim_time": "true"}
STATUS_DIGESTS = ("bag_sha256", "source_config_sha256", "camera_config_sha256", "mapping_binary_sha256", "runtime_bundle_sha256", "parameters_sha256")
STATUS_POSITIVE = ("bag_bytes", "duration", "rate")
STATUS_OTHER = ("mode", "compressed_image", "republisher_alive_through_run", "bag_realpath")


def status_violations(status: DataFrame) -> DataFrame:
    """(run, key, error) of ``status(run, key, value)``: a table of rules meets each run's keys; all rules are tried."""
    spark = status.sparkSession
    rules = [(k, "equal", v) for k, v in STATUS_EQUAL.items()] + [(k, "digest", "") for k in STATUS_DIGESTS] + [(k, "positive", "") for k in STATUS_POSITIVE] + [(k, "present", "") for k in STATUS_OTHER]
    rules = F.broadcast(spark.createDataFrame(rules, "key string, rule string, want string"))
    want = status.select("run").distinct().crossJoin(rules)
    both = want.join(status, ["run", "key"], "left")
    v, number = F.col("value"), F.col("value").try_cast("double")
    error = (
        F.when(v.isNull(), "missing").when((F.col("rule") == "equal") & (v != F.col("want")), F.concat(F.lit("expected "), "want"))
        .when((F.col("rule") == "digest") & ~v.rlike("^[0-9a-f]{64}$"), "not a lowercase SHA-256 digest")
        .when((F.col("rule") == "positive") & ~F.coalesce((number > 0) & (number < float("inf")), F.lit(False)), "not a positive finite number"))
    return both.withColumn("error", error).where("error is not null").select("run", "key", "error")


def flatten(tree: object, path: str = "") -> list[tuple[str, str, str]]:
    """(path, type, JSON) of a parsed parameter tree."""
    if isinstance(tree, dict):
        return [x for k, v in tree.items() for x in flatten(v, f"{path}/{k}" if path else str(k))]
    return [(path, type(tree).__name__, json.dumps(tree))]


def non_finite(tree: object, path: str = "") -> list[str]:
    return [p for p, kind, value in flatten(tree, path) if kind == "float" and not math.isfinite(float(json.loads(value)))]


def canonical_digest(value: object) -> str:
    """SHA-256 of JSON with sorted keys and no blanks; what is not finite is refused."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def report_json(rows: DataFrame) -> Column:
    """A row as JSON with its keys in order; null for what is not finite."""
    fields = [F.when(~F.isnan(f.name) & (F.abs(f.name) < float("inf")), F.col(f.name)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in sorted(rows.schema, key=lambda f: f.name)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
