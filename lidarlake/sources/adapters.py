"""Sensor-shaped views of the tables at hand, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan, idx, x, y, z, intensity, offset_ms: the first places of each embedding as a return of a scan."""
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")  # noqa: E731 - null beyond the end, as in SQL
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("scan"), F.col("vec_id").alias("idx"), (e(0) * 20).alias("x"), (e(1) * 20).alias("y"), (e(2) * 20).alias("z"),
        (F.abs(e(3)) * 255).alias("intensity"), ((e(4) + 1) * 50).alias("offset_ms"))


POINTS = """points AS (
  SELECT CAST(label AS BIGINT) AS scan, vec_id AS idx, CAST(embedding[1] AS DOUBLE) * 20 AS x, CAST(embedding[2] AS DOUBLE) * 20 AS y,
         CAST(embedding[3] AS DOUBLE) * 20 AS z, abs(CAST(embedding[4] AS DOUBLE)) * 255 AS intensity, (CAST(embedding[5] AS DOUBLE) + 1) * 50 AS offset_ms
  FROM embeddings)"""


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mode, row_id, stamp (seconds), metric, run: events as rows of diagnostics of runs."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("mode"), F.col("event_id").alias("row_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("stamp"),
        F.col("value").alias("metric"), F.col("user_id").alias("run"))


DIAG = """diag AS (
  SELECT event_type AS mode, event_id AS row_id, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS stamp, value AS metric, user_id AS run FROM events)"""
