"""Streams that meet in time, and evidence that ages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def package(scans: DataFrame, samples: DataFrame, key: str = "run", span: str = "100 milliseconds", lateness: str = "1 second") -> DataFrame:
    """Scans (key, ts, scan_id) with the samples (key, ts, value) of the ``span`` before them: an interval join.

    Both sides have watermarks, so state is dropped once nothing can match any more. In batch the same rows come out.
    """
    s = samples.withWatermark("ts", lateness).withColumnsRenamed({key: "_key", "ts": "sample_ts"})
    return scans.withWatermark("ts", lateness).join(s, F.expr(f"{key} = _key and sample_ts > ts - interval {span} and sample_ts <= ts")).drop("_key")


def evidence(hits: DataFrame, window: str = "20 seconds", slide: str = "4 seconds", lateness: str = "1 second") -> DataFrame:
    """Hits (ts, vx, vy, vz, occupied) to counts of each voxel in sliding windows: evidence expires with its window."""
    return hits.withWatermark("ts", lateness).groupBy(F.window("ts", window, slide), "vx", "vy", "vz").agg(
        F.count(F.when(F.col("occupied"), 1)).alias("occupied_hits"), F.count(F.when(~F.col("occupied"), 1)).alias("free_hits"))


def append_diagnostics(stream: DataFrame, path: str, checkpoint: str):
    """Diagnostics to Parquet, each row once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
