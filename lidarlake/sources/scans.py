"""Decoders of vendor scans into canonical points: scan_id, idx, x, y, z, intensity, offset_ms, ring.

Every decoder drops what is not finite or inside the blind radius, sanitises intensity, brings time to
milliseconds from the scan's begin and leaves rows keyed by (scan_id, idx); nothing depends on row order.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lidarlake.functions.scalar import finite
from lidarlake.operators.fold import ordered_fold

#: Degrees a spinning sensor turns in a millisecond, and the pause put in place of a jump in time (fixed values).
TURN_PER_MS, REPAIR_MS, JUMP_MS = 3.61, 0.004166667, 1.0
_POINT = ("scan_id", "idx", "x", "y", "z", "intensity", "offset_ms", "ring")


def intensity(c: Column) -> Column:
    return F.when(finite(c.cast("double")), F.greatest(c.cast("double"), F.lit(0.0))).otherwise(0.0)


def usable(df: DataFrame, blind: float, strict: bool = False) -> DataFrame:
    """Finite places outside the blind radius (on it too, unless ``strict``)."""
    r2 = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")
    ok = finite(F.col("x").cast("double")) & finite(F.col("y").cast("double")) & finite(F.col("z").cast("double"))
    return df.where(ok & ((r2 > blind * blind) if strict else (r2 >= blind * blind)))


def _repair(state, row):
    idx, offset = row
    if state is None:
        offset = offset if abs(offset) < JUMP_MS else 0.0
    elif abs(offset - state) >= JUMP_MS:
        offset = state + REPAIR_MS
    return offset, (idx, offset)


def repaired_times(df: DataFrame) -> DataFrame:
    """Offsets where each that jumps from the repaired one before it is put right behind it."""
    fixed = ordered_fold(df, ["scan_id"], ["idx"], ["idx", "offset_ms"], None, _repair, "idx long, fixed double")
    return df.join(fixed, ["scan_id", "idx"]).withColumn("offset_ms", F.col("fixed")).drop("fixed")


def livox(raw: DataFrame, lines: int = 6, blind: float = 0.5, stride: int = 1, tagged_only: bool = False) -> DataFrame:
    """raw: scan_id, idx, point_num, x, y, z, reflectivity, tag, line, offset_time (ns). The stride counts lines in range, before the blind radius."""
    df = raw.where((F.col("line") < lines) & (F.col("idx") < F.col("point_num")))
    if tagged_only:
        df = df.where(F.col("tag").bitwiseAND(0x30) == 0x10)
    df = df.select("scan_id", F.col("idx").cast("long").alias("idx"), "x", "y", "z", intensity(F.col("reflectivity")).alias("intensity"), (F.col("offset_time") / 1e6).alias("offset_ms"), F.col("line").alias("ring"))
    df = repaired_times(df)
    n = F.row_number().over(Window.partitionBy("scan_id").orderBy("idx"))
    df = df.withColumn("_n", n).where(F.col("_n") % stride == 0).drop("_n") if stride > 1 else df
    return usable(df, blind).select(*_POINT)


def absolute_time(raw: DataFrame, blind: float, time: str = "timestamp", scale: float = 1.0, strict: bool = False) -> DataFrame:
    """Sensors that stamp each return in seconds: milliseconds from the scan's first finite stamp."""
    t = F.when(finite(F.col(time)), F.col(time))
    first = raw.groupBy("scan_id").agg(F.min(t).alias("_first"))
    df = raw.join(first, "scan_id").where(finite(F.col(time)))
    df = df.select("scan_id", F.col("idx").cast("long").alias("idx"), "x", "y", "z", (intensity(F.col("intensity")) / scale).alias("intensity"), ((F.col(time) - F.col("_first")) * 1000).alias("offset_ms"), "ring")
    return usable(df, blind, strict).select(*_POINT)


def pandar128(raw: DataFrame, blind: float = 0.5) -> DataFrame:
    return absolute_time(raw, blind, strict=True)


def robosense(raw: DataFrame, blind: float = 0.5) -> DataFrame:
    return absolute_time(raw, blind)


def ouster(raw: DataFrame, blind: float = 0.5) -> DataFrame:
    """``t`` in nanoseconds from the scan's begin."""
    df = raw.select("scan_id", F.col("idx").cast("long").alias("idx"), "x", "y", "z", intensity(F.col("intensity")).alias("intensity"), (F.col("t") / 1e6).alias("offset_ms"), "ring")
    return usable(df, blind).select(*_POINT)


def l515(raw: DataFrame, blind: float = 0.5) -> DataFrame:
    """Colour instead of intensity, no times."""
    df = raw.select("scan_id", F.col("idx").cast("long").alias("idx"), "x", "y", "z", F.lit(0.0).alias("intensity"), F.lit(0.0).alias("offset_ms"), F.lit(0).alias("ring"), "r", "g", "b")
    return usable(df, blind).select(*_POINT, "r", "g", "b")


def _turn(state, row, omega: float):
    """First return of a ring: no output. Times follow the angle turned; they never go back."""
    idx, yaw = row
    if state is None:
        return (yaw, 0.0), None
    first, last = state
    t = (first - yaw if yaw <= first else first - yaw + 360.0) / omega
    if t < last:
        t += 360.0 / omega
    return (first, t), (idx, t)


def spinning(raw: DataFrame, blind: float = 0.5, omega: float = TURN_PER_MS) -> DataFrame:
    """Velodyne and XT32 without times: offsets from the angle turned since the ring's first return."""
    df = raw.select("scan_id", F.col("idx").cast("long").alias("idx"), "x", "y", "z", intensity(F.col("intensity")).alias("intensity"), "ring").withColumn("yaw", F.atan2("y", "x") * (180 / math.pi))
    times = ordered_fold(df, ["scan_id", "ring"], ["idx"], ["idx", "yaw"], None, partial(_turn, omega=omega), "idx long, offset_ms double")
    return usable(df.join(times, ["scan_id", "ring", "idx"]), blind, strict=True).select(*_POINT)


def velodyne(raw: DataFrame, blind: float = 0.5) -> DataFrame:
    """Times in microseconds if the scan has them, else from the angle."""
    timed = raw.groupBy("scan_id").agg((F.max_by("time", "idx") > 0).alias("_timed"))
    df = raw.join(timed, "scan_id")
    given = df.where("_timed").select("scan_id", F.col("idx").cast("long").alias("idx"), "x", "y", "z", intensity(F.col("intensity")).alias("intensity"), (F.col("time") / 1000.0).alias("offset_ms"), "ring")
    return usable(given, blind, strict=True).select(*_POINT).unionByName(spinning(df.where("not _timed").drop("_timed"), blind))


def _apart(state, row, tolerance: float):
    here = row[1:]
    if state is not None and all(abs(a - b) <= tolerance for a, b in zip(here, state)):
        return state, None
    return here, (row[0],)


def drop_repeats(points: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Without returns that lie where the last kept one of their ring lies."""
    kept = ordered_fold(points, ["scan_id", "ring"], ["idx"], ["idx", "x", "y", "z"], None, partial(_apart, tolerance=tolerance), "idx long")
    return points.join(kept, ["scan_id", "ring", "idx"], "left_semi").select(*points.columns)
