"""Joins of irregular series and of points: as-of, interval, grid neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: list[str], time: str, values: list[str], strict: bool = False, forward: bool = False) -> DataFrame:
    """Each left row with the nearest right row of its key before it (after it, if ``forward``).

    Union and a running last value: one shuffle and one sort. ``strict``: not at the same time. Of right rows
    at one time the one with the greatest values counts. Without a match the values are null.
    """
    cols = [c for c in left.columns]
    lhs = left.select(*cols, F.lit(None).cast(right.select(F.struct(time, *values)).schema[0].dataType).alias("_r"), F.lit(1).alias("_left"))
    rhs = right.groupBy(*key, time).agg(F.max(F.struct(time, *values)).alias("_r")).select(*[F.col(c) if c in (*key, time) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], "_r", F.lit(0).alias("_left"))
    ahead = F.col(time).desc() if forward else F.col(time).asc()
    first = F.col("_left").desc() if strict else F.col("_left").asc()
    w = Window.partitionBy(*key).orderBy(ahead, first).rowsBetween(Window.unboundedPreceding, 0)
    rows = lhs.unionByName(rhs).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_left = 1")
    return rows.select(*cols, F.col(f"_r.{time}").alias("right_time"), *[F.col(f"_r.{v}").alias(v) for v in values])


def interval_join(points: DataFrame, spans: DataFrame, key: list[str], time: str, start: str, end: str, width: float) -> DataFrame:
    """Points inside spans of their key. Spans are dealt to buckets of ``width``, so it is an equi-join."""
    p = points.withColumn("_bucket", F.floor(F.col(time) / width))
    s = spans.where(F.col(start) <= F.col(end)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(s, [*key, "_bucket"]).where(F.col(time).between(F.col(start), F.col(end))).drop("_bucket")


def cell(axis: str, size: float) -> Column:
    return F.floor(F.col(axis) / F.lit(float(size)))


def with_voxel(df: DataFrame, size: float) -> DataFrame:
    """Voxel indices floor(p / size); negative places round down too."""
    return df.withColumns({f"v{a}": cell(a, size) for a in "xyz"})


def grid_neighbours(queries: DataFrame, targets: DataFrame, radius: float, key: list[str] = ()) -> DataFrame:
    """All (query, target) pairs within ``radius``: targets go to the 27 cells around theirs, then an equi-join.

    Expects columns x, y, z on both; those of targets come out as tx, ty, tz with its other columns.
    """
    around = F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip((dx, dy, dz), ("dx", "dy", "dz"))]) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1)])
    t = targets.withColumnsRenamed({a: f"t{a}" for a in "xyz"}).withColumn("_d", F.explode(around))
    t = t.withColumns({f"v{a}": F.floor(F.col(f"t{a}") / radius) + F.col(f"_d.d{a}") for a in "xyz"}).drop("_d")
    pairs = with_voxel(queries, radius).join(t, [*key, "vx", "vy", "vz"])
    d2 = reduce(lambda a, b: a + b, [(F.col(a) - F.col(f"t{a}")) * (F.col(a) - F.col(f"t{a}")) for a in "xyz"])
    return pairs.withColumn("d2", d2).where(F.col("d2") <= radius * radius).drop("vx", "vy", "vz")
