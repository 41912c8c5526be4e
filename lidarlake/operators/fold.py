"""Order-dependent operators: folds over sorted keys in constant memory, streaks, islands."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Step = Callable[[Any, tuple], tuple[Any, tuple | None]]


def _fold(batches, n_key: int, n_in: int, start: Any, step: Step, names: list[str], types: list[pa.DataType]):
    now, state = object(), None
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        out = []
        for row in zip(*cols):
            if row[:n_key] != now:
                now, state = row[:n_key], start
            state, made = step(state, row[n_key : n_key + n_in])
            if made is not None:
                out.append(row[:n_key] + tuple(made))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(names), types)], names=names)


def ordered_fold(df: DataFrame, key: list[str], order: list[str], inputs: list[str], start: Any, step: Step, output: str) -> DataFrame:
    """Fold the rows of each key in order; ``step(state, inputs) -> (state, output row or None)``.

    One key's rows go to one task but are streamed: a task holds one state, whatever the key's size.
    """
    spark = df.sparkSession
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    schema = spark.createDataFrame([], f"{kinds}, {output}").schema
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in schema]
    rows = df.select(*key, *inputs, *[F.col(o).alias(f"_order{k}") for k, o in enumerate(order)])
    rows = rows.repartition(*key).sortWithinPartitions(*key, *[f"_order{k}" for k in range(len(order))])
    return rows.mapInArrow(partial(_fold, n_key=len(key), n_in=len(inputs), start=start, step=step, names=schema.names, types=types), schema)


def ema_clamped(state: float | None, target: float, alpha: float, low: float, high: float) -> float:
    """One step of ``e += alpha * (t - e)``, clamped after each step; the first step starts from ``low``."""
    e = low if state is None else state
    return min(max(e + alpha * (target - e), low), high)


def consecutive_true(df: DataFrame, key: list[str], order: list[str], predicate: Column, n: int, time: str) -> DataFrame:
    """Per key: the first ``time`` from which ``predicate`` holds in ``n`` rows running, or null."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(0, n - 1)
    holds = F.coalesce(predicate, F.lit(False)).cast("int")
    rows = df.withColumn("_all", (F.min(holds).over(w) == 1) & (F.count(F.lit(1)).over(w) == n))
    return rows.groupBy(*key).agg(F.min(F.when(F.col("_all"), F.col(time))).alias("first_time"))


def monotonic_violations(df: DataFrame, key: list[str], order: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    rows = df.withColumn("_back", F.col(value) < F.lag(value).over(w) - tolerance)
    return rows.groupBy(*key).agg(F.count(F.when(F.col("_back"), 1)).alias("violations"), F.count("*").alias("n"))
