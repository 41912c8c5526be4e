"""What the modules of plans share: a list of queries with their SQL, and column programs for both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A column program: (name, expression) in SQL that Spark and DuckDB read alike; each may use the names before it.
Steps = list[tuple[str, str]]


class Catalog:
    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


def run_steps(df: DataFrame, steps: Steps) -> DataFrame:
    """``df`` with the program's columns. Rows pass through a generator of one row at the end: a filter on a column stays
    above it, where pushing it down would write each step out in place of its name, over and over."""
    for name, e in steps:
        df = df.withColumn(name, F.expr(e))
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def steps_sql(source: str, steps: Steps) -> str:
    """The same program as nested selects over ``source``."""
    for name, e in steps:
        source = f"(SELECT *, {e} AS {name} FROM {source})"
    return source
