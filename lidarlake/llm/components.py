"""Connected components of an edge table, without ever holding links on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarlake.llm.common import stored


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest reachable node.

    Alternating large-star and small-star rounds on the edge table. Each round is written to the shared
    folder, so lineage stays short. Hub nodes need no list of neighbours in one place: a round only takes
    a minimum per node (combined before the shuffle) and joins it back (a join that AQE can split).
    Null ends are ignored; no edges give no rows.
    """
    links = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    links = stored(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u go to u's minimum
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.unionByName(low.where("m < u").select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct()
        # small star: a node and all its lower neighbours go to the lowest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = stored(small.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = links.groupBy("hi").agg(F.min("lo").alias("component")).select(F.col("hi").alias("node"), "component")
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
