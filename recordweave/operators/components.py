"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from recordweave.runtime import by_key, cut


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, component): component is the smallest node that links lead to. Nodes without a link have no row.

    Each round is two map-side combined aggregates with a join; the number of rounds grows with the logarithm of the
    longest chain. Lineage is cut each round in the shared checkpoint folder; nothing is collected. Loops, repeated and
    null ends don't matter.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e = cut(e)
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(by_key(low), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(by_key(low), "u").filter("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        seen = Observation()
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        state = (seen.get["n"], seen.get["h"])
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
