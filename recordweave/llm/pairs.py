"""All pairs of a group's members, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.runtime import by_key

BLOCK = 1_000_000


def pairs_within(members: DataFrame, group: str, member: str, *carried: str, block: int = BLOCK) -> DataFrame:
    """(a, b, and a_ and b_ of each carried column): the pairs a < b of different members of one group.

    members has one row per group and member. A group is split into so many salts that a task makes about `block` pairs;
    copies of a member go to each salt. Null groups have no pairs.
    """
    sizes = members.groupBy(group).agg((F.count(F.lit(1)) * F.count(F.lit(1)) / block).alias("_n"))
    x = members.join(by_key(sizes), group).withColumn("_salts", F.greatest(F.lit(1), F.ceil("_n")).cast("int"))
    side = lambda s, salt: x.select(F.col(group).alias("_g"), salt.alias("_salt"), F.col(member).alias(s), *[F.col(c).alias(f"{s}_{c}") for c in carried])
    left = side("a", F.pmod(F.xxhash64(member), F.col("_salts")).cast("int"))
    right = side("b", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    return left.join(by_key(right), ["_g", "_salt"]).filter("a < b").drop("_g", "_salt")
