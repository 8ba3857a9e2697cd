"""Top N items within every group, with a consistent tie rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.operators.positions import top_n


def best_score(*names: str):
    """The largest of several score columns; NaN and null are absent; null where all are."""
    return F.greatest(*[F.when(~F.isnan(F.col(c)), F.col(c)) for c in names])


def best_candidates(cands: DataFrame, group: str, item: list[str], scores: list[str], n: int = 5) -> DataFrame:
    """(group, item..., score, position): the n best-scored items of each group.

    An item given more than once counts once, with its highest score; an item without any score isn't ranked; equal scores
    go by the item columns in order, smallest first. A null group or item is a value like others. Duplicates are folded by
    a map-side combined aggregate; then the rows are sorted over all partitions on (group, score, item) and positions
    come from prefix sums of per-partition counts, so a group of any size is spread over many tasks.
    """
    one = cands.select(group, *item, best_score(*scores).alias("_score")).filter("_score is not null")
    one = one.groupBy(group, *item).agg(F.max("_score").alias("_score"))
    return top_n(one, [group], [F.col("_score").desc(), *[F.col(c) for c in item]], n).withColumnRenamed("_score", "score")
