"""From scored pairs to decisions: one owner per record, two thresholds, and the macro-averaged F0.5 they are tuned on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordweave.runtime import cut


def owned(pairs: DataFrame, query: str, record: list[str], p: str) -> DataFrame:
    """pairs with is_owner: the record's pair of highest p; ties go to the smallest query."""
    w = Window.partitionBy(*record).orderBy(F.col(p).desc(), query)
    return pairs.withColumn("is_owner", F.row_number().over(w) == 1)


def ranked(pairs: DataFrame, query: str, record: list[str], p: str) -> DataFrame:
    """owned pairs with is_top (the query's best owned pair) and top_p."""
    x = owned(pairs, query, record, p).withColumn("_p", F.when(F.col("is_owner"), F.col(p)).otherwise(-1.0))
    w = Window.partitionBy(query)
    return x.withColumn("is_top", F.row_number().over(w.orderBy(F.col("_p").desc(), *record)) == 1).withColumn("top_p", F.max("_p").over(w))


def kept(t_first: Column | float, t_add: Column | float) -> Column:
    """Condition on ranked pairs: the best needs t_first, every further one t_add and a best that is kept."""
    f, a = (F.lit(x) if isinstance(x, float) else x for x in (t_first, t_add))
    return (F.col("top_p") >= f) & F.when(F.col("is_top"), F.col("_p") >= f).otherwise(F.col("_p") >= a)


def f05(n_pred: Column, n_true: Column, tp: Column) -> Column:
    p, r = tp / n_pred, tp / n_true
    return F.when(n_true == 0, F.when(n_pred == 0, 1.0).otherwise(0.0)).when((tp == 0) | (n_pred == 0), 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def entity_scores(queries: DataFrame, predicted: DataFrame, truth: DataFrame, query: str, record: str) -> DataFrame:
    """(query, n_pred, n_true, tp, f05) of every query, those without any pair as well."""
    hit = predicted.join(truth.select(query, record).withColumn("_y", F.lit(1)), [query, record], "left")
    pred = hit.groupBy(query).agg(F.count(F.lit(1)).alias("n_pred"), F.coalesce(F.sum("_y"), F.lit(0)).alias("tp"))
    true = truth.groupBy(query).agg(F.count(F.lit(1)).alias("n_true"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    x = queries.select(query).distinct().join(pred, query, "left").join(true, query, "left").select(query, z("n_pred"), z("n_true"), z("tp"))
    return x.withColumn("f05", f05(F.col("n_pred"), F.col("n_true"), F.col("tp")))


def threshold_grid(pairs: DataFrame, p: str, n: int = 50, least: float = 0.01) -> list[float]:
    """n distinct quantiles, up to the 99th percentile, of the scores from `least` on (of all scores if there are none), to six digits.

    Scores are counted to six digits first, so the quantiles are taken of at most a million values with their counts.
    """
    counts = pairs.select(F.round(p, 6).alias("p")).filter("p is not null").groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    steps = [0.99 * i / (n - 1) for i in range(n)]
    take = lambda df: df.agg(F.percentile("p", F.array(*map(F.lit, steps)), F.col("n"))).first()[0]
    return sorted({round(x, 6) for x in take(counts.filter(F.col("p") >= least)) or take(counts) or []})


def tune(rank_: DataFrame, n_true: DataFrame, query: str, label: str, firsts: list[float], adds: list[float]) -> list[tuple[float, float, float]]:
    """(t_first, t_add, macro_f05) of every pair of thresholds, from one pass over the pairs.

    rank_ are ranked pairs with a 0/1 label, n_true (query, n_true) has every query. Owned pairs are counted per query and step
    between thresholds, so a query has at most one row a step, whatever its pairs; counts add up from the highest step down
    and give the query's F0.5 for each t_add. Whether its best reaches t_first decides between that and the F0.5 of no match, so
    sums per step of the best and t_add are all that comes to the driver: at most len(firsts) * len(adds) rows.
    """
    if not firsts or not adds:
        return []
    steps = lambda ts: F.size(F.filter(F.array(*map(F.lit, sorted(ts))), lambda t: t <= F.col("_p") + 1e-9))
    own = rank_.filter("is_owner").select(query, "is_top", F.col(label).cast("long").alias("_y"), steps(firsts).alias("_f"), steps(adds).alias("_a"))
    binned = own.groupBy(query, "is_top", F.when(F.col("is_top"), F.col("_f")).otherwise(F.col("_a")).alias("_bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("y"))
    one = binned.groupBy(query).agg(F.max(F.when(F.col("is_top"), F.struct("_bin", "y"))).alias("top"), F.collect_list(F.when(~F.col("is_top"), F.struct("_bin", "n", "y"))).alias("more"))
    x = n_true.join(one, query).select("n_true", F.col("top._bin").alias("reach"), F.col("top.y").alias("y"), "more", F.explode(F.sequence(F.lit(1), F.lit(len(adds)))).alias("a")).filter("reach > 0")
    total = lambda c: F.aggregate(F.col("more"), F.lit(0).cast("long"), lambda s, m: s + F.when(m["_bin"] >= F.col("a"), m[c]).otherwise(0))
    gain = f05(1 + total("n"), F.col("n_true"), F.col("y") + total("y")) - (F.col("n_true") == 0).cast("double")
    rows = x.groupBy("reach", "a").agg(F.sum(gain).alias("g")).collect()
    n, empty = n_true.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("n_true") == 0).cast("int")), F.lit(0))).first()
    g = {(r.reach, r.a): r.g for r in rows}
    out = []
    for i, t in enumerate(sorted(firsts), 1):
        for j, u in enumerate(sorted(adds), 1):
            out.append((t, u, round((empty + sum(g.get((k, j), 0.0) for k in range(i, len(firsts) + 1))) / max(n, 1), 9)))
    return out


def best_thresholds(pairs: DataFrame, n_true: DataFrame, query: str, record: list[str], p: str, label: str, n: int = 50) -> tuple[float, float, float]:
    """(macro_f05, t_first, t_add): the best pair of the quantile grid, then the best within 0.04 of it in steps of 0.005.

    Of equal scores the smaller t_first, then the smaller t_add, and the grid's before the refinement's.
    """
    r = cut(ranked(pairs.withColumn("_q", F.round(p, 6)), query, record, "_q"))
    grid = threshold_grid(pairs, p, n)
    best = max(tune(r, n_true, query, label, grid, grid), key=lambda x: (x[2], -x[0], -x[1]), default=(0.5, 0.5, -1.0))
    near = [sorted({round(min(1.0, max(0.0, t + 0.005 * k)), 6) for k in range(-8, 9)}) for t in best[:2]]
    finer = max(tune(r, n_true, query, label, *near), key=lambda x: (x[2], -x[0], -x[1]), default=best)
    t_first, t_add, score = finer if finer[2] > best[2] else best
    return score, t_first, t_add


def near_tie_rate(pairs: DataFrame, record: list[str], p: str, gap: float = 0.05, least: float = 0.0) -> DataFrame:
    """(rate): of records whose best p is at least `least`, the share whose second is nearer than gap; no second counts as -1."""
    w = Window.partitionBy(*record).orderBy(F.col(p).desc())
    top = pairs.withColumn("_r", F.row_number().over(w)).filter("_r <= 2").groupBy(*record).agg(F.max(F.when(F.col("_r") == 1, F.col(p))).alias("a"), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col(p))), F.lit(-1.0)).alias("b"))
    return top.filter(F.col("a") >= least).agg(F.round(F.coalesce(F.avg((F.col("a") - F.col("b") < gap).cast("double")), F.lit(0.0)), 6).alias("rate"), F.count(F.lit(1)).alias("n_records"))
