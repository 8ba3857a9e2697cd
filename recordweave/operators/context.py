"""Where a candidate pair stands among its competitors: window features over pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordweave.runtime import by_key, cut, parallelism


def add_context(pairs: DataFrame, score: str, query: list[str], record: list[str], prefix: str = "ctx") -> DataFrame:
    """pairs with rank and gap to the best among the query's candidates (per source) and the record's competitors.

    A null or NaN score ranks as -1. query has the source as well; ranks are minimum ranks.
    """
    s = F.coalesce(F.nanvl(F.col(score), F.lit(-1.0)), F.lit(-1.0))
    x = pairs.withColumn("_s", s)
    q, r = Window.partitionBy(*query), Window.partitionBy(*record)
    best = F.col("_s").desc()
    return x.select(
        *pairs.columns,
        F.rank().over(q.orderBy(best)).alias(f"{prefix}_rank_s1"),
        (F.max("_s").over(q) - F.col("_s")).alias(f"{prefix}_gap_s1"),
        F.count(F.lit(1)).over(q).alias("n_cand_s1"),
        F.rank().over(r.orderBy(best)).alias(f"{prefix}_rank_rec"),
        (F.max("_s").over(r) - F.col("_s")).alias(f"{prefix}_gap_rec"),
        F.count(F.lit(1)).over(r).alias(f"{prefix}_n_rec"),
    )


def competition(pairs: DataFrame, p: str, key: list[str], prefix: str) -> DataFrame:
    """pairs with max, gap, rank, number above one half, sum and best other of p within key.

    best_other is the second best for the best pair and the best for all others; 0 without a second.
    """
    w = Window.partitionBy(*key)
    x = pairs.withColumn("_m", F.max(p).over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.col(p).desc())))
    x = x.withColumn("_t", F.max(F.when(F.col("_r") == 2, F.col(p))).over(w))
    return x.select(
        *pairs.columns,
        F.col("_m").alias(f"{prefix}_max"),
        (F.col("_m") - F.col(p)).alias(f"{prefix}_gap"),
        F.rank().over(w.orderBy(F.col(p).desc())).alias(f"{prefix}_rank"),
        F.sum((F.col(p) > 0.5).cast("int")).over(w).alias(f"{prefix}_n_hi"),
        F.sum(p).over(w).alias(f"{prefix}_sum"),
        F.when(F.col(p) >= F.col("_m"), F.coalesce("_t", F.lit(0.0))).otherwise(F.col("_m")).alias(f"{prefix}_best_other"),
    )


def sampled_competition(pairs: DataFrame, score: str, record: list[str], drawn: str, fill: float = -1.0) -> DataFrame:
    """pairs with rank, max_other, n_other, sum_other, hi_other against the OTHER pairs of the record that are drawn.

    rank is 1 + the number of drawn pairs strictly above; max_other is null without a competitor.
    """
    x = pairs.withColumn("_s", F.coalesce(F.nanvl(F.col(score), F.lit(fill)), F.lit(fill))).withColumn("_d", F.col(drawn).cast("int"))
    w = Window.partitionBy(*record)
    by = w.orderBy(F.col("_s").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ds = F.when(F.col("_d") == 1, F.col("_s"))
    x = x.withColumn("_upto", F.sum("_d").over(by)).withColumn("_first", F.max(ds).over(w))
    x = x.withColumn("_tied", F.sum("_d").over(Window.partitionBy(*record, "_s"))).withColumn("_second", F.max(F.when(ds < F.col("_first"), ds)).over(w))
    alone = (F.col("_d") == 1) & (F.col("_s") == F.col("_first")) & (F.col("_tied") == 1)
    return x.select(
        *pairs.columns,
        (F.col("_upto") - F.col("_tied") + 1).alias("rank"),
        F.when(alone, F.col("_second")).otherwise(F.col("_first")).alias("max_other"),
        (F.sum("_d").over(w) - F.col("_d")).alias("n_other"),
        (F.coalesce(F.sum(ds).over(w), F.lit(0.0)) - F.coalesce(ds, F.lit(0.0))).alias("sum_other"),
        (F.sum(((F.col("_d") == 1) & (F.col("_s") > 0.5)).cast("int")).over(w) - ((F.col("_d") == 1) & (F.col("_s") > 0.5)).cast("int")).alias("hi_other"),
    )


def _value_agreement(x: DataFrame, query: str, value: str, p: str, there: Column, ratio: Callable[[Column, Column], Column], block: int) -> DataFrame:
    """(query, value, _n, _w, _all_n, _all_w, _best, _sum) of each value of the query's candidates, compared with its siblings' other values.

    _n and _w count and weigh the siblings of that value, _all_n and _all_w those of any value; _best and _sum are the maximum
    and the weighted sum of ratio over the other values. Values are salted, so that a task compares about `block` siblings'
    values with one salt's share, whatever the size of the query.
    """
    k = x.filter(there).groupBy(query, value).agg(F.sum(F.col("_sib").cast("long")).alias("_n"), F.sum(F.when(F.col("_sib"), F.col(p)).otherwise(0.0)).alias("_w"))
    w = Window.partitionBy(query)
    salts = F.greatest(F.lit(1), F.ceil(F.sum((F.col("_n") > 0).cast("long")).over(w) / block)).cast("int")
    k = cut(k.withColumns({"_all_n": F.sum("_n").over(w), "_all_w": F.sum("_w").over(w), "_salts": salts}))
    n = parallelism(x.sparkSession)
    left = k.withColumn("_salt", F.pmod(F.xxhash64(value), F.col("_salts")).cast("int")).select(query, "_salt", value).repartition(n, query, "_salt")
    right = k.filter("_n > 0").select(query, F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), F.col(value).alias("_other"), F.col("_w")).repartition(n, query, "_salt")
    j = left.join(right, [query, "_salt"]).filter(F.col(value) != F.col("_other")).withColumn("_ratio", ratio(F.col(value), F.col("_other")))
    a = j.groupBy(query, value).agg(F.max("_ratio").alias("_best"), F.sum(F.col("_ratio") * F.col("_w")).alias("_sum"))
    return k.drop("_salts").join(a, [query, value], "left")


def siblings(pairs: DataFrame, records: DataFrame, query: str, record: str, p: str, least: float = 0.5, block: int = 256, queries: DataFrame | None = None, ratio: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(query, record, sib_n, sib_pmass, and agreement with ALL the query's OTHER candidates of p >= least).

    records has record, core, addr and nums (array), queries (if given) query and nums. Agreement of names and addresses is
    ratio (by default the edit ratio), that of number sets their shared share: maximum, p-weighted mean and share of equal
    sets; null without siblings or where a side is empty. sib_num_supported: whether the query's own numbers and the
    candidate's meet, where it has siblings and both have numbers. Siblings are grouped by their distinct core, address and
    number set, so a query costs a row a pair of distinct values, not of candidates; a candidate's own part is taken out of
    its value's count and weight.
    """
    from recordweave.functions.strings import edit_ratio_by_bits, set_jaccard

    ratio = ratio or edit_ratio_by_bits
    info = records.select(record, F.col("core").alias("_core"), F.col("addr").alias("_addr"), F.array_sort(F.array_distinct("nums")).alias("_nums"))
    w = Window.partitionBy(query)
    x = cut(pairs.select(query, record, p).join(by_key(info), record, "left").withColumn("_sib", F.col(p) >= least))
    mass = F.when(F.col("_sib"), F.col(p)).otherwise(0.0)
    n = F.sum(F.col("_sib").cast("long")).over(w) - F.col("_sib").cast("long")
    out = x.withColumns({"sib_n": n, "sib_pmass": F.when(n > 0, F.sum(mass).over(w) - mass)})
    parts = (("_core", F.col("_core") != "", ratio, "name"), ("_addr", F.col("_addr") != "", ratio, "addr"), ("_nums", F.size("_nums") > 0, set_jaccard, "num_jacc"))
    for value, there, agree, name in parts:
        out = out.join(by_key(_value_agreement(x, query, value, p, there, agree, block)), [query, value], "left")
        own = F.col("_sib").cast("long")
        same, others = F.col("_n") - own, F.col("_all_n") - own
        same_w = F.when(same > 0, F.col("_w") - mass).otherwise(0.0)
        out = out.withColumns({
            f"sib_{name}_max": F.when(same > 0, F.lit(1.0)).otherwise(F.col("_best")), f"sib_{name}_wmean": F.when(others > 0, (F.coalesce("_sum", F.lit(0.0)) + same_w) / (F.col("_all_w") - mass)), f"_eq_{name}": F.when(others > 0, same / others),
        }).drop("_n", "_w", "_all_n", "_all_w", "_best", "_sum")
    out = out.withColumnRenamed("_eq_num_jacc", "sib_num_eq_frac")
    if queries is None:
        queries = pairs.select(query).distinct().withColumn("nums", F.array().cast("array<string>"))
    out = out.join(by_key(queries.select(query, F.col("nums").alias("_own"))), query, "left")
    met = F.when((F.col("sib_n") > 0) & (F.size("_nums") > 0) & (F.size("_own") > 0), F.arrays_overlap("_nums", "_own").cast("double"))
    return out.select(query, record, *SIBLING[:-1], met.alias(SIBLING[-1]))


SIBLING = ["sib_n", "sib_pmass", "sib_name_max", "sib_name_wmean", "sib_addr_max", "sib_addr_wmean", "sib_num_jacc_max", "sib_num_jacc_wmean", "sib_num_eq_frac", "sib_num_supported"]


def matched_context(pairs: DataFrame, score: str, record: list[str], drawn: str) -> DataFrame:
    """pairs with m_rank, m_gap and m_n among the record's drawn pairs; a pair itself always counts."""
    x = sampled_competition(pairs, score, record, drawn)
    own = F.coalesce(F.nanvl(F.col(score), F.lit(-1.0)), F.lit(-1.0))
    return x.select(*pairs.columns, F.col("rank").alias("m_rank"), (F.greatest(own, F.coalesce("max_other", own)) - own).alias("m_gap"), (F.col("n_other") + 1).alias("m_n"))


def matched_competition(pairs: DataFrame, p: str, record: list[str], drawn: str) -> DataFrame:
    """pairs with max, gap, rank, number above one half, sum and best other of p among the record's drawn pairs; a pair itself always counts."""
    x = sampled_competition(pairs, p, record, drawn, 0.0)
    own, other = F.coalesce(F.nanvl(F.col(p), F.lit(0.0)), F.lit(0.0)), F.coalesce("max_other", F.lit(0.0))
    best = F.greatest(own, other)
    return x.select(*pairs.columns, best.alias("m_max"), (best - own).alias("m_gap"), F.col("rank").alias("m_rank"), (F.col("hi_other") + (own > 0.5).cast("int")).alias("m_n_hi"), (F.col("sum_other") + own).alias("m_sum"), other.alias("m_best_other"))
