"""Per-key results under heavy key skew by value-frequency compression.

Rows are grouped by (key, value) first: a key that holds a third of all rows is spread over the hash of its values, map-side
combining leaves one row per distinct pair and split, and the second grouping, by key alone, sees distinct values with
their weights instead of rows. Every second-level aggregate combines map-side as well, so a hot key costs a task one row
per map split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.operators.positions import running_sum
from recordweave.runtime import by_key, cut, parallelism


def compress(df: DataFrame, key: list[str], value: str, weight: str = "weight") -> DataFrame:
    """(key, value, weight): the number of rows of each pair. Null keys and null values are values of their own."""
    if weight in (*key, value):
        raise ValueError(f"{weight} is a column already")
    return df.groupBy(*key, value).agg(F.count(F.lit(1)).alias(weight))


def profile(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Per key: n_rows, n_values (rows with a value), n_distinct, mode and mode_rows.

    Of equally frequent values the smallest (by code point) is the mode. A key whose values are all null has a null mode,
    mode_rows 0 and n_distinct 0. An empty table gives no rows.
    """
    c = compress(df.select(*key, F.col(value).alias("_value")), key, "_value", "_n")
    there = F.col("_value").isNotNull()
    return (
        c.groupBy(*key)
        .agg(
            F.sum("_n").alias("n_rows"),
            F.coalesce(F.sum(F.when(there, F.col("_n"))), F.lit(0)).alias("n_values"),
            F.count(F.when(there, 1)).alias("n_distinct"),
            F.min(F.when(there, F.struct((-F.col("_n")).alias("n"), F.col("_value").alias("v")))).alias("_mode"),
        )
        .select(*key, "n_rows", "n_values", "n_distinct", F.col("_mode.v").alias("mode"), F.coalesce(-F.col("_mode.n"), F.lit(0)).alias("mode_rows"))
    )


def percentiles(df: DataFrame, key: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Per key the exact discrete percentiles of value: the smallest value whose cumulated weight reaches p of all.

    Weighted values are cumulated over a global sort, so no task holds a whole key. Null values don't count; a key without
    values has no row. probs: output name to probability in (0, 1].
    """
    c = cut(compress(df.select(*key, F.col(value).alias("_value")).filter("_value is not null"), key, "_value", "_n"))
    run = running_sum(c, key, [F.col("_value")], "_n", "_upto")
    # totals have a row a key: they go to every salt, so that the values of a hot key meet theirs in many tasks
    salts = parallelism(df.sparkSession)
    totals = c.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.sum("_n").alias("_all")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    run = run.withColumn("_salt", F.pmod(F.xxhash64("_value"), F.lit(salts)).cast("int"))
    j = run.join(by_key(totals), [run["_salt"] == totals["_s"], *[run[k].eqNullSafe(totals[f"_k{i}"]) for i, k in enumerate(key)]])
    return j.groupBy(*key).agg(*[F.min(F.when(F.col("_upto") >= F.ceil(F.lit(p) * F.col("_all")), F.col("_value"))).alias(name) for name, p in probs.items()])


def matching_values(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, value, n_left, n_right, n_pairs): values that both tables have under a key, and how many row pairs that is.

    Copies are counted, never expanded into pairs. Null values match nothing; a null key matches a null key.
    """
    a = compress(left.select(*key, value).filter(F.col(value).isNotNull()), key, value, "n_left")
    b = compress(right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col(value).alias("_value")).filter("_value is not null"), [f"_k{i}" for i in range(len(key))], "_value", "n_right")
    on = [a[value] == b["_value"], *[a[k].eqNullSafe(b[f"_k{i}"]) for i, k in enumerate(key)]]
    return a.join(b, on).select(*[a[k] for k in key], a[value], "n_left", "n_right", (F.col("n_left") * F.col("n_right")).alias("n_pairs"))
