"""Checks of result lists against their contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ids(column: str):
    return F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def problems(lists: DataFrame, key: str, column: str, queries: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """(rule, n, examples): how many rows or ids break each rule, with up to five sorted examples.

    Rules: duplicate_rows, duplicate_ids, self_matches, wrong_prefix, missing_rows, extra_rows, unknown_ids (with known: a
    table of record ids in `id`) and not_candidates (with candidates: lists of the same form). Rules without a case have n 0.
    """
    x = lists.select(F.col(key).alias("k"), ids(column).alias("l"))
    q = queries.select(F.col(key).alias("k")).distinct()
    each = x.select("k", F.explode("l").alias("id"))
    found = {
        "duplicate_rows": x.groupBy("k").count().filter("count > 1").select("k"),
        "duplicate_ids": x.filter(F.size("l") != F.size(F.array_distinct("l"))).select("k"),
        "self_matches": each.filter("id like 'S1-%'").select("id"),
        "wrong_prefix": each.filter("not (id like 'S1-%' or id like 'S2-%' or id like 'S3-%')").select("id"),
        "missing_rows": q.join(x.select("k"), "k", "left_anti"),
        "extra_rows": x.select("k").join(q, "k", "left_anti"),
    }
    if known is not None:
        found["unknown_ids"] = each.filter("id like 'S2-%' or id like 'S3-%'").select("id").distinct().join(known.select("id"), "id", "left_anti")
    if candidates is not None:
        c = candidates.select(F.col(key).alias("k"), ids(column).alias("c"))
        found["not_candidates"] = x.join(c, "k", "left").filter(F.size(F.array_except("l", F.coalesce("c", F.array().cast("array<string>")))) > 0).select("k")
    out = None
    for rule, bad in found.items():
        bad = bad.toDF("v")
        first = bad.orderBy("v").limit(5).agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias("examples"))
        row = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n").join(first, F.lit(True)).select("rule", "n", "examples")
        out = row if out is None else out.unionByName(row)
    return out


def passed(report: DataFrame) -> bool:
    """No rule but not_candidates (a warning) is broken."""
    return report.filter("n > 0 and rule != 'not_candidates'").isEmpty()


def header_fault(spark: SparkSession, path: str, expected: list[str]) -> str | None:
    """What is wrong with the header of a tab-separated file; None if nothing is."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return "the file is empty"
    line = first[0].value
    if line == "\t".join(expected):
        return None
    return "commas instead of tabs" if line == ",".join(expected) else f"the header is {line[:80]!r}"


def malformed(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Lines that don't have the given number of tab-separated fields."""
    return spark.read.text(path).filter((F.trim("value") != "") & (F.size(F.split("value", "\t")) != columns))
