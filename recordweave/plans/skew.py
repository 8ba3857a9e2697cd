"""Queries on keys that hold most rows, and on packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordweave.operators import frequency
from recordweave.operators.packed import explode_packed
from recordweave.runtime import table


def _both(spark: SparkSession, d: str) -> DataFrame:
    cols = ["country", "business_name", "business_address"]
    return table(spark, d, "source1").select(*cols).unionByName(table(spark, d, "source2").select(*cols))


def p1_country_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per country of source1 and source2: rows, rows with a name, distinct names, the most frequent name."""
    return frequency.profile(_both(spark, d), ["country"], "business_name")


def p1_country_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per country the exact percentiles of the length of names."""
    x = _both(spark, d).select("country", F.length("business_name").alias("n"))
    return frequency.percentiles(x, ["country"], "n", {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99})


def p1_country_name_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Names that source1 and source2 share within a country, and how many row pairs that makes."""
    return frequency.matching_values(table(spark, d, "source1"), table(spark, d, "source2"), ["country"], "business_name")


def p1_country_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per country the number of source1-source2 row pairs with one name."""
    return p1_country_name_pairs(spark, d).groupBy("country").agg(F.sum("n_pairs").alias("n_pairs"), F.count(F.lit(1)).alias("n_names"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per id of each list, with its position; a list given twice counts once."""
    m = table(spark, d, "train_matches").select("source1_entity_id", "matched_entity_ids")
    return explode_packed(m, "matched_entity_ids", "matched_entity_id", item=r"S\d-").select("source1_entity_id", "list_pos", "matched_entity_id").distinct()


QUERIES = {f.__name__: f for f in (p1_country_profile, p1_country_percentiles, p1_country_name_pairs, p1_country_pair_counts, p4_found)}

_BOTH = "with b as (select country, business_name from source1 union all select country, business_name from source2)"
_PAIRS = """with a as (select country, business_name, count(*) as n_left from source1 where business_name is not null group by all),
c as (select country, business_name, count(*) as n_right from source2 where business_name is not null group by all),
p as (select a.country, a.business_name, n_left, n_right, n_left * n_right as n_pairs from a join c on a.business_name = c.business_name and a.country is not distinct from c.country)"""
ORACLE = {
    "p1_country_profile": _BOTH
    + """, v as (select country, business_name, count(*) as n from b group by all),
m as (select country, business_name, n, row_number() over (partition by country order by n desc, business_name) as r from v where business_name is not null)
select v.country, sum(v.n)::bigint as n_rows, coalesce(sum(case when v.business_name is not null then v.n end), 0)::bigint as n_values, count(v.business_name) as n_distinct,
any_value(m.business_name) as mode, coalesce(any_value(m.n), 0)::bigint as mode_rows from v left join m on m.r = 1 and m.country is not distinct from v.country group by v.country""",
    "p1_country_percentiles": _BOTH
    + " select country, "
    + ", ".join(f"quantile_disc(length(business_name), {p})::integer as {k}" for k, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9), ("p99", 0.99)))
    + " from b where business_name is not null group by country",
    "p1_country_name_pairs": _PAIRS + " select * from p",
    "p1_country_pair_counts": _PAIRS + " select country, sum(n_pairs)::bigint as n_pairs, count(*) as n_names from p group by country",
    "p4_found": """with m as (select distinct source1_entity_id, regexp_extract_all(matched_entity_ids, '["''“](S[23]-[0-9]{8}[,;|][0-9]+)["''”]|S[23]-[0-9]{8}') as ids from train_matches),
x as (select source1_entity_id, unnest(ids) as id, generate_subscripts(ids, 1) as list_pos from m)
select distinct source1_entity_id, list_pos::integer as list_pos, trim(id, '"''“”') as matched_entity_id from x""",
}
