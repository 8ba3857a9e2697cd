"""Views that many queries start from, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordweave.functions import text as X
from recordweave.runtime import once, spread, table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for k in (1, 2, 3):
        t = table(spark, d, f"source{k}").select(F.lit(k).alias("src"), F.col("entity_id").alias("id"), "pos", "split", "business_name", "business_address", F.coalesce("country", F.lit("")).alias("country")).distinct()
        out = t if out is None else out.unionByName(t)
    return out


def normalised(texts: DataFrame) -> DataFrame:
    """texts with name, variants, addr, core, postal, nums and phon instead of business_name and business_address.

    Brahmic scripts are romanised first; the name is that of all its parts, an added trade name's as well.
    """
    out = texts.withColumns({"foreign": F.coalesce(F.col("business_name"), F.lit("")).rlike("[^\\u0000-\\u024f]").cast("int"), "variants": F.array_join(X.name_variants(F.col("business_name")), "|"), "addr": X.clean_address(F.col("business_address"))}).drop("business_name", "business_address")
    out = out.withColumn("name", F.replace("variants", F.lit("|"), F.lit(" ")))
    out = out.withColumns({"core": X.core_of(F.col("name")), "postal": X.postal(F.col("addr")), "nums": F.array_join(X.numbers(F.col("addr")), " ")})
    return out.withColumn("phon", X.phonetic(F.col("core")))


def records(spark: SparkSession, d: str, split: str | None = None) -> DataFrame:
    """(src, id, pos, split, country, foreign, name, variants, core, addr, postal, nums, phon): one row per record of the three sources, normalised.

    foreign: 1 where the name as written has a letter beyond the Latin blocks.

    Written once per session to the shared folder and read from there by every query; again when the input files change.
    """
    out = once(spark, "records", [f"{d}/source{k}.parquet" for k in (1, 2, 3)], lambda: normalised(spread(_texts(spark, d), "src", "id")))
    return out.filter(F.col("split") == split) if split else out


SQL = f"""with raw as (select distinct 1 as src, entity_id as id, pos, split, business_name, business_address, coalesce(country, '') as country from source1
 union all select distinct 2, entity_id, pos, split, business_name, business_address, coalesce(country, '') from source2
 union all select distinct 3, entity_id, pos, split, business_name, business_address, coalesce(country, '') from source3),
nm_d as (select distinct business_name as raw from raw), {X.sql_name_ctes("nm_d")},
ad_d as (select distinct business_address as raw from raw), {X.sql_address_ctes("ad_d")},
n1 as (select src, id, pos, split, country, regexp_matches(coalesce(business_name, ''), '[^\\x{{0000}}-\\x{{024F}}]')::integer as foreign_, name, variants, addr from raw join named on business_name is not distinct from named.raw join placed on business_address is not distinct from placed.raw),
n2 as (select *, {X.sql_core("name")} as core, {X.sql_postal("addr")} as postal, array_to_string({X.sql_numbers("addr")}, ' ') as nums from n1),
rec as materialized (select *, {X.sql_phonetic("core")} as phon from n2)"""


def truth(spark: SparkSession, d: str) -> DataFrame:
    """(s1, r): known pairs of the train split."""
    from recordweave.operators.packed import explode_packed

    m = table(spark, d, "train_matches").select("source1_entity_id", "matched_entity_ids")
    return explode_packed(m, "matched_entity_ids", "r", item=r"S\d-").select(F.col("source1_entity_id").alias("s1"), "r").distinct()


TRUTH = """tr as (select distinct source1_entity_id as s1, trim(unnest(regexp_extract_all(matched_entity_ids, '["''“](S[23]-[0-9]{8}[,;|][0-9]+)["''”]|S[23]-[0-9]{8}')), '"''“”') as r from train_matches)"""

SIMS = ["sim_na", "sim_c4", "sim_ph", "sim_nm", "sim_rev"]


def scored(spark: SparkSession, d: str) -> DataFrame:
    """(s1_pos, src, r_pos, p): distinct candidate pairs with their best similarity as a score, 0 without any."""
    best = F.greatest(*[F.when(~F.isnan(c), F.col(c).cast("double")) for c in SIMS])
    c = table(spark, d, "test_cands").select("s1_pos", F.col("src").cast("int").alias("src"), "r_pos", best.alias("p"))
    return c.groupBy("s1_pos", "src", "r_pos").agg(F.round(F.coalesce(F.max("p"), F.lit(0.0)), 4).alias("p"))


SCORED = "sc as (select s1_pos, src::integer as src, r_pos, round(coalesce(max(greatest({})), 0), 4) as p from test_cands group by all)".format(", ".join(f"case when isnan({c}) then null else {c}::double end" for c in SIMS))
