"""Queries: normalisation of names and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordweave.functions import text as X
from recordweave.functions.fixed import DOMAIN_ENDINGS
from recordweave.plans import base
from recordweave.runtime import table


def _raw(spark, d):
    out = None
    for k in (1, 2, 3):
        t = table(spark, d, f"source{k}").select("entity_id", "business_name", "business_address").distinct()
        out = t if out is None else out.unionByName(t)
    return out


def norm_base_clean(spark, d):
    """Every text of every document in cleaned form."""
    return table(spark, d, "documents").select("doc_id", X.base_clean(F.col("text")).alias("clean"))


def norm_names(spark, d):
    return base.records(spark, d).select("src", "id", "name", "core", "phon")


def norm_addresses(spark, d):
    return base.records(spark, d).select("src", "id", "addr", "nums", "postal")


def norm_variants(spark, d):
    return base.records(spark, d).select(F.col("id").alias("entity_id"), "variants").distinct()


def norm_domain(spark, d):
    """Hosts of names that are web addresses; those of these tables end in example, the ending kept for examples."""
    pattern = X.domain([*DOMAIN_ENDINGS, "example"])
    r = _raw(spark, d).select("entity_id", F.regexp_extract(F.trim("business_name"), "(?i)" + pattern, 1).alias("host")).filter("host != ''")
    return r.distinct()


def norm_romanised(spark, d):
    """Names and addresses written in a Brahmic script, in Roman letters."""
    r = _raw(spark, d).select("entity_id", F.explode(F.array("business_name", "business_address")).alias("text"))
    return r.filter(F.col("text").rlike("[\u0900-\u0d7f]")).select("entity_id", X.romanised(F.col("text")).alias("roman")).distinct()


def norm_token_counts(spark, d):
    r = base.records(spark, d)
    return r.select("src", "id", F.size(X.tokens(F.col("core"))).alias("n_core"), F.size(X.tokens(F.col("addr"))).alias("n_addr"), F.length("core").alias("len_core"), F.coalesce(F.try_element_at(X.tokens(F.col("core")), F.lit(1)), F.lit("")).alias("first"))


QUERIES = {f.__name__: f for f in (norm_base_clean, norm_names, norm_addresses, norm_variants, norm_domain, norm_romanised, norm_token_counts)}
_RAW = "with r as (select distinct entity_id, business_name, business_address from source1 union all select distinct entity_id, business_name, business_address from source2 union all select distinct entity_id, business_name, business_address from source3)"
ORACLE = {
    "norm_base_clean": f"with {X.sql_plain_ctes('t', 'documents', 'text')} select doc_id, {X.sql_base_clean('plain')} as clean from t",
    "norm_names": base.SQL + " select src, id, name, core, phon from rec",
    "norm_addresses": base.SQL + " select src, id, addr, nums, postal from rec",
    "norm_variants": base.SQL + " select distinct id as entity_id, variants from rec",
    "norm_domain": _RAW + f", h as (select distinct entity_id, regexp_extract(trim(business_name), '(?i){X.domain([*DOMAIN_ENDINGS, 'example'])}', 1) as host from r) select * from h where host != ''",
    "norm_romanised": _RAW + f", t as (select entity_id, business_name as text from r union all select entity_id, business_address from r), b as (select * from t where regexp_matches(text, '[\u0900-\u0d7f]')) select distinct entity_id, {X.sql_romanised('text')} as roman from b",
    "norm_token_counts": base.SQL + " select src, id, len(string_split(core, ' '))::integer - (core = '')::integer as n_core, len(string_split(addr, ' '))::integer - (addr = '')::integer as n_addr, length(core)::integer as len_core, string_split(core, ' ')[1] as first from rec",
}
