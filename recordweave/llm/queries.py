"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordweave.llm import bpe, leaks, locations, matching, spellings, topn, truncation
from recordweave.operators.packed import explode_packed
from recordweave.runtime import cut, table

SCORES = ["sim_na", "sim_c4", "sim_ph", "sim_nm", "sim_rev"]
ID = r"S\d-"


def _sources(spark: SparkSession, d: str, *numbers: int, split: str = "test") -> DataFrame:
    out = None
    for n in numbers:
        t = table(spark, d, f"source{n}").filter(F.col("split") == split)
        out = t if out is None else out.unionByName(t)
    return out


def matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches of the test split with confidence, calibrated on labelled pairs of the train split."""
    m = table(spark, d, "train_matches").select("source1_entity_id", "matched_entity_ids")
    truth = explode_packed(m, "matched_entity_ids", "matched_entity_id", item=ID).select("source1_entity_id", "matched_entity_id").distinct()
    labels = _sources(spark, d, 1, split="train"), _sources(spark, d, 2, 3, split="train"), truth
    return matching.match(_sources(spark, d, 1), _sources(spark, d, 2, 3), labels)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return matches(spark, d).select("source1_entity_id", "matched_entity_id").distinct()


def p2_confidence(spark: SparkSession, d: str) -> DataFrame:
    return matches(spark, d)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return spellings.spelling_pairs(_sources(spark, d, 1, 2))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per record: the class of its name and its number of links."""
    return spellings.spelling_classes(_sources(spark, d, 1, 2))


def p5_locations(spark: SparkSession, d: str) -> DataFrame:
    """One row per record: its location and its number of links."""
    return locations.location_classes(_sources(spark, d, 1, 2, 3), clean=_sources(spark, d, 1))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return locations.location_pairs(_sources(spark, d, 1, 2, 3), clean=_sources(spark, d, 1))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "test_cands")
    return topn.best_candidates(c, "s1_pos", ["src", "r_pos"], SCORES, 5).select("s1_pos", "src", "r_pos")


def p6_positions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "test_cands")
    return topn.best_candidates(c, "s1_pos", ["src", "r_pos"], SCORES, 5).select("s1_pos", "src", "r_pos", "score", F.col("position").cast("int").alias("position"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.corpus_ids(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_longest(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that take over no passage, as they are."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return leaks.remove_leaks(docs, leaks.find_leaks(docs, table(spark, d, "eval_items")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_truncated(table(spark, d, "documents")).select("doc_id").distinct()


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return truncation.source_rates(docs, cut(truncation.find_truncated(docs)))


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("trim(text) != ''")
    return truncation.length_limits(docs, "text", "source")


QUERIES = {f.__name__: f for f in (p2_found, p2_confidence, p3_found, p3_classes, p5_found, p5_locations, p6_found, p6_positions, p7_ids, p8_found, p8_longest, p8_clean, p9_found, p9_rates, p9_limits)}

_TOP = """
with s as (select s1_pos, src, r_pos, greatest({g}) as score from test_cands),
u as (select s1_pos, src, r_pos, max(score) as score from s where score is not null group by s1_pos, src, r_pos),
r as (select *, row_number() over (partition by s1_pos order by score desc, src, r_pos) as position from u)
""".format(g=", ".join(f"case when isnan({c}) then null else {c} end" for c in SCORES))

_WORDS = "regexp_extract_all(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\\p{L}\\p{M}\\p{N}]+')"
_RUNS = f"""with dw as (select doc_id, {_WORDS} as l from documents), iw as (select item_id, {_WORDS} as l from eval_items),
dg as (select doc_id, unnest(list_transform(range(1, len(l) - 10), lambda i: array_to_string(l[i:i + 11], ' '))) as g from dw where len(l) >= 12), ig as (select item_id, unnest(list_transform(range(1, len(l) - 10), lambda i: array_to_string(l[i:i + 11], ' '))) as g from iw where len(l) >= 12),
lk as materialized (select distinct doc_id, item_id from dg join ig using (g))"""

ORACLE = {
    "p8_found": _RUNS + " select doc_id, item_id from lk",
    "p8_clean": _RUNS + " select doc_id, text, lang, source from documents where doc_id not in (select doc_id from lk)",
    "p6_found": _TOP + "select s1_pos, src, r_pos from r where position <= 5",
    "p6_positions": _TOP + "select s1_pos, src, r_pos, score, position::integer as position from r where position <= 5",
    "p9_limits": """
with u as (select source, 'chars' as unit, length(text)::integer as len from documents where trim(text) != '' union all select source, 'bytes', strlen(text)::integer from documents where trim(text) != ''),
h as (select source, unit, len, count(*) as n from u group by all),
w as (select a.source, a.unit, a.len, sum(case when b.len between a.len - 2 and a.len then b.n else 0 end) as top, sum(case when b.len between a.len - 42 and a.len - 3 then b.n else 0 end) as before,
sum(case when b.len > a.len then b.n else 0 end) as beyond from h a join h b on a.unit = b.unit and a.source is not distinct from b.source group by all)
select source, unit, max(len)::integer as at_limit from w where top >= 5 and top >= 4.0 * 3 * before / 40 and beyond <= 0.02 * top and len > 40 group by source, unit
""",
}
