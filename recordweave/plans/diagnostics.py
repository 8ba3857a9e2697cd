"""Queries: diagnostics of inputs, truth and competition; deterministic samples and folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recordweave.functions import strings as S
from recordweave.operators import blocking as B
from recordweave.operators import pairs as P
from recordweave.operators.model import fold
from recordweave.plans import base
from recordweave.plans.block import _RARE
from recordweave.runtime import table
from recordweave.sources.files import uniform

rate = lambda c: F.round(F.avg(c.cast("double")), 6)


def diag_missingness(spark, d):
    """Per source and split: rows and shares of empty names, addresses and countries, and of addresses without digits or postal code."""
    r = base.records(spark, d)
    return r.groupBy("src", "split").agg(
        F.count(F.lit(1)).alias("n"), rate(F.col("name") == "").alias("no_name"), rate(F.col("addr") == "").alias("no_addr"), rate(F.col("country") == "").alias("no_country"), rate(~F.col("addr").rlike("[0-9]")).alias("no_digits"), rate(F.col("postal") == "").alias("no_postal")
    )


RATES = {"no_name": "name = ''", "no_addr": "addr = ''", "no_digits": "nums = ''", "no_postal": "postal = ''", "foreign_name": "{foreign} = 1"}


def input_profile(spark, d):
    """Rates per source and country of the train split beside those of the test split, and which of them differ more than twofold."""
    r = base.records(spark, d)
    aggs = [F.count(F.lit(1)).alias("n"), *[rate(F.expr(c.format(foreign="foreign"))).alias(k) for k, c in RATES.items()]]
    a = r.groupBy("src", "country").pivot("split", ["train", "test"]).agg(*aggs)
    apart = lambda k: F.greatest(F.coalesce(f"train_{k}", F.lit(0.0)), F.coalesce(f"test_{k}", F.lit(0.0))) > 2 * F.least(F.coalesce(f"train_{k}", F.lit(0.0)), F.coalesce(f"test_{k}", F.lit(0.0)))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.select("src", "country", z("train_n"), z("test_n"), *[f"{s}_{k}" for k in RATES for s in ("train", "test")], *[apart(k).cast("int").alias(f"twofold_{k}") for k in RATES])


def diag_list_sizes(spark, d):
    """How many source1 records of the train split have how many known matches."""
    s = table(spark, d, "source1").filter("split = 'train'").select(F.col("entity_id").alias("s1")).distinct()
    n = base.truth(spark, d).groupBy("s1").agg(F.count(F.lit(1)).alias("n"))
    return s.join(n, "s1", "left").groupBy(F.coalesce("n", F.lit(0)).alias("n_matches")).agg(F.count(F.lit(1)).alias("n_s1"))


def diag_truth(spark, d):
    """Known pairs, records under more than one source1 record, and pairs whose countries differ."""
    t = base.truth(spark, d)
    c = base.records(spark, d, "train").groupBy("id").agg(F.min("country").alias("c"))
    j = t.join(c.withColumnsRenamed({"id": "s1", "c": "a"}), "s1").join(c.withColumnsRenamed({"id": "r", "c": "b"}), "r")
    differ = j.agg(F.coalesce(F.sum((F.col("a") != F.col("b")).cast("int")), F.lit(0)).alias("n_other_country"))
    one = t.agg(F.count(F.lit(1)).alias("n_pairs"), (F.count(F.lit(1)) - F.countDistinct("r")).alias("n_shared"))
    return one.join(differ, F.lit(True))


def diag_crosstab(spark, d):
    """Share of each reason why candidate pairs of the test split are hard, per country and over all (country *)."""
    rec = base.records(spark, d, "test")
    p = P.joined(B.rarest_token(rec, 20), rec, ["core", "addr", "postal", "country", "foreign"])
    p = p.withColumn("t", S.score(["token_set_ratio"], F.col("l_core"), F.col("r_core"))["token_set_ratio"])
    k = B.category(F.round("t", 6), (F.col("l_addr") == "") | (F.col("r_addr") == ""), F.col("r_foreign") == 1, F.when((F.col("l_postal") != "") & (F.col("r_postal") != ""), F.col("l_postal") == F.col("r_postal")))
    c = p.groupBy(F.col("l_country").alias("country"), k.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    c = c.unionByName(c.groupBy("category").agg(F.sum("n").alias("n")).withColumn("country", F.lit("*")))
    t = c.groupBy("country").agg(F.sum("n").alias("all"))
    return c.join(t, "country").select("country", "category", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


def diag_competition(spark, d):
    """Candidates per source1 record and source1 records per record, exact quantiles of the best score and of its lead, share of near ties."""
    s = base.scored(spark, d)
    w = lambda *key: Window.partitionBy(*key).orderBy(F.col("p").desc())
    two = lambda *key: s.withColumn("k", F.row_number().over(w(*key))).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("p").alias("top"), F.coalesce(F.max(F.when(F.col("k") == 2, F.col("p"))), F.lit(0.0)).alias("second"))
    a, b = two("s1_pos"), two("src", "r_pos")
    q = a.agg(F.round(F.avg("n"), 6).alias("per_s1"), F.round(F.percentile("top", F.lit(0.5)), 6).alias("median_top"), rate(F.col("top") < 0.5).alias("low_top"), F.round(F.percentile(F.round(F.col("top") - F.col("second"), 6), F.lit(0.5)), 6).alias("median_gap"))
    near = F.avg(F.when(F.col("top") >= 0.5, (F.round(F.col("top") - F.col("second"), 6) < 0.05).cast("double")))
    return q.join(b.agg(F.round(F.avg("n"), 6).alias("per_record"), F.round(F.coalesce(near, F.lit(0.0)), 6).alias("near_ties")), F.lit(True))


def diag_top_bands(spark, d):
    """How many source1 records have their best score in which tenth."""
    a = base.scored(spark, d).groupBy("s1_pos").agg(F.max("p").alias("top"))
    return a.groupBy(F.least(F.floor(F.col("top") * 10), F.lit(9)).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("n_s1"))


def train_sample_mask(spark, d):
    """Pairs that training would take: hard ones (rank 3 in the source1 record, 1 in the record) and a quarter of the rest."""
    from recordweave.operators.context import add_context

    c = add_context(base.scored(spark, d), "p", ["s1_pos", "src"], ["src", "r_pos"])
    hard = (F.col("ctx_rank_s1") <= 3) | (F.col("ctx_rank_rec") <= 1)
    u = uniform(F.concat_ws("|", "s1_pos", "src", "r_pos"))
    return c.filter(hard | (u < 0.25)).select("s1_pos", "src", "r_pos", hard.cast("int").alias("hard"))


def nested_masks(spark, d):
    """source1 records in the 40 % and the 15 % draw; the smaller is part of the larger."""
    s = table(spark, d, "source1").select("entity_id").distinct().withColumn("u", uniform(F.col("entity_id")))
    return s.filter("u < 0.4").select("entity_id", (F.col("u") < 0.15).cast("int").alias("small"))


def fold_assign(spark, d):
    s = table(spark, d, "source1").select("entity_id").distinct()
    return s.groupBy(fold(F.col("entity_id"), 5).alias("fold")).agg(F.count(F.lit(1)).alias("n"))


def smoke_sample(spark, d):
    """A fifth of the source1 records with all their known records and a fifth of the others: sizes."""
    from recordweave.sources.files import smoke_sample as sample

    r = base.records(spark, d, "train").select("src", "id").distinct()
    q, o = sample(r.filter("src = 1").select(F.col("id").alias("s1")), r.filter("src != 1").withColumnRenamed("id", "r"), base.truth(spark, d), "s1", "r", 0.2)
    return o.groupBy("src").agg(F.count(F.lit(1)).alias("n")).unionByName(q.agg(F.lit(1).alias("src"), F.count(F.lit(1)).alias("n")))


QUERIES = {f.__name__: f for f in (diag_missingness, input_profile, diag_list_sizes, diag_truth, diag_crosstab, diag_competition, diag_top_bands, train_sample_mask, nested_masks, fold_assign, smoke_sample)}

_u = lambda x: f"('0x' || substr(md5({x}), 1, 8))::bigint / 4294967296.0"
_SC = "with " + base.SCORED
ORACLE = {
    "diag_missingness": base.SQL + " select src, split, count(*) as n, " + ", ".join(f"round(avg(({c})::integer::double), 6) as {n}" for c, n in (("name = ''", "no_name"), ("addr = ''", "no_addr"), ("country = ''", "no_country"), ("not regexp_matches(addr, '[0-9]')", "no_digits"), ("postal = ''", "no_postal"))) + " from rec group by all",
    "input_profile": f"""{base.SQL}, pf as (select src, country, count(*) filter (where split = 'train') as train_n, count(*) filter (where split = 'test') as test_n, {", ".join(f"round(avg(case when split = '{s}' then ({c.format(foreign='foreign_')})::integer::double end), 6) as {s}_{k}" for k, c in RATES.items() for s in ("train", "test"))} from rec group by src, country)
select *, {", ".join(f"(greatest(coalesce(train_{k}, 0), coalesce(test_{k}, 0)) > 2 * least(coalesce(train_{k}, 0), coalesce(test_{k}, 0)))::integer as twofold_{k}" for k in RATES)} from pf""",
    "diag_list_sizes": f"with {base.TRUTH}, s as (select distinct entity_id as s1 from source1 where split = 'train'), n as (select s1, count(*) as n from tr group by s1) select coalesce(n, 0)::bigint as n_matches, count(*) as n_s1 from s left join n using (s1) group by 1",
    "diag_truth": f"{base.SQL}, {base.TRUTH}, c as (select id, min(country) as c from rec where split = 'train' group by id), o as (select count(*) filter (where a.c != b.c) as n_other_country from tr join c a on a.id = s1 join c b on b.id = r) select count(*) as n_pairs, count(*) - count(distinct r) as n_shared, any_value(n_other_country) as n_other_country from tr, o",
    "diag_crosstab": f"""{base.SQL}, {_RARE}, cp as materialized (select a.core as a, b.core as b, a.addr as la, b.addr as ra, a.postal as lp, b.postal as rp, a.country, b.foreign_ from pr join rec a on a.src = 1 and a.id = s1 and a.split = 'test' join rec b on b.src = pr.src and b.id = r and b.split = 'test'),
{S.sql_token_sets('ct', 'cp', 'a', 'b')}, cc as (select country, case when la = '' or ra = '' then 'empty_address' when foreign_ = 1 then 'other_script' when round(tset, 6) < 0.7 then 'names_apart' when lp != '' and rp != '' and lp != rp then 'postal_apart' else 'other' end as category, count(*) as n from ct group by all),
cl as (select * from cc union all select '*', category, sum(n)::bigint from cc group by category) select country, category, n, round(n::double / sum(n) over (partition by country), 6) as share from cl""",
    "diag_competition": _SC + """, k as (select *, row_number() over (partition by s1_pos order by p desc) as i, row_number() over (partition by src, r_pos order by p desc) as j from sc), a as (select s1_pos, count(*) as n, max(p) as top, coalesce(max(case when i = 2 then p end), 0) as second from k group by all),
b as (select src, r_pos, count(*) as n, max(p) as top, coalesce(max(case when j = 2 then p end), 0) as second from k group by all), m as (select round(avg(n), 6) as per_record, round(coalesce(avg(case when top >= 0.5 then (round(top - second, 6) < 0.05)::integer::double end), 0), 6) as near_ties from b)
select round(avg(n), 6) as per_s1, round(quantile_cont(top, 0.5), 6) as median_top, round(avg((top < 0.5)::integer::double), 6) as low_top, round(quantile_cont(round(top - second, 6), 0.5), 6) as median_gap, any_value(per_record) as per_record, any_value(near_ties) as near_ties from a, m""",
    "diag_top_bands": _SC + ", a as (select s1_pos, max(p) as top from sc group by all) select least(floor(top * 10), 9)::integer as band, count(*) as n_s1 from a group by 1",
    "train_sample_mask": _SC + f", c as (select *, (rank() over (partition by s1_pos, src order by p desc) <= 3 or rank() over (partition by src, r_pos order by p desc) <= 1)::integer as hard from sc) select s1_pos, src, r_pos, hard from c where hard = 1 or {_u("s1_pos || '|' || src || '|' || r_pos")} < 0.25",
    "nested_masks": f"select distinct entity_id, ({_u('entity_id')} < 0.15)::integer as small from source1 where {_u('entity_id')} < 0.4",
    "fold_assign": f"select floor({_u(chr(39) + 'fold' + chr(39) + ' || entity_id')} * 5)::integer as fold, count(*) as n from (select distinct entity_id from source1) group by 1",
    "smoke_sample": f"with {base.TRUTH}, q as (select distinct entity_id as s1 from source1 where split = 'train' and {_u('entity_id')} < 0.2), t as (select r from tr join q using (s1)), o as (select distinct 2 as src, entity_id as r from source2 where split = 'train' union all select distinct 3, entity_id from source3 where split = 'train') select src, count(*) as n from o where r in (select r from t) or {_u('r')} < 0.2 group by src union all select 1, count(*) from q",
}
