"""Queries: vocabularies, blocking passes, expansion and recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordweave.operators import blocking as B
from recordweave.operators import tfidf
from recordweave.plans import base
from recordweave.runtime import cut, once


def _vocab(spark, d, name):
    r = base.records(spark, d, "test")
    p = B.passes()[name]
    c = tfidf.term_counts(r.withColumn("k", F.concat_ws("/", "src", "id")), "k", p.terms())
    return r, p, c, tfidf.vocabulary(c, r.count(), 2, p.max_df)


def tfidf_vocab(spark, d):
    return _vocab(spark, d, "na")[3].withColumn("idf", F.round("idf", 6))


def char4_vocab(spark, d):
    return _vocab(spark, d, "c4")[3].withColumn("idf", F.round("idf", 6))


def tfidf_weights(spark, d):
    _, _, c, v = _vocab(spark, d, "nm")
    return tfidf.weights(c, v, "k").select("k", "term", F.round("w", 6).alias("w"))


def _pass(name, reverse=False):
    def query(spark, d):
        f, b = B.run_pass(base.records(spark, d, "test"), B.passes()[name], 2 if reverse else 0)
        return b if reverse else f

    query.__doc__ = f"Pass {name}: the best neighbours of each source1 record per source" + (", reversed" if reverse else "")
    return query


block_na_topk, block_c4_topk, block_ph_topk, block_nm_topk, block_rev_topk = _pass("na"), _pass("c4"), _pass("ph"), _pass("nm"), _pass("na", True)


def round1(spark, d, split):
    """(s1, src, r, rank_ and sim_ of each pass): all candidates of the split."""

    def make():
        r, ps = base.records(spark, d, split), B.passes()
        na, rev = B.run_pass(r, ps["na"], 2)
        return B.united({"na": na, **{n: B.run_pass(r, ps[n])[0] for n in ("c4", "ph", "nm")}, "rev": rev})

    return once(spark, f"round1 {split}", [f"{d}/source{k}.parquet" for k in (1, 2, 3)], make)


def _found(spark, d, split):
    """(s1, src, r, rank_na, sim_na): what pass na finds; of all candidates those with rank_na < 255, without the other passes."""

    def make():
        x, _ = B.run_pass(base.records(spark, d, split), B.passes()["na"])
        return x.select("s1", "src", "r", F.col("rank").cast("int").alias("rank_na"), F.col("sim").alias("sim_na"))

    return once(spark, f"found {split}", [f"{d}/source{k}.parquet" for k in (1, 2, 3)], make)


def block_union_pivot(spark, d):
    return round1(spark, d, "test")


def block_report_recall(spark, d):
    """Recall of the known pairs of the train split, overall and by pass and rank."""
    return B.report(round1(spark, d, "train"), base.truth(spark, d), base.records(spark, d, "train"), {n: f"rank_{n}" for n in ("na", "c4", "ph", "nm", "rev")})


def pass_postal_num(spark, d):
    return B.shared_keys(base.records(spark, d, "test"), B.postal_number_key(), 20)


def pass_phonetic_key(spark, d):
    key = F.when(F.col("phon") != "", F.array(F.concat_ws("|", "country", "phon"))).otherwise(F.array().cast("array<string>"))
    return B.shared_keys(base.records(spark, d, "test"), key, 100)


def pass_rare_token(spark, d):
    return B.rarest_token(base.records(spark, d, "test"), 20)


def pass_empty_addr(spark, d):
    """Records without address: best source1 records of their label by core words."""
    return B.empty_address_pairs(base.records(spark, d, "test"))


def pass_sibling(spark, d):
    """Neighbours among source2 and source3 records of each source1 record's five best candidates, without known pairs."""
    r, found = base.records(spark, d, "test"), _found(spark, d, "test")
    a = cut(B.anchors(found, "sim_na"))
    return B.new_pairs(B.sibling_pairs(a, B.neighbours(r, a)), found)


def _expansions(spark, d, split):
    r, found = base.records(spark, d, split), round1(spark, d, split)
    key = F.when(F.col("phon") != "", F.array(F.concat_ws("|", "country", "phon"))).otherwise(F.array().cast("array<string>"))
    a = cut(B.anchors(found.filter("rank_na < 255"), "sim_na"))
    return r, found, {"postal_num": B.shared_keys(r, B.postal_number_key(), 20), "rare_token": B.rarest_token(r, 20), "phonetic_key": B.shared_keys(r, key, 100), "empty_addr": B.empty_address_pairs(r).select("s1", "src", "r"), "sibling": B.sibling_pairs(a, B.neighbours(r, a))}


def pass_gain(spark, d):
    """What each expansion pass adds to the recall of the blocking passes on the train split, and its new pairs per source1 record."""
    r, found, passes = _expansions(spark, d, "train")
    known, truth, n = cut(found.select("s1", "src", "r")), cut(base.truth(spark, d)), r.filter("src = 1").count()
    out = None
    for name, x in passes.items():
        g = B.gain(x, known, truth, n).select(F.lit(name).alias("pass"), "*")
        out = g if out is None else out.unionByName(g)
    return out


def sibling_variants(spark, d):
    """Gain and cost of sibling expansion for several numbers of anchors and neighbours, on the train split (a sweep, so without SQL)."""
    r, found = base.records(spark, d, "train"), _found(spark, d, "train")
    known, truth, n, out = cut(found.select("s1", "src", "r")), cut(base.truth(spark, d)), r.filter("src = 1").count(), None
    a = cut(B.anchors(found, "sim_na", 10))
    near = cut(B.neighbours(r, a, 11))
    for top in (3, 5, 10):
        some = B.anchors(a.drop("_r"), "sim_na", top)
        g = B.gain(B.sibling_pairs(some, near), known, truth, n).select(F.lit(top).alias("anchors"), F.lit(10).alias("neighbours"), "*")
        out = g if out is None else out.unionByName(g)
    return out


def new_pairs_antijoin(spark, d):
    r = base.records(spark, d, "test")
    return B.new_pairs(B.rarest_token(r, 20), B.shared_keys(r, B.postal_number_key(), 20))


def label_pairs(spark, d):
    """Phonetic-key pairs of the train split with y: whether the pair is known to match."""
    key = F.when(F.col("phon") != "", F.array(F.concat_ws("|", "country", "phon"))).otherwise(F.array().cast("array<string>"))
    p = B.shared_keys(base.records(spark, d, "train"), key, 100)
    y = base.truth(spark, d).withColumn("y", F.lit(1))
    return p.join(y, ["s1", "r"], "left").select("s1", "src", "r", F.coalesce("y", F.lit(0)).alias("y"))


QUERIES = {
    n: globals()[n]
    for n in (
        "tfidf_vocab char4_vocab tfidf_weights block_na_topk block_c4_topk block_ph_topk block_nm_topk block_rev_topk block_union_pivot block_report_recall pass_postal_num pass_phonetic_key pass_rare_token pass_empty_addr pass_sibling pass_gain sibling_variants new_pairs_antijoin label_pairs"
    ).split()
}

_TEXT = {"na": "trim(core || ' ' || addr)", "c4": "trim(core || ' ' || addr)", "ph": "trim(phon || ' ' || addr)", "nm": "core"}


def _sql_terms(name: str, p: str) -> str:
    words = f"list_filter(string_split({_TEXT[name]}, ' '), lambda t: t != '')"
    if name != "c4":
        return words
    return f"flatten(list_transform({words}, lambda v: list_transform(range(1, greatest(1, length(v) - 1) + 1), lambda i: substr(' ' || v || ' ', i, 4))))"


def _sql_weights(name: str, where: str) -> str:
    """CTEs wNAME(src, id, term, w) over the rows of rec that where selects; vNAME is the vocabulary."""
    p = {"na": 0.01, "c4": 0.002, "ph": 0.01, "nm": 0.01}[name]
    return f"""rs{name} as (select * from rec where {where}),
x{name} as (select src, id, unnest({_sql_terms(name, '')}) as term from rs{name}), c{name} as (select src, id, term, count(*) as tf from x{name} group by all),
m{name} as (select count(*) as n from rs{name}),
v{name} as (select term, count(*) as df, ln((1.0 + any_value(m.n)) / (1.0 + count(*))) + 1.0 as idf from c{name}, m{name} m group by term having count(*) >= 2 and count(*) <= {p} * any_value(m.n)),
q{name} as (select src, id, term, (1.0 + ln(tf)) * idf as r from c{name} join v{name} using (term)),
l{name} as (select src, id, sqrt(sum(r * r)) as norm from q{name} group by all),
w{name} as (select src, id, term, r / norm as w from q{name} join l{name} using (src, id))"""


def _sql_pass(name: str, k: int, where: str, reverse: int = 0) -> str:
    """CTEs fNAME and bNAME (s1, src, r, rank, sim)."""
    return (
        _sql_weights(name, where)
        + f""",
lb{name} as (select distinct country as pool from rs{name} where country != ''),
lc{name} as (select pool from lb{name} union all select '' where not exists (select 1 from lb{name})),
pl{name} as (select src, id, country as pool from rs{name} where country != '' union all select src, id, pool from rs{name}, lc{name} where country = ''),
pw{name} as materialized (select w.*, pool from w{name} w join pl{name} using (src, id)),
s{name} as (select a.pool, a.id as s1, b.src, b.id as r, round(sum(a.w * b.w), 6) as sim from pw{name} a join pw{name} b on a.term = b.term and a.pool = b.pool and a.src = 1 and b.src != 1 group by all having round(sum(a.w * b.w), 6) > 0.000001),
f{name} as (select s1, src, r, min(k - 1)::integer as rank, max(sim) as sim from (select *, row_number() over (partition by s1, src, pool order by sim desc, r) as k from s{name}) where k <= {k} group by all),
b{name} as (select s1, src, r, min(k - 1)::integer as rank, max(sim) as sim from (select *, row_number() over (partition by r, src, pool order by sim desc, s1) as k from s{name}) where k <= {max(1, reverse)} group by all)"""
    )


def _sql_union(where: str) -> str:
    ks = {"na": 10, "c4": 5, "ph": 5, "nm": 5}
    ctes = ",\n".join(_sql_pass(n, k, where, 2) for n, k in ks.items())
    all_ = " union all ".join([f"select *, '{n}' as pass from f{n}" for n in ks] + ["select *, 'rev' from bna"])
    cols = ", ".join(f"coalesce(max(case when pass = '{n}' then rank end), 255)::integer as rank_{n}, max(case when pass = '{n}' then sim end) as sim_{n}" for n in [*ks, "rev"])
    return f"{base.SQL},\n{ctes}, uu as ({all_}), un as (select s1, src, r, {cols} from uu group by s1, src, r)"


_TEST = "split = 'test'"


def _sql_label(n: str, text: str, where: str, fit: str, split: str = "test") -> str:
    """CTE wN(src, id, pool, term, w): word weights with a vocabulary per label, fitted on the rows that fit names."""
    return f"""rs{n} as (select * from rec where split = '{split}' and {where}), x{n} as (select src, id, country as pool, {fit} as fit, unnest(list_filter(string_split({text}, ' '), lambda t: t != '')) as term from rs{n}),
c{n} as (select src, id, pool, fit, term, count(*) as tf from x{n} group by all), m{n} as (select country as pool, count(*) as n from rs{n} where {fit} group by all),
v{n} as (select pool, term, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1.0 as idf from c{n} join m{n} using (pool) where fit group by pool, term having count(*) >= 2 and count(*) <= 0.01 * any_value(n)),
q{n} as (select src, id, pool, term, (1.0 + ln(tf)) * idf as r from c{n} join v{n} using (pool, term)), l{n} as (select src, id, pool, sqrt(sum(r * r)) as norm from q{n} group by all),
w{n} as materialized (select src, id, pool, term, r / norm as w from q{n} join l{n} using (src, id, pool))"""


_NUMKEY = "list_filter(list_sort(list_distinct(regexp_extract_all(addr, '\\d+'))), lambda n: n != postal)"
_POSTAL = f"""kp as (select src, id, country || '|' || postal || '|' || unnest({_NUMKEY}) as key from rec where {_TEST} and postal != ''),
fp as (select key from kp where src = 1 group by key having count(*) <= 20),
pp as (select distinct a.id as s1, b.src, b.id as r from kp a join fp using (key) join kp b on a.key = b.key and a.src = 1 and b.src != 1)"""
_RARE = f"""tk as (select src, id, country, unnest(list_distinct(list_filter(string_split(core, ' '), lambda t: t != ''))) as token from rec where {_TEST}),
dk as (select country, token, count(*) as df from tk where src = 1 group by all),
rk as (select src, id, country, token, df, row_number() over (partition by src, id, country order by df, token) as k from tk join dk using (country, token) where src != 1),
pr as (select distinct a.id as s1, b.src, b.id as r from rk b join tk a on a.src = 1 and a.country = b.country and a.token = b.token where b.k = 1 and b.df <= 20)"""


def _phon(split: str) -> str:
    return f"""kf as (select src, id, country || '|' || phon as key from rec where split = '{split}' and phon != ''), ff as (select key from kf where src = 1 group by key having count(*) <= 100),
pf as (select distinct a.id as s1, b.src, b.id as r from kf a join ff using (key) join kf b on a.key = b.key and a.src = 1 and b.src != 1)"""


_RECALL = _sql_union("split = 'train'") + f""", {base.TRUTH}, tn as (select count(*)::double as n from tr), cy as (select un.*, case when tr.r is not null then 1 end as y from un left join tr using (s1, r)),
sz as (select sum(a * b)::double as full_, sum(a)::double as n1, sum(b)::double as n2 from (select country, count(*) filter (where src = 1) as a, count(*) filter (where src != 1) as b from rec where split = 'train' group by country)),
ag as (select sum(y) / any_value(n) as recall, count(*) / any_value(n1) as per_s1, 1 - count(*) / any_value(full_) as reduction, 1 - count(*) / (any_value(n1) * any_value(n2)) as reduction_full, {", ".join(f"coalesce(sum(case when rank_{p} < {k} then y end), 0) / any_value(n) as {p}_at_{k}" for p in ("na", "c4", "ph", "nm", "rev") for k in (1, 3, 5, 10, 20))} from cy, tn, sz)
select metric, round(value, 6) as value from (unpivot ag on columns(*) into name metric value value)"""
ORACLE = {
    "tfidf_vocab": f"{base.SQL}, {_sql_weights('na', _TEST)} select term, df, round(idf, 6) as idf from vna",
    "char4_vocab": f"{base.SQL}, {_sql_weights('c4', _TEST)} select term, df, round(idf, 6) as idf from vc4",
    "tfidf_weights": f"{base.SQL}, {_sql_weights('nm', _TEST)} select src || '/' || id as k, term, round(w, 6) as w from wnm",
    **{f"block_{n}_topk": f"{base.SQL}, {_sql_pass(n, k, _TEST)} select * from f{n}" for n, k in (("na", 10), ("c4", 5), ("ph", 5), ("nm", 5))},
    "block_rev_topk": f"{base.SQL}, {_sql_pass('na', 10, _TEST, 2)} select * from bna",
    "block_union_pivot": _sql_union(_TEST) + " select * from un",
    "block_report_recall": _RECALL,
    "pass_postal_num": f"{base.SQL}, {_POSTAL} select * from pp",
    "pass_phonetic_key": f"{base.SQL}, {_phon('test')} select * from pf",
    "pass_rare_token": f"{base.SQL}, {_RARE} select * from pr",
    "pass_empty_addr": f"""{base.SQL}, {_sql_label('e', 'core', "country != '' and (src = 1 or addr = '')", 'src = 1')},
se as (select a.id as s1, b.src, b.id as r, round(sum(a.w * b.w), 6) as sim from we a join we b on a.pool = b.pool and a.term = b.term and a.src = 1 and b.src != 1 group by all having round(sum(a.w * b.w), 6) > 0.000001)
select s1, src, r, (k - 1)::integer as rank, sim from (select *, row_number() over (partition by r, src order by sim desc, s1) as k from se) where k <= 50""",
    "pass_sibling": f"""{base.SQL}, {_sql_pass('na', 10, _TEST)}, {_sql_label('l', "trim(core || ' ' || addr)", "country != '' and src != 1", 'true')},
an as (select s1, src, r from (select *, row_number() over (partition by s1 order by sim desc, src, r) as k from fna) where k <= 5),
sb as (select a.src, a.id as r, b.src as src2, b.id as r2, round(sum(a.w * b.w), 6) as sim from wl a join wl b on a.term = b.term and a.pool = b.pool and (a.src, a.id) in (select src, r from an) group by all having round(sum(a.w * b.w), 6) > 0.000001),
nb as (select * from (select *, row_number() over (partition by src, r order by sim desc, src2, r2) as k from sb) where k <= 11)
select distinct s1, src2 as src, r2 as r from an join nb using (src, r) where not exists (select 1 from fna f where f.s1 = an.s1 and f.src = nb.src2 and f.r = nb.r2)""",
    "pass_gain": f"""{_sql_union("split = 'train'")}, {base.TRUTH}, {_POSTAL.replace(_TEST, "split = 'train'")}, {_RARE.replace(_TEST, "split = 'train'")}, {_phon('train')},
{_sql_label('e', 'core', "country != '' and (src = 1 or addr = '')", 'src = 1', 'train')}, se as (select a.id as s1, b.src, b.id as r, round(sum(a.w * b.w), 6) as sim from we a join we b on a.pool = b.pool and a.term = b.term and a.src = 1 and b.src != 1 group by all having round(sum(a.w * b.w), 6) > 0.000001),
pe as (select s1, src, r from (select *, row_number() over (partition by r, src order by sim desc, s1) as k from se) where k <= 50),
{_sql_label('l', "trim(core || ' ' || addr)", "country != '' and src != 1", 'true', 'train')}, an as (select s1, src, r from (select *, row_number() over (partition by s1 order by sim_na desc, src, r) as k from un where rank_na < 255) where k <= 5),
sb as (select a.src, a.id as r, b.src as src2, b.id as r2, round(sum(a.w * b.w), 6) as sim from wl a join wl b on a.term = b.term and a.pool = b.pool and (a.src, a.id) in (select src, r from an) group by all having round(sum(a.w * b.w), 6) > 0.000001),
nb as (select * from (select *, row_number() over (partition by src, r order by sim desc, src2, r2) as k from sb) where k <= 11),
ep as (select 'postal_num' as pass, * from pp union all select 'rare_token', * from pr union all select 'phonetic_key', * from pf union all select 'empty_addr', * from pe union all select distinct 'sibling', s1, src2, r2 from an join nb using (src, r)),
nw as (select distinct pass, s1, src, r from ep anti join un using (s1, src, r)), ht as (select pass, count(*) as b from (select distinct pass, s1, r from nw semi join tr using (s1, r)) group by pass),
nn as (select pass, count(*) as c from nw group by pass), bb as (select (select count(*) from (select distinct s1, r from un semi join tr using (s1, r)))::double as a, (select count(*) from tr)::double as t, (select count(*) from rec where split = 'train' and src = 1)::double as n)
select p.pass, round(a / t, 6) as recall, round(coalesce(b, 0) / t, 6) as gain, round(coalesce(c, 0) / n, 6) as per_s1 from (select unnest(['postal_num', 'rare_token', 'phonetic_key', 'empty_addr', 'sibling']) as pass) p left join ht using (pass) left join nn using (pass), bb""",
    "new_pairs_antijoin": f"{base.SQL}, {_POSTAL}, {_RARE} select * from pr except select * from pp",
    "label_pairs": f"{base.SQL}, {_phon('train')}, {base.TRUTH} select s1, src, r, (tr.r is not null)::integer as y from pf left join tr using (s1, r)",
}
