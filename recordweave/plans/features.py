"""Queries: features of candidate pairs. The pairs are those of the rarest shared token, of the test split."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordweave.functions import strings as S
from recordweave.functions import text as X
from recordweave.operators import blocking as B
from recordweave.operators import pairs as P
from recordweave.operators.pairs import KEY, L, R, both
from recordweave.plans import base
from recordweave.plans.block import _RARE, _TEST

COLS = ["name", "variants", "core", "addr", "postal", "nums", "phon", "country"]


def pairs(spark, d, split="test"):
    """(s1, src, r) with both sides' columns: COLS as l_ and r_."""
    rec = base.records(spark, d, split)
    return P.joined(B.rarest_token(rec, 20), rec, COLS)


def feat_edit_ratio(spark, d):
    p = pairs(spark, d)
    r = lambda a, b: F.round(S.edit_ratio(a, b), 6)
    nospace = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return p.select(*KEY, both("core", r(L("core"), R("core"))).alias("name_edit"), both("core", r(nospace(L("core")), nospace(R("core")))).alias("name_nospace"), both("addr", r(L("addr"), R("addr"))).alias("addr_edit"), both("core", r(L("phon"), R("phon"))).alias("name_phon"))


def feat_jaro_winkler(spark, d):
    p = pairs(spark, d)
    return p.select(*KEY, F.round(S.score(["jaro_winkler"], L("core"), R("core"))["jaro_winkler"], 6).alias("name_jw"))


def feat_ratios(spark, d):
    """The ratio families on names and addresses, and the best of trade name variants (Python)."""
    p = pairs(spark, d).withColumns(P.ratios())
    m = lambda c, v: F.round(both(c, v), 6)
    return p.select(
        *KEY, *[m("core", F.col(f"_n.{x}")).alias(f"name_{x}") for x in ("indel_ratio", "token_sort_ratio", "token_set_ratio", "partial_ratio")], *[m("core", F.col(f"_s.{x}")).alias(f"nospace_{x}") for x in ("indel_ratio", "partial_ratio")],
        *[m("addr", F.col(f"_a.{x}")).alias(f"addr_{x}") for x in ("token_sort_ratio", "token_set_ratio", "partial_ratio")], F.round("_f.token_set_ratio", 6).alias("full_token_set"), m("core", F.col("_p.indel_ratio")).alias("phon_indel_ratio"), m("core", F.col("_p.token_set_ratio")).alias("phon_token_set"), m("core", F.col("_v")).alias("variant_best"),
    )


def feat_token_ratios(spark, d):
    """The indel ratios of names and of their sorted tokens, sound keys and words run together, and the token set ratios of names."""
    p = pairs(spark, d).withColumns({k: v for k, v in P.ratios().items() if k in ("_n", "_s", "_p", "_f")})
    m = lambda v: F.round(both("core", F.col(v)), 6)
    return p.select(
        *KEY, m("_n.indel_ratio").alias("name_ratio"), m("_n.token_sort_ratio").alias("name_token_sort"), m("_n.token_set_ratio").alias("name_token_set"), m("_s.indel_ratio").alias("name_nospace_ratio"),
        m("_p.indel_ratio").alias("name_phon_ratio"), F.round("_f.token_set_ratio", 6).alias("fullname_token_set"),
    )


def feat_numbers(spark, d):
    p = pairs(spark, d)
    a, b = X.numbers(L("addr")), X.numbers(R("addr"))
    return p.select(*KEY, F.round(S.set_jaccard(a, b), 6).alias("num_jacc"), F.when((F.size(a) > 0) & (F.size(b) > 0), F.arrays_overlap(a, b).cast("int")).alias("num_any"), F.round(S.set_contained(a, b), 6).alias("num_contained"))


def feat_house_numbers(spark, d):
    """Comparisons of the longest and nearest numbers."""
    x = pairs(spark, d).withColumn("x", S.number_features(X.numbers(L("addr")), X.numbers(R("addr")))).select(*KEY, "x.*")
    return x.withColumns({c: F.round(c, 6) for c in ("best_ratio", "min_reldiff")})


def feat_flags(spark, d):
    p = pairs(spark, d)
    is_ = lambda c: c.cast("int")
    return p.select(
        *KEY, S.known_equal(L("postal"), R("postal")).alias("postal_eq"), S.known_equal(L("country"), R("country")).alias("same_country"), is_(F.col("src") == 3).alias("is_s3"), is_((L("core") == "") | (R("core") == "")).alias("name_missing"), is_(L("addr") == "").alias("addr_missing_l"),
        is_(R("addr") == "").alias("addr_missing_r"), is_((L("postal") == "") | (R("postal") == "")).alias("postal_missing"), both("core", is_(F.try_element_at(X.tokens(L("core")), F.lit(1)) == F.try_element_at(X.tokens(R("core")), F.lit(1)))).alias("first_eq")
    )


def feat_lengths(spark, d):
    p = pairs(spark, d)
    return p.select(*KEY, F.abs(F.length("l_core") - F.length("r_core")).alias("len_diff"), F.round(S.length_ratio(L("core"), R("core")), 6).alias("len_ratio"), F.size(X.tokens(L("addr"))).alias("ntok_l"), F.size(X.tokens(R("addr"))).alias("ntok_r"))


def _with_maps(spark, d):
    rec = base.records(spark, d, "test")
    maps = rec.select("src", "id", "core", "addr").join(P.text_maps(rec), ["src", "id"], "left").withColumns({m: F.coalesce(m, F.create_map().cast("map<string,double>")) for m in P.MAPS})
    return P.joined(B.rarest_token(rec, 20), maps, ["core", "addr", *P.MAPS])


def feat_tfidf_cosine(spark, d):
    """Cosines of the pair's own TF-IDF vectors of letters and words; 0 without a shared term, null without a text."""
    p = _with_maps(spark, d)
    return p.select(*KEY, *[F.round(P.cosines(p)[c], 6).alias(c) for c in ("name_tfidf", "name_word_tfidf", "addr_tfidf", "addr_word_tfidf")])


def feat_weighted_jaccard(spark, d):
    """Sum of idf of shared words over that of all."""
    p = _with_maps(spark, d)
    return p.select(*KEY, *[F.round(P.cosines(p)[c], 6).alias(c) for c in ("name_wjacc", "addr_wjacc")])


def feat_coverage(spark, d):
    """How far each core's idf is covered by the other side's words, exactly or nearly."""
    p = _with_maps(spark, d).withColumns({"lt": X.tokens(L("core")), "rt": X.tokens(R("core"))})
    p = p.withColumns({"lf": S.near_tokens(F.col("lt"), F.col("rt")), "rf": S.near_tokens(F.col("rt"), F.col("lt"))})
    a, b = S.covered(F.col("lt"), F.col("lf"), L("name_idf")), S.covered(F.col("rt"), F.col("rf"), R("name_idf"))
    return p.select(*KEY, *[F.round(both("core", c), 6).alias(n) for n, c in zip(("a_cov", "a_miss", "a_n_miss", "b_cov", "b_miss", "b_n_miss"), [*a, *b], strict=True)])


def feat_stage1(spark, d):
    """All first-stage features of the rarest-token pairs; columns of the blocking passes are null (Python ratios, so without SQL)."""
    rec = base.records(spark, d, "test")
    p = B.rarest_token(rec, 20).select(*KEY, *[F.lit(None).cast("double").alias(c) for c in P.PASSES])
    return P.stage1_features(p, rec).select(*KEY, *[F.round(F.col(c).cast("double"), 6).alias(c) for c in P.STAGE1])


def feat_base_score(spark, d):
    """Half name, half address cosine of letters; the name's alone without an address; with rank and gap among competitors."""
    from recordweave.operators.context import add_context

    p = _with_maps(spark, d)
    c = P.cosines(p)
    p = p.select(*KEY, F.round(F.when(c["base_addr"].isNull(), c["base_name"]).otherwise(0.5 * c["base_name"] + 0.5 * c["base_addr"]), 5).alias("base"))
    c = add_context(p, "base", ["s1", "src"], ["src", "r"])
    return c.withColumns({x: F.round(x, 5) for x in ("ctx_gap_s1", "ctx_gap_rec")})


QUERIES = {f.__name__: f for f in (feat_edit_ratio, feat_jaro_winkler, feat_ratios, feat_token_ratios, feat_numbers, feat_house_numbers, feat_flags, feat_lengths, feat_tfidf_cosine, feat_weighted_jaccard, feat_coverage, feat_base_score, feat_stage1)}

_P = f"""{base.SQL}, {_RARE}, pj as materialized (select s1, pr.src, r, {", ".join(f"a.{c} as l_{c}, b.{c} as r_{c}" for c in COLS)} from pr join rec a on a.src = 1 and a.id = s1 and a.{_TEST} join rec b on b.src = pr.src and b.id = r and b.{_TEST})"""
_edit = lambda a, b: f"case when greatest(length({a}), length({b})) = 0 then 1 else 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::double end"
_there = lambda c, v: f"case when l_{c} != '' and r_{c} != '' then {v} end"
_ns = lambda c: f"replace({c}, ' ', '')"
_na, _nb = X.sql_numbers("l_addr"), X.sql_numbers("r_addr")
_nums = lambda v: f"case when len({_na}) > 0 and len({_nb}) > 0 then {v} end"
_count = lambda c: f"len(list_filter(string_split({c}, ' '), lambda t: t != ''))::integer"
_first = lambda c: f"string_split({c}, ' ')[1]"
_words = lambda c: f"list_filter(string_split({c}, ' '), lambda t: t != '')"
_char3 = lambda c: f"flatten(list_transform({_words(c)}, lambda v: list_transform(range(1, length(v) + 1), lambda i: substr(' ' || v || ' ', i, 3))))"
# terms, vocabularies and weights of all records of the split: letters (nc, ac) and words (nw, aw) of names and addresses
_VEC = f"""vr as (select * from rec where {_TEST}), vx as (select src, id, 'nc' as kind, unnest({_char3('core')}) as term from vr union all select src, id, 'nw', unnest({_words('core')}) from vr union all select src, id, 'ac', unnest({_char3('addr')}) from vr union all select src, id, 'aw', unnest({_words('addr')}) from vr),
vc as (select src, id, kind, term, count(*) as tf from vx group by all), vv as (select kind, term, ln((1.0 + (select count(*) from vr)) / (1.0 + count(*))) + 1.0 as idf from vc group by kind, term having count(*) >= 2 or kind in ('nw', 'aw')),
vq as (select src, id, kind, term, idf, (case when kind in ('nc', 'ac') then 1.0 + ln(tf) else tf end) * idf as q from vc join vv using (kind, term)),
vw as materialized (select src, id, kind, term, idf, q / sqrt(sum(q * q) over (partition by src, id, kind)) as w from vq)"""
ORACLE = {
    "feat_edit_ratio": f"{_P} select s1, src, r, {_there('core', f'round({_edit("l_core", "r_core")}, 6)')} as name_edit, {_there('core', f'round({_edit(_ns("l_core"), _ns("r_core"))}, 6)')} as name_nospace, {_there('addr', f'round({_edit("l_addr", "r_addr")}, 6)')} as addr_edit, {_there('core', f'round({_edit("l_phon", "r_phon")}, 6)')} as name_phon from pj",
    "feat_jaro_winkler": f"{_P} select s1, src, r, round(jaro_winkler_similarity(l_core, r_core), 6) as name_jw from pj",
    "feat_token_ratios": f"""{_P}, ts as (select *, array_to_string(list_sort(string_split(l_core, ' ')), ' ') as l_sort, array_to_string(list_sort(string_split(r_core, ' ')), ' ') as r_sort, replace(l_core, ' ', '') as l_ns, replace(r_core, ' ', '') as r_ns from pj),
{S.sql_token_sets('tn', 'ts', 'l_core', 'r_core')}, tm as (select * rename (tset as tset_n) from tn), {S.sql_token_sets('tf', 'tm', 'l_name', 'r_name')}
select s1, src, r, {", ".join(f"{_there('core', f'round({v}, 6)')} as {n}" for n, v in (("name_ratio", S.sql_indel("l_core", "r_core")), ("name_token_sort", S.sql_indel("l_sort", "r_sort")), ("name_token_set", "tset_n"), ("name_nospace_ratio", S.sql_indel("l_ns", "r_ns")), ("name_phon_ratio", S.sql_indel("l_phon", "r_phon"))))}, round(tset, 6) as fullname_token_set from tf""",
    "feat_house_numbers": f"""{_P}, hn as (select s1, src, r, {_na} as a, {_nb} as b from pj), ht as (select s1, src, r, a, b, case when len(list_filter(a, lambda x: length(x) > 1)) > 0 then list_filter(a, lambda x: length(x) > 1) else a end as p, case when len(list_filter(b, lambda x: length(x) > 1)) > 0 then list_filter(b, lambda x: length(x) > 1) else b end as q from hn),
hx as (select s1, src, r, x, y from (select s1, src, r, unnest(p) as x, q from ht where len(a) > 0 and len(b) > 0), unnest(q) as t(y)),
hd as (select s1, src, r, max({S.sql_indel('x', 'y')}) as best, min(case when x = y then 0 else abs(substr(x, 1, 12)::bigint - substr(y, 1, 12)::bigint)::double / greatest(substr(x, 1, 12)::bigint, substr(y, 1, 12)::bigint, 1) end) as rel, max((x != y and (starts_with(x, y) or starts_with(y, x)))::integer) as pre from hx group by all)
select s1, src, r, case when best is not null then (list_max(list_transform(p, lambda x: {{'l': length(x), 'x': x}})) = list_max(list_transform(q, lambda x: {{'l': length(x), 'x': x}})))::integer::double end as longest_eq,
case when best is not null then list_contains(q, list_max(list_transform(p, lambda x: {{'l': length(x), 'x': x}})).x)::integer::double end as longest_in, round(best, 6) as best_ratio, round(case when rel > 1 then 1.0 else rel end, 6) as min_reldiff, pre::double as prefix from ht left join hd using (s1, src, r)""",
    "feat_coverage": f"""{_P}, {_VEC}, ct as (select s1, src, r, 'a' as side, unnest({_words('l_core')}) as t, {_words('r_core')} as o, 1 as os, s1 as oid from pj where l_core != '' and r_core != '' union all select s1, src, r, 'b', unnest({_words('r_core')}), {_words('l_core')}, src, r from pj where l_core != '' and r_core != ''),
cd as (select distinct t, unnest(o) as o from ct), ce as (select distinct t, o from cd where t = o or {S.sql_indel('t', 'o')} >= 0.8 - 1e-9),
cw as (select ct.s1, ct.src, ct.r, side, ct.t, vw.idf, exists (select 1 from ce where ce.t = ct.t and list_contains(ct.o, ce.o)) as f from ct join vw on vw.kind = 'nw' and vw.src = os and vw.id = oid and vw.term = ct.t),
cg as (select s1, src, r, side, sum(case when f then idf else 0 end) / sum(idf) as cov, coalesce(max(case when not f then idf end), 0) as miss, sum((not f)::integer)::double as n from cw group by all)
select pj.s1, pj.src, pj.r, round(a.cov, 6) as a_cov, round(a.miss, 6) as a_miss, a.n as a_n_miss, round(b.cov, 6) as b_cov, round(b.miss, 6) as b_miss, b.n as b_n_miss
from pj left join cg a on a.side = 'a' and a.s1 = pj.s1 and a.src = pj.src and a.r = pj.r left join cg b on b.side = 'b' and b.s1 = pj.s1 and b.src = pj.src and b.r = pj.r""",
    "feat_numbers": f"{_P} select s1, src, r, round({_nums(f'len(list_intersect({_na}, {_nb}))::double / len(list_distinct(list_concat({_na}, {_nb})))')}, 6) as num_jacc, {_nums(f'(len(list_intersect({_na}, {_nb})) > 0)::integer')} as num_any, round({_nums(f'len(list_intersect({_na}, {_nb}))::double / least(len({_na}), len({_nb}))')}, 6) as num_contained from pj",
    "feat_flags": f"{_P} select s1, src, r, {_there('postal', '(l_postal = r_postal)::integer')} as postal_eq, {_there('country', '(l_country = r_country)::integer')} as same_country, (src = 3)::integer as is_s3, (l_core = '' or r_core = '')::integer as name_missing, (l_addr = '')::integer as addr_missing_l, (r_addr = '')::integer as addr_missing_r, (l_postal = '' or r_postal = '')::integer as postal_missing, {_there('core', f'({_first("l_core")} = {_first("r_core")})::integer')} as first_eq from pj",
    "feat_lengths": f"{_P} select s1, src, r, abs(length(l_core) - length(r_core))::integer as len_diff, round(least(length(l_core), length(r_core))::double / greatest(length(l_core), length(r_core), 1), 6) as len_ratio, {_count('l_addr')} as ntok_l, {_count('r_addr')} as ntok_r from pj",
    "feat_tfidf_cosine": f"""{_P}, {_VEC}, cs as (select s1, pj.src, r, a.kind, sum(a.w * b.w) as c from pj join vw a on a.src = 1 and a.id = s1 join vw b on b.src = pj.src and b.id = r and a.term = b.term and a.kind = b.kind group by all)
select s1, src, r, {", ".join(f"{_there(f, f'round(coalesce(max(case when kind = {chr(39)}{k}{chr(39)} then c end), 0), 6)')} as {n}" for f, k, n in (("core", "nc", "name_tfidf"), ("core", "nw", "name_word_tfidf"), ("addr", "ac", "addr_tfidf"), ("addr", "aw", "addr_word_tfidf")))} from pj left join cs using (s1, src, r) group by s1, src, r, l_core, r_core, l_addr, r_addr""",
    "feat_weighted_jaccard": f"""{_P}, {_VEC}, uw as (select s1, src, r, kind, term, max(idf) as idf, max(l) * max(g) as b from (select s1, pj.src, r, kind, term, idf, 1 as l, 0 as g from pj join vw on vw.src = 1 and id = s1 union all select s1, pj.src, r, kind, term, idf, 0, 1 from pj join vw on vw.src = pj.src and id = r) where kind in ('nw', 'aw') group by all),
jw as (select s1, src, r, kind, round(sum(idf * b) / sum(idf), 6) as j from uw group by all)
select s1, src, r, {_there('core', "max(case when kind = 'nw' then j end)")} as name_wjacc, {_there('addr', "max(case when kind = 'aw' then j end)")} as addr_wjacc from pj left join jw using (s1, src, r) group by s1, src, r, l_core, r_core, l_addr, r_addr""",
    "feat_base_score": f"""{_P}, {_VEC}, cs as (select s1, pj.src, r, a.kind, sum(a.w * b.w) as c from pj join vw a on a.src = 1 and a.id = s1 join vw b on b.src = pj.src and b.id = r and a.term = b.term and a.kind = b.kind where a.kind in ('nc', 'ac') group by all),
cb as (select s1, src, r, coalesce(max(case when kind = 'nc' then c end), 0) as n, {_there('addr', "coalesce(max(case when kind = 'ac' then c end), 0)")} as a from pj left join cs using (s1, src, r) group by s1, src, r, l_addr, r_addr),
bs as (select s1, src, r, round(case when a is null then n else 0.5 * n + 0.5 * a end, 5) as base from cb)
select *, rank() over (partition by s1, src order by base desc)::integer as ctx_rank_s1, round(max(base) over (partition by s1, src) - base, 5) as ctx_gap_s1, count(*) over (partition by s1, src) as n_cand_s1,
rank() over (partition by src, r order by base desc)::integer as ctx_rank_rec, round(max(base) over (partition by src, r) - base, 5) as ctx_gap_rec, count(*) over (partition by src, r) as ctx_n_rec from bs""",
}
