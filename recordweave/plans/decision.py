"""Queries: competition context, decisions, metrics, lists and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordweave.operators import blocking as B
from recordweave.operators import context as C
from recordweave.operators import decide as D
from recordweave.operators import validate as V
from recordweave.plans import base
from recordweave.plans.block import _phon, _sql_union
from recordweave.runtime import cut, table
from recordweave.sources import files as IO

P6 = lambda *cs: {c: F.round(c, 6) for c in cs}


def ctx_stage1(spark, d):
    c = C.add_context(base.scored(spark, d), "p", ["s1_pos", "src"], ["src", "r_pos"])
    return c.withColumns(P6("ctx_gap_s1", "ctx_gap_rec"))


def ctx_stage2(spark, d):
    """Context among pairs of p >= 0.0001; both sources compete within a source1 record."""
    c = base.scored(spark, d).filter("p >= 0.0001")
    c = C.competition(C.competition(c, "p", ["s1_pos"], "s1"), "p", ["src", "r_pos"], "rec")
    return c.withColumns(P6(*[f"{k}_{x}" for k in ("s1", "rec") for x in ("gap", "sum")]))


def ctx_density(spark, d):
    """Competition within a sampled universe of source1 records, half of them drawn."""
    c = base.scored(spark, d).withColumn("drawn", IO.uniform(F.col("s1_pos")) < 0.5)
    return C.sampled_competition(c, "p", ["src", "r_pos"], "drawn").withColumns(P6("sum_other")).drop("drawn")


def anchors_topn(spark, d):
    c = base.scored(spark, d).select(F.col("s1_pos").alias("s1"), "src", F.col("r_pos").alias("r"), "p")
    return B.anchors(c, "p", 5)


def name_freq(spark, d):
    r = base.records(spark, d, "test").filter("core != ''")
    return r.groupBy("country", "core").agg(F.sum((F.col("src") == 1).cast("long")).alias("n_s1"), F.sum((F.col("src") != 1).cast("long")).alias("n_rec"))


def matched_stage1(spark, d):
    """First-stage record context within a sampled universe of source1 records; a pair itself always counts."""
    c = base.scored(spark, d).withColumn("drawn", IO.uniform(F.col("s1_pos")) < 0.5)
    return C.matched_context(c, "p", ["src", "r_pos"], "drawn").drop("drawn").withColumns(P6("m_gap"))


def matched_stage2(spark, d):
    """Second-stage record context within a sampled universe of source1 records; a pair itself always counts."""
    c = base.scored(spark, d).withColumn("drawn", IO.uniform(F.col("s1_pos")) < 0.5)
    return C.matched_competition(c, "p", ["src", "r_pos"], "drawn").drop("drawn").withColumns(P6("m_gap", "m_sum"))


def context_check(spark, d):
    """Pairs whose record context is the same by the plain and by the sampled definition when all are drawn: inner join on the pair."""
    c = base.scored(spark, d)
    a = C.add_context(c, "p", ["s1_pos", "src"], ["src", "r_pos"]).select("s1_pos", "src", "r_pos", "ctx_rank_rec", F.round("ctx_gap_rec", 6).alias("gap"), "ctx_n_rec")
    b = C.matched_context(c.withColumn("drawn", F.lit(True)), "p", ["src", "r_pos"], "drawn")
    same = (F.col("ctx_rank_rec") == F.col("m_rank")) & (F.col("gap") == F.round("m_gap", 6)) & (F.col("ctx_n_rec") == F.col("m_n"))
    return a.join(b, ["s1_pos", "src", "r_pos"]).agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(same.cast("int")).alias("n_same"))


def sibling_features(spark, d):
    """All ten agreements of a candidate with its siblings (names and addresses by edit ratio, which SQL has as well)."""
    from recordweave.functions.text import numbers

    r = base.records(spark, d, "test")
    one = lambda x: x.groupBy("src", "pos").agg(F.min("core").alias("core"), F.min("addr").alias("addr"))
    rec = one(r.filter("src != 1")).select(F.struct("src", F.col("pos").alias("r_pos")).alias("rec"), "core", "addr", numbers(F.col("addr")).alias("nums"))
    s1 = one(r.filter("src = 1")).select(F.col("pos").alias("s1_pos"), numbers(F.col("addr")).alias("nums"))
    p = base.scored(spark, d).select("s1_pos", F.struct("src", "r_pos").alias("rec"), "p")
    s = C.siblings(p, rec, "s1_pos", "rec", "p", 0.5, queries=s1)
    return s.select("s1_pos", F.col("rec.src").alias("src"), F.col("rec.r_pos").alias("r_pos"), "sib_n", *[F.round(c, 5).alias(c) for c in C.SIBLING[1:]])


def one_owner(spark, d):
    return D.owned(base.scored(spark, d), "s1_pos", ["src", "r_pos"], "p").filter("is_owner").drop("is_owner")


def _kept(spark, d, first=0.6, add=0.7):
    return D.ranked(base.scored(spark, d), "s1_pos", ["src", "r_pos"], "p").filter(D.kept(first, add)).select("s1_pos", "src", "r_pos", "p")


def decide_keep(spark, d):
    return _kept(spark, d)


def country_probe(spark, d):
    """The keep rule with a first threshold 0.1 higher for source1 records of the most frequent label; reports how many pairs change."""
    s1 = table(spark, d, "source1").filter("split = 'test'").select(F.col("pos").alias("s1_pos"), "country").distinct()
    top = s1.filter("country != ''").groupBy("country").agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("country", F.struct(-F.col("n"), "country")).alias("top"))
    r = D.ranked(base.scored(spark, d), "s1_pos", ["src", "r_pos"], "p").join(s1, "s1_pos").join(F.broadcast(top), F.lit(True))  # one row
    t = F.when(F.col("country") == F.col("top"), 0.7).otherwise(0.6)
    r = r.withColumns({"a": D.kept(0.6, 0.7).cast("int"), "b": D.kept(t, F.lit(0.7)).cast("int")})
    return r.groupBy("country").agg(F.sum("a").alias("n_before"), F.sum("b").alias("n_after"), F.sum((F.col("a") != F.col("b")).cast("int")).alias("n_changed"))


def near_tie_rate(spark, d):
    return D.near_tie_rate(base.scored(spark, d), ["src", "r_pos"], "p", 0.05, 0.5)


def _labelled(spark, d):
    """Train pairs of one phonetic key with a score from the address; s1 domain; truth."""
    from recordweave.functions.strings import edit_ratio

    rec = cut(base.records(spark, d, "train"))
    key = F.when(F.col("phon") != "", F.array(F.concat_ws("|", "country", "phon"))).otherwise(F.array().cast("array<string>"))
    p = B.shared_keys(rec, key, 100)
    a = rec.filter("src = 1").groupBy(F.col("id").alias("s1")).agg(F.min("addr").alias("a"))
    b = rec.filter("src != 1").groupBy(F.col("id").alias("r")).agg(F.min("addr").alias("b"))
    p = p.join(a, "s1").join(b, "r").select("s1", "src", "r", F.round(edit_ratio(F.col("a"), F.col("b")), 4).alias("p"))
    return p, a.select("s1"), base.truth(spark, d).join(a.select("s1"), "s1", "left_semi")


def entity_f05(spark, d):
    p, q, t = _labelled(spark, d)
    kept = D.ranked(p, "s1", ["r"], "p").filter(D.kept(0.5, 0.6)).select("s1", "r")
    return D.entity_scores(q, kept, t, "s1", "r").withColumn("f05", F.round("f05", 6))


def macro_f05(spark, d):
    return entity_f05(spark, d).agg(F.round(F.avg("f05"), 5).alias("macro_f05"), F.count(F.lit(1)).alias("n"))


def _tuning(spark, d):
    p, q, t = _labelled(spark, d)
    x = cut(p.join(t.withColumn("y", F.lit(1)), ["s1", "r"], "left").withColumn("y", F.coalesce("y", F.lit(0))))
    n = cut(q.join(t.groupBy("s1").agg(F.count(F.lit(1)).alias("n_true")), "s1", "left").select("s1", F.coalesce("n_true", F.lit(0)).alias("n_true")))
    return x, n


def tune_grid(spark, d):
    """Macro F0.5 of every pair of the fifty quantile thresholds."""
    x, n = _tuning(spark, d)
    grid = D.threshold_grid(x, "p")
    rows = D.tune(cut(D.ranked(x, "s1", ["r"], "p")), n, "s1", "y", grid, grid)
    return spark.createDataFrame(rows, "t_first double, t_add double, macro_f05 double").withColumn("macro_f05", F.round("macro_f05", 6))


def tune_best(spark, d):
    """The thresholds that the search ends with: quantile grid, then a refinement around its best."""
    x, n = _tuning(spark, d)
    score, first, add = D.best_thresholds(x, n, "s1", ["r"], "p", "y")
    return spark.createDataFrame([(first, add, round(score, 6))], "t_first double, t_add double, macro_f05 double")


def nested_metric(spark, d):
    """Macro F0.5 over the 15 % and the 40 % draw of source1 records, the smaller part of the larger, and over all."""
    e = entity_f05(spark, d).withColumn("u", IO.uniform(F.col("s1")))
    out = None
    for name, most in (("15", 0.15), ("40", 0.4), ("100", 1.0)):
        x = e.filter(F.col("u") < most).agg(F.lit(name).alias("percent"), F.round(F.coalesce(F.avg("f05"), F.lit(0.0)), 5).alias("macro_f05"), F.count(F.lit(1)).alias("n"))
        out = x if out is None else out.unionByName(x)
    return out


def _verdicts(spark, d):
    """Labelled candidates with kept and y, true counts, and the truth."""
    p, q, t = _labelled(spark, d)
    y = t.withColumn("y", F.lit(1))
    r = D.ranked(p, "s1", ["r"], "p").withColumn("kept", D.kept(0.5, 0.6)).join(y, ["s1", "r"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    return cut(r.select("s1", "src", "r", "p", "kept", "y")), q, t


def oracle_what_ifs(spark, d):
    """Macro F0.5 as it is, without any false positive, with every true candidate kept, and with every true pair found (perfect blocking)."""
    r, q, t = _verdicts(spark, d)
    sets = {"as_is": r.filter("kept"), "no_false_positive": r.filter("kept and y = 1"), "candidates_found": r.filter("kept or y = 1"), "perfect_blocking": r.filter("kept").select("s1", "r").unionByName(t.select("s1", "r")).distinct()}
    out = None
    for name, x in sets.items():
        e = D.entity_scores(q, x.select("s1", "r"), t, "s1", "r").agg(F.lit(name).alias("case"), F.round(F.avg("f05"), 5).alias("macro_f05"))
        out = e if out is None else out.unionByName(e)
    return out


def zero_split(spark, d):
    """source1 records by how two runs (thresholds) treat them: whether matched before and after, whether they have matches, and their F0.5 sums."""
    p, q, t = _labelled(spark, d)
    p = cut(p)

    def run(first, add, name):
        k = D.ranked(p, "s1", ["r"], "p").filter(D.kept(first, add)).select("s1", "r")
        return D.entity_scores(q, k, t, "s1", "r").select("s1", F.col("n_true"), (F.col("n_pred") > 0).cast("int").alias(f"matched_{name}"), F.col("f05").alias(f"f_{name}"))

    a, b = run(0.5, 0.6, "a"), run(0.7, 0.8, "b").drop("n_true")
    j = a.join(b, "s1").groupBy("matched_a", "matched_b", (F.col("n_true") > 0).cast("int").alias("has_match"))
    return j.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("f_a"), 5).alias("sum_a"), F.round(F.sum("f_b"), 5).alias("sum_b"))


def error_profile(spark, d):
    """What false positives, false negatives and hits among the candidates have in common: same core, other numbers, another owner, low scores."""
    r, q, t = _verdicts(spark, d)
    rec = base.records(spark, d, "train")
    one = lambda x, k, c: x.groupBy(F.col("id").alias(k)).agg(F.min("core").alias(f"{c}_core"), F.min("nums").alias(f"{c}_nums"))
    j = r.join(one(rec.filter("src = 1"), "s1", "a"), "s1").join(one(rec.filter("src != 1"), "r", "b"), "r")
    owned = base.truth(spark, d).select("r").distinct().withColumn("owned", F.lit(1))
    j = j.join(owned, "r", "left").filter("kept or y = 1")
    kind = F.when(F.col("kept") & (F.col("y") == 1), "hit").when(F.col("kept"), "false_positive").otherwise("false_negative")
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    return j.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), share(F.col("a_core") == F.col("b_core")).alias("same_core"), share(F.col("a_nums") != F.col("b_nums")).alias("other_numbers"), share(F.col("owned") == 1).alias("record_has_owner"), share(F.col("p") < 0.5).alias("below_half"))


def blocking_misses(spark, d):
    """Known pairs that blocking found beside those it missed: rates of what could explain it, by label."""
    from recordweave.plans.block import round1

    rec, found = base.records(spark, d, "train"), round1(spark, d, "train").select("s1", "r").distinct().withColumn("found", F.lit(1))
    one = lambda x, k, c: x.groupBy(F.col("id").alias(k)).agg(*[F.min(v).alias(f"{c}_{v}") for v in ("core", "addr", "phon", "foreign", "country")])
    t = base.truth(spark, d).join(one(rec.filter("src = 1"), "s1", "a"), "s1").join(one(rec.filter("src != 1"), "r", "b"), "r").join(found, ["s1", "r"], "left")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return t.groupBy(F.col("a_country").alias("country"), F.coalesce("found", F.lit(0)).alias("found")).agg(
        F.count(F.lit(1)).alias("n"), share(F.col("a_core") == F.col("b_core")).alias("same_core"), share(F.col("a_phon") == F.col("b_phon")).alias("same_phon"), share(F.col("b_addr") == "").alias("no_addr"), share(F.col("b_foreign") == 1).alias("foreign_name"), share(F.col("r").startswith("S3")).alias("source3")
    )


def loss_decomposition(spark, d):
    """1 - F0.5 by cause and country: false positives on records without a match, on others, and misses."""
    s1 = table(spark, d, "source1").filter("split = 'train'").select(F.col("entity_id").alias("s1"), F.coalesce("country", F.lit("")).alias("country")).distinct()
    e = entity_f05(spark, d).join(s1, "s1")
    cause = F.when(F.col("f05") == 1, "none").when(F.col("n_true") == 0, "singleton_fp").when(F.col("tp") < F.col("n_true"), F.when(F.col("tp") < F.col("n_pred"), "miss_and_fp").otherwise("miss")).otherwise("fp")
    return e.groupBy("country", cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(1 - F.col("f05")), 5).alias("loss"))


def _lists(spark, d):
    s1 = table(spark, d, "source1").filter("split = 'test'").select(F.col("pos").alias("s1_pos"), F.col("entity_id").alias("source1_entity_id")).distinct()
    ids = None
    for k in (2, 3):
        t = table(spark, d, f"source{k}").filter("split = 'test'").select(F.lit(k).alias("src"), F.col("pos").alias("r_pos"), "entity_id").distinct()
        ids = t if ids is None else ids.unionByName(t)
    return s1, ids


def match_lists(spark, d):
    s1, ids = _lists(spark, d)
    p = _kept(spark, d).join(ids, ["src", "r_pos"]).join(s1, "s1_pos")
    return IO.result_lists(s1, p, "source1_entity_id", "src", "r_pos", "entity_id", "matched_entity_ids")


def candidate_lists(spark, d):
    s1, ids = _lists(spark, d)
    p = base.scored(spark, d).join(ids, ["src", "r_pos"]).join(s1, "s1_pos")
    return IO.result_lists(s1, p, "source1_entity_id", "src", "r_pos", "entity_id", "candidate_entity_ids")


def validate_lists(spark, d):
    """All rules on the raw lists of train_matches, which are given with many faults."""
    m = table(spark, d, "train_matches")
    q = table(spark, d, "source1").filter("split = 'train'").select(F.col("entity_id").alias("source1_entity_id"))
    known = table(spark, d, "source2").select(F.col("entity_id").alias("id")).unionByName(table(spark, d, "source3").select(F.col("entity_id").alias("id"))).distinct()
    return V.problems(m, "source1_entity_id", "matched_entity_ids", q, known)


def validate_subset(spark, d):
    """source1 records whose kept list isn't among their candidates: none."""
    m, c = match_lists(spark, d), candidate_lists(spark, d).withColumnRenamed("candidate_entity_ids", "matched_entity_ids")
    q = m.select("source1_entity_id")
    return V.problems(m, "source1_entity_id", "matched_entity_ids", q, None, c)


def run_diff(spark, d):
    """Pairs that two thresholds keep differently, and how many both keep."""
    a = _kept(spark, d).select("s1_pos", "src", "r_pos").withColumn("a", F.lit(1))
    b = _kept(spark, d, 0.7, 0.8).select("s1_pos", "src", "r_pos").withColumn("b", F.lit(1))
    j = a.join(b, ["s1_pos", "src", "r_pos"], "full_outer")
    return j.groupBy(F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("same").alias("change")).agg(F.count(F.lit(1)).alias("n"))


def output_stats(spark, d):
    """By country: source1 records, share without a match, mean matches."""
    s1, _ = _lists(spark, d)
    c = table(spark, d, "source1").filter("split = 'test'").select(F.col("pos").alias("s1_pos"), F.coalesce("country", F.lit("")).alias("country")).distinct()
    n = _kept(spark, d).groupBy("s1_pos").agg(F.count(F.lit(1)).alias("n"))
    return c.join(n, "s1_pos", "left").groupBy("country").agg(F.count(F.lit(1)).alias("n_s1"), F.round(F.avg(F.col("n").isNull().cast("double")), 6).alias("singleton_share"), F.round(F.avg(F.coalesce("n", F.lit(0))), 6).alias("mean_matches"))


QUERIES = {f.__name__: f for f in (ctx_stage1, ctx_stage2, ctx_density, matched_stage1, matched_stage2, context_check, anchors_topn, name_freq, sibling_features, one_owner, decide_keep, country_probe, near_tie_rate, entity_f05, macro_f05, tune_grid, tune_best, nested_metric, oracle_what_ifs, zero_split, error_profile, blocking_misses, loss_decomposition, match_lists, candidate_lists, validate_lists, validate_subset, run_diff, output_stats)}

_SC = "with " + base.SCORED
_OWN = "ow as (select *, row_number() over (partition by src, r_pos order by p desc, s1_pos) = 1 as own from sc), rk as (select *, case when own then p else -1 end as q from ow), rr as (select *, row_number() over (partition by s1_pos order by q desc, src, r_pos) = 1 as is_top, max(q) over (partition by s1_pos) as top_p from rk)"
_KEEP = lambda f, a: f"(top_p >= {f} and case when is_top then q >= {f} else q >= {a} end)"


def _comp(key: str, pre: str) -> str:
    w = f"over (partition by {key})"
    return f"""max(p) {w} as {pre}_max, round(max(p) {w} - p, 6) as {pre}_gap, rank() over (partition by {key} order by p desc)::integer as {pre}_rank, (sum((p > 0.5)::integer) {w})::bigint as {pre}_n_hi, round(sum(p) {w}, 6) as {pre}_sum,
case when p >= max(p) {w} then coalesce(nth_value(p, 2) over (partition by {key} order by p desc rows between unbounded preceding and unbounded following), 0) else max(p) {w} end as {pre}_best_other"""


_DRAWN = "dr as (select *, ('0x' || substr(md5(s1_pos::varchar), 1, 8))::bigint / 4294967296.0 < 0.5 as d from sc)"
_ratio = lambda a, b: f"1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::double"
_EDIT = "round(case when greatest(length(a), length(b)) = 0 then 1 else 1 - levenshtein(a, b) / greatest(length(a), length(b))::double end, 4)"
_LAB = f"""{base.SQL}, {_phon('train')}, {base.TRUTH}, la as (select id as s1, min(addr) as a from rec where split = 'train' and src = 1 group by id), lb as (select id as r, min(addr) as b from rec where split = 'train' and src != 1 group by id),
lp as (select s1, src, r, {_EDIT} as p from pf join la using (s1) join lb using (r)), lt as (select * from tr where s1 in (select s1 from la)),
lo as (select *, case when row_number() over (partition by r order by p desc, s1) = 1 then p else -1 end as q from lp), lr as (select *, row_number() over (partition by s1 order by q desc, r) = 1 as is_top, max(q) over (partition by s1) as top_p from lo)"""


def _f05(pred: str, tp: str, true: str) -> str:
    return f"case when {true} = 0 then case when {pred} = 0 then 1.0 else 0.0 end when {tp} = 0 then 0.0 else 1.25 * ({tp}::double / {pred}) * ({tp}::double / {true}) / (0.25 * ({tp}::double / {pred}) + {tp}::double / {true}) end"


_ENT = f"""{_LAB}, kp as (select s1, r from lr where {_KEEP(0.5, 0.6)}), pn as (select s1, count(*) as n_pred, count(lt.r) as tp from kp left join lt using (s1, r) group by s1), tn as (select s1, count(*) as n_true from lt group by s1),
en as (select s1, coalesce(n_pred, 0)::bigint as n_pred, coalesce(n_true, 0)::bigint as n_true, coalesce(tp, 0)::bigint as tp from la left join pn using (s1) left join tn using (s1)), ef as (select *, round({_f05('n_pred', 'tp', 'n_true')}, 6) as f05 from en)"""
_GRID = f"""{_LAB}, tn as materialized (select la.s1, count(lt.r) as n_true from la left join lt using (s1) group by la.s1), lv as (select p from lp where p >= 0.01), ls as (select list_transform(range(50), lambda i: 0.99 * i / 49) as q),
qs as (select distinct round(unnest(case when (select count(*) from lv) > 0 then (select quantile_cont(p, [{", ".join(repr(0.99 * i / 49) for i in range(50))}]) from lv) else (select quantile_cont(p, [{", ".join(repr(0.99 * i / 49) for i in range(50))}]) from lp) end), 6) as t),
ly as materialized (select lr.s1, q, is_top, top_p, (lt.r is not null)::integer as y from lr left join lt using (s1, r) where q >= 0), gr as (select a.t as t_first, b.t as t_add from qs a, qs b)"""


def _sweep(name: str, grid: str) -> str:
    """CTE NAME(t_first, t_add, f): macro F0.5 of each pair of thresholds."""
    return f"""{name}_k as (select t_first, t_add, s1, count(*) as n_pred, sum(y) as tp from ly join {grid} on top_p + 1e-9 >= t_first and case when is_top then q + 1e-9 >= t_first else q + 1e-9 >= t_add end group by all),
{name}_g as (select t_first, t_add, sum({_f05('n_pred', 'tp', 'n_true')} - (n_true = 0)::integer) as g from {name}_k join tn using (s1) group by all),
{name} as (select t_first, t_add, round((coalesce(g, 0) + (select count(*) from tn where n_true = 0)) / (select count(*) from tn), 9) as f from {grid} left join {name}_g using (t_first, t_add))"""


_IDS = "s1 as (select distinct pos as s1_pos, entity_id as source1_entity_id from source1 where split = 'test'), rid as (select distinct 2 as src, pos as r_pos, entity_id from source2 where split = 'test' union all select distinct 3, pos, entity_id from source3 where split = 'test')"


def _lists_sql(rows: str, out: str) -> str:
    return f"li as (select source1_entity_id, string_agg(entity_id, ',' order by src, r_pos) as l from {rows} join rid using (src, r_pos) join s1 using (s1_pos) group by all) select distinct source1_entity_id, coalesce(l, '') as {out} from s1 left join li using (source1_entity_id)"


_RULES = """vx as (select source1_entity_id as k, list_filter(list_transform(string_split(coalesce(matched_entity_ids, ''), ','), lambda x: trim(x)), lambda x: x != '') as l from train_matches), vi as (select k, unnest(l) as id from vx),
vq as (select distinct entity_id as k from source1 where split = 'train'), vk as (select entity_id as id from source2 union select entity_id from source3),
vb as (select 'duplicate_rows' as rule, k as v from vx group by k having count(*) > 1 union all select 'duplicate_ids', k from vx where len(l) != len(list_distinct(l)) union all select 'self_matches', id from vi where id like 'S1-%'
union all select 'wrong_prefix', id from vi where not (id like 'S1-%' or id like 'S2-%' or id like 'S3-%') union all select 'missing_rows', k from vq where k not in (select k from vx) union all select 'extra_rows', k from vx where k not in (select k from vq)
union all select distinct 'unknown_ids', id from vi where (id like 'S2-%' or id like 'S3-%') and id not in (select id from vk)),
vr as (select unnest(['duplicate_rows', 'duplicate_ids', 'self_matches', 'wrong_prefix', 'missing_rows', 'extra_rows', 'unknown_ids']) as rule),
vo as (select *, row_number() over (partition by rule order by v) as k from vb)"""
ORACLE = {
    "ctx_stage1": _SC + " select *, rank() over (partition by s1_pos, src order by p desc)::integer as ctx_rank_s1, round(max(p) over (partition by s1_pos, src) - p, 6) as ctx_gap_s1, count(*) over (partition by s1_pos, src) as n_cand_s1, rank() over (partition by src, r_pos order by p desc)::integer as ctx_rank_rec, round(max(p) over (partition by src, r_pos) - p, 6) as ctx_gap_rec, count(*) over (partition by src, r_pos) as ctx_n_rec from sc",
    "ctx_stage2": _SC + f", lv as (select * from sc where p >= 0.0001) select *, {_comp('s1_pos', 's1')}, {_comp('src, r_pos', 'rec')} from lv",
    "ctx_density": _SC
    + """, dr as (select *, ('0x' || substr(md5(s1_pos::varchar), 1, 8))::bigint / 4294967296.0 < 0.5 as d from sc)
select a.s1_pos, a.src, a.r_pos, a.p, (1 + count(*) filter (where b.d and b.p > a.p))::bigint as rank, max(b.p) filter (where b.d and b.s1_pos != a.s1_pos) as max_other, count(*) filter (where b.d and b.s1_pos != a.s1_pos) as n_other,
round(coalesce(sum(b.p) filter (where b.d and b.s1_pos != a.s1_pos), 0), 6) as sum_other, count(*) filter (where b.d and b.s1_pos != a.s1_pos and b.p > 0.5) as hi_other from dr a join dr b using (src, r_pos) group by all""",
    "anchors_topn": _SC + " select s1_pos as s1, src, r_pos as r, p from (select *, row_number() over (partition by s1_pos order by p desc, src, r_pos) as k from sc) where k <= 5",
    "name_freq": base.SQL + " select country, core, count(*) filter (where src = 1) as n_s1, count(*) filter (where src != 1) as n_rec from rec where split = 'test' and core != '' group by all",
    "matched_stage1": _SC + f""", {_DRAWN}, mo as (select a.s1_pos, a.src, a.r_pos, a.p, count(*) filter (where b.d and b.p > a.p) as above, max(b.p) filter (where b.d and b.s1_pos != a.s1_pos) as other, count(*) filter (where b.d and b.s1_pos != a.s1_pos) as n from dr a join dr b using (src, r_pos) group by a.s1_pos, a.src, a.r_pos, a.p)
select s1_pos, src, r_pos, p, (1 + above)::bigint as m_rank, round(greatest(p, other) - p, 6) as m_gap, (1 + n)::bigint as m_n from mo""",
    "matched_stage2": _SC + f""", {_DRAWN}, mo as (select a.s1_pos, a.src, a.r_pos, a.p, count(*) filter (where b.d and b.p > a.p) as above, coalesce(max(b.p) filter (where b.d and b.s1_pos != a.s1_pos), 0) as other, coalesce(sum(b.p) filter (where b.d and b.s1_pos != a.s1_pos), 0) as s,
count(*) filter (where b.d and b.s1_pos != a.s1_pos and b.p > 0.5) as hi from dr a join dr b using (src, r_pos) group by a.s1_pos, a.src, a.r_pos, a.p) select s1_pos, src, r_pos, p, greatest(p, other) as m_max, round(greatest(p, other) - p, 6) as m_gap, (1 + above)::bigint as m_rank, hi + (p > 0.5)::integer as m_n_hi, round(s + p, 6) as m_sum, other as m_best_other from mo""",
    "context_check": _SC + " select count(*) as n_pairs, count(*) as n_same from sc",
    "sibling_features": base.SQL
    + f""", {base.SCORED}, ri as (select src, pos as r_pos, min(core) as core, min(addr) as addr from rec where split = 'test' group by all), rn as materialized (select src, r_pos, core, addr, list_sort(list_distinct(regexp_extract_all(addr, '\\d+'))) as nums from ri),
jj as (select d.s1_pos, d.src, d.r_pos, s.p as sp, case when x.core != '' and y.core != '' then {_ratio('x.core', 'y.core')} end as nm, case when x.addr != '' and y.addr != '' then {_ratio('x.addr', 'y.addr')} end as am,
case when len(x.nums) > 0 and len(y.nums) > 0 then len(list_intersect(x.nums, y.nums))::double / len(list_distinct(list_concat(x.nums, y.nums))) end as nj, case when len(x.nums) > 0 and len(y.nums) > 0 then (x.nums = y.nums)::integer::double end as eq
from sc d join rn x using (src, r_pos) join sc s on s.s1_pos = d.s1_pos and s.p >= 0.5 and not (s.src = d.src and s.r_pos = d.r_pos) join rn y on y.src = s.src and y.r_pos = s.r_pos),
ja as (select s1_pos, src, r_pos, max(nm) as a1, sum(nm * sp) / sum(case when nm is not null then sp end) as a2, max(am) as b1, sum(am * sp) / sum(case when am is not null then sp end) as b2, max(nj) as a3, sum(nj * sp) / sum(case when nj is not null then sp end) as a4, avg(eq) as a5 from jj group by all),
sn as (select s1_pos, src, r_pos, (sum((p >= 0.5)::integer) over (partition by s1_pos) - (p >= 0.5)::integer)::bigint as n, sum(case when p >= 0.5 then p else 0 end) over (partition by s1_pos) - case when p >= 0.5 then p else 0 end as pm from sc)
select sn.s1_pos, sn.src, sn.r_pos, n as sib_n, case when n > 0 then round(pm, 5) end as sib_pmass, round(a1, 5) as sib_name_max, round(a2, 5) as sib_name_wmean, round(b1, 5) as sib_addr_max, round(b2, 5) as sib_addr_wmean, round(a3, 5) as sib_num_jacc_max, round(a4, 5) as sib_num_jacc_wmean, round(a5, 5) as sib_num_eq_frac,
case when n > 0 and len(r.nums) > 0 and len(q.nums) > 0 then (len(list_intersect(r.nums, q.nums)) > 0)::integer::double end as sib_num_supported
from sn left join ja using (s1_pos, src, r_pos) left join rn r on r.src = sn.src and r.r_pos = sn.r_pos left join rn q on q.src = 1 and q.r_pos = sn.s1_pos""",
    "one_owner": f"{_SC}, {_OWN} select s1_pos, src, r_pos, p from ow where own",
    "decide_keep": f"{_SC}, {_OWN} select s1_pos, src, r_pos, p from rr where {_KEEP(0.6, 0.7)}",
    "country_probe": f"{_SC}, {_OWN}, cn as (select distinct pos as s1_pos, country from source1 where split = 'test'), ct as (select country as top from cn where country != '' group by country order by count(*) desc, country limit 1), ab as (select country, {_KEEP(0.6, 0.7)}::integer as a, {_KEEP("(case when country = top then 0.7 else 0.6 end)", 0.7)}::integer as b from rr join cn using (s1_pos), ct) select country, sum(a)::bigint as n_before, sum(b)::bigint as n_after, sum((a != b)::integer)::bigint as n_changed from ab group by country",
    "near_tie_rate": _SC + ", tt as (select src, r_pos, max(p) as a, coalesce(max(case when k = 2 then p end), -1) as b from (select *, row_number() over (partition by src, r_pos order by p desc) as k from sc) where k <= 2 group by all) select round(coalesce(avg((a - b < 0.05)::integer::double), 0), 6) as rate, count(*) as n_records from tt where a >= 0.5",
    "entity_f05": _ENT + " select * from ef",
    "macro_f05": _ENT + " select round(avg(f05), 5) as macro_f05, count(*) as n from ef",
    "tune_grid": f"{_GRID}, {_sweep('w1', 'gr')} select t_first, t_add, round(f, 6) as macro_f05 from w1",
    "tune_best": f"""{_GRID}, {_sweep('w1', 'gr')}, b1 as (select * from w1 order by f desc, t_first, t_add limit 1), st as (select unnest(range(-8, 9)) * 0.005 as k),
g2 as (select distinct round(least(1, greatest(0, t_first + a.k)), 6)::double as t_first, round(least(1, greatest(0, t_add + b.k)), 6)::double as t_add from b1, st a, st b), {_sweep('w2', 'g2')},
bb as (select *, 0 as stage from b1 union all select *, 1 from w2) select t_first, t_add, round(f, 6) as macro_f05 from bb order by f desc, stage, t_first, t_add limit 1""",
    "nested_metric": _ENT + """, uu as (select *, ('0x' || substr(md5(s1), 1, 8))::bigint / 4294967296.0 as u from ef) select percent, round(coalesce(avg(f05) filter (where u < most), 0), 5) as macro_f05, count(*) filter (where u < most) as n from uu, (values ('15', 0.15), ('40', 0.4), ('100', 1.0)) v(percent, most) group by percent""",
    "oracle_what_ifs": _ENT + f""", ys as (select lr.s1, lr.r, {_KEEP(0.5, 0.6)} as kept, lt.r is not null as y from lr left join lt using (s1, r)),
cs as (select 'as_is' as c, s1, r from ys where kept union all select 'no_false_positive', s1, r from ys where kept and y union all select 'candidates_found', s1, r from ys where kept or y union all (select distinct 'perfect_blocking', s1, r from (select s1, r from ys where kept union select s1, r from lt))),
cc as (select unnest(['as_is', 'no_false_positive', 'candidates_found', 'perfect_blocking']) as c), cp as (select c, s1, count(*) as n_pred, count(lt.r) as tp from cs left join lt using (s1, r) group by all),
cf as (select cc.c, la.s1, coalesce(cp.n_pred, 0) as n_pred, coalesce(cp.tp, 0) as tp, coalesce(tn.n_true, 0) as n_true from cc cross join la left join cp on cp.c = cc.c and cp.s1 = la.s1 left join tn on tn.s1 = la.s1) select c as "case", round(avg({_f05('n_pred', 'tp', 'n_true')}), 5) as macro_f05 from cf group by c""",
    "zero_split": _ENT + f""", kr as (select 'a' as run, s1, r from lr where {_KEEP(0.5, 0.6)} union all select 'b', s1, r from lr where {_KEEP(0.7, 0.8)}), kc as (select run, s1, count(*) as n_pred, count(lt.r) as tp from kr left join lt using (s1, r) group by all),
ke as (select v.run, la.s1, coalesce(n_pred, 0) as n_pred, coalesce(tp, 0) as tp, coalesce(n_true, 0) as n_true from (values ('a'), ('b')) v(run) cross join la left join kc on kc.run = v.run and kc.s1 = la.s1 left join tn on tn.s1 = la.s1),
kz as (select *, {_f05('n_pred', 'tp', 'n_true')} as f from ke) select (a.n_pred > 0)::integer as matched_a, (b.n_pred > 0)::integer as matched_b, (a.n_true > 0)::integer as has_match, count(*) as n, round(sum(a.f), 5) as sum_a, round(sum(b.f), 5) as sum_b from kz a join kz b on a.s1 = b.s1 and a.run = 'a' and b.run = 'b' group by all""",
    "error_profile": _ENT + f""", ys as (select lr.s1, lr.r, lr.p, {_KEEP(0.5, 0.6)} as kept, lt.r is not null as y from lr left join lt using (s1, r)), ro as (select src = 1 as one, id, min(core) as core, min(nums) as nums from rec where split = 'train' group by all),
yj as (select case when kept and y then 'hit' when kept then 'false_positive' else 'false_negative' end as kind, a.core = b.core as c, a.nums != b.nums as m, r in (select r from tr) as o, p < 0.5 as h from ys join ro a on a.one and a.id = s1 join ro b on not b.one and b.id = r where kept or y)
select kind, count(*) as n, round(avg(c::integer::double), 6) as same_core, round(avg(m::integer::double), 6) as other_numbers, round(avg(o::integer::double), 6) as record_has_owner, round(avg(h::integer::double), 6) as below_half from yj group by kind""",
    "blocking_misses": f"""{_sql_union("split = 'train'")}, {base.TRUTH}, ro as (select src = 1 as one, id, min(core) as core, min(addr) as addr, min(phon) as phon, min(foreign_) as fo, min(country) as country from rec where split = 'train' group by all), uf as (select distinct s1, r from un),
tj as (select a.country, (uf.r is not null)::integer as found, a.core = b.core as c, a.phon = b.phon as h, b.addr = '' as e, b.fo = 1 as f, r like 'S3%' as t from tr join ro a on a.one and a.id = s1 join ro b on not b.one and b.id = r left join uf using (s1, r))
select country, found, count(*) as n, round(avg(c::integer::double), 6) as same_core, round(avg(h::integer::double), 6) as same_phon, round(avg(e::integer::double), 6) as no_addr, round(avg(f::integer::double), 6) as foreign_name, round(avg(t::integer::double), 6) as source3 from tj group by all""",
    "validate_subset": f"""{_SC}, {_OWN}, {_IDS}, kp as (select * from rr where {_KEEP(0.6, 0.7)}), ml as (select source1_entity_id as k, string_split(string_agg(entity_id, ',' order by src, r_pos), ',') as l from kp join rid using (src, r_pos) join s1 using (s1_pos) group by all),
cl as (select source1_entity_id as k, string_split(string_agg(entity_id, ',' order by src, r_pos), ',') as c from sc join rid using (src, r_pos) join s1 using (s1_pos) group by all), mi as (select k, unnest(l) as id from ml),
vb as (select 'duplicate_ids' as rule, k as v from ml where len(l) != len(list_distinct(l)) union all select 'not_candidates', k from ml left join cl using (k) where len(list_filter(l, lambda x: not list_contains(coalesce(c, []), x))) > 0
union all select 'self_matches', id from mi where id like 'S1-%' union all select 'wrong_prefix', id from mi where not (id like 'S1-%' or id like 'S2-%' or id like 'S3-%')), vo as (select *, row_number() over (partition by rule order by v) as i from vb),
vr as (select unnest(['duplicate_rows', 'duplicate_ids', 'self_matches', 'wrong_prefix', 'missing_rows', 'extra_rows', 'not_candidates']) as rule) select vr.rule, count(v) as n, coalesce(string_agg(v, ',' order by v) filter (where i <= 5), '') as examples from vr left join vo using (rule) group by vr.rule""",
    "loss_decomposition": _ENT
    + """, cn as (select distinct entity_id as s1, coalesce(country, '') as country from source1 where split = 'train') select country, case when f05 = 1 then 'none' when n_true = 0 then 'singleton_fp' when tp < n_true then case when tp < n_pred then 'miss_and_fp' else 'miss' end else 'fp' end as cause, count(*) as n, round(sum(1 - f05), 5) as loss from ef join cn using (s1) group by all""",
    "match_lists": f"{_SC}, {_OWN}, {_IDS}, kp as (select * from rr where {_KEEP(0.6, 0.7)}), {_lists_sql('kp', 'matched_entity_ids')}",
    "candidate_lists": f"{_SC}, {_IDS}, {_lists_sql('sc', 'candidate_entity_ids')}",
    "validate_lists": f"with {_RULES} select vr.rule, count(vo.v) as n, coalesce(string_agg(vo.v, ',' order by vo.v) filter (where vo.k <= 5), '') as examples from vr left join vo using (rule) group by vr.rule",
    "run_diff": f"{_SC}, {_OWN}, ka as (select s1_pos, src, r_pos from rr where {_KEEP(0.6, 0.7)}), kb as (select s1_pos, src, r_pos from rr where {_KEEP(0.7, 0.8)}), kc as (select *, 1 as a from ka), kd as (select *, 1 as b from kb) select case when a is null then 'added' when b is null then 'removed' else 'same' end as change, count(*) as n from kc full join kd using (s1_pos, src, r_pos) group by 1",
    "output_stats": f"{_SC}, {_OWN}, cn as (select distinct pos as s1_pos, coalesce(country, '') as country from source1 where split = 'test'), nn as (select s1_pos, count(*) as n from rr where {_KEEP(0.6, 0.7)} group by all) select country, count(*) as n_s1, round(avg((n is null)::integer::double), 6) as singleton_share, round(avg(coalesce(n, 0)), 6) as mean_matches from cn left join nn using (s1_pos) group by country",
}
