import math
import random

import pytest
from pyspark.sql import functions as F

from recordweave.operators import blocking as B
from recordweave.operators import context as C
from recordweave.operators import decide as D
from recordweave.operators import model as M
from recordweave.operators import tfidf
from recordweave.operators import validate as V
from recordweave.sources import files as IO


def records(spark, rows):
    return spark.createDataFrame(rows, "src int, id string, country string, core string, addr string, phon string")


def test_similarity_join_equals_brute_force_cosine(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(12)]
    rows = [(1 if i < 15 else 2, f"r{i:02d}", "", " ".join(r.choice(words) for _ in range(r.randint(0, 5))), "", "") for i in range(40)]
    df = records(spark, rows)
    found, back = B.run_pass(df.withColumn("country", F.lit("X")), B.Pass(F.col("core"), 0, 1.0, 3), 2)
    n = len(rows)
    docs = {x[1]: x[3].split() for x in rows}
    df_ = {w: sum(w in d for d in docs.values()) for w in words}
    vec = {}
    for k, d in docs.items():
        v = {w: (1 + math.log(d.count(w))) * (math.log((1 + n) / (1 + df_[w])) + 1) for w in set(d) if df_[w] >= 2}
        length = math.sqrt(sum(x * x for x in v.values()))
        vec[k] = {w: x / length for w, x in v.items()}
    sim = lambda a, b: round(sum(x * vec[b].get(w, 0) for w, x in vec[a].items()), 6)
    want = set()
    for a in [x[1] for x in rows[:15]]:
        best = sorted(((-sim(a, b), b) for b in [x[1] for x in rows[15:]] if sim(a, b) > 0))[:3]
        want |= {(a, b, i) for i, (_, b) in enumerate(best)}
    assert {(x.s1, x.r, x["rank"]) for x in found.collect()} == want
    assert back.count() > 0


@pytest.mark.parametrize("budget", [1, 6, 40, 10_000])
def test_nearest_is_exact_with_any_budget(spark, budget):
    r = random.Random(budget)
    words = [f"w{i}" for i in range(30)]
    vec = lambda: {w: r.random() + 0.05 for w in r.choices(words, weights=[1 / (i + 1) for i in range(30)], k=r.randint(1, 6))}
    unit = lambda v: {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()}
    q, t = ({i: unit(vec()) for i in range(n)} for n in (25, 120))
    rows = lambda vs: spark.createDataFrame([(i, w, "p" if i % 5 else "o", x) for i, v in vs.items() for w, x in v.items()], "key int, term string, pool string, w double")
    g = F.pmod("t", F.lit(2))
    s, whole = tfidf.nearest(rows(q).withColumnRenamed("key", "q"), rows(t).withColumnRenamed("key", "t"), "q", "t", "pool", 3, g, 2, budget)
    got = {(x.q, x.t, x["rank"]) for x in tfidf.top_k(s.withColumn("g", g), ["q", "g"], "t", 3).collect()}
    want = set()
    for a, v in q.items():
        for k in (0, 1):
            sims = [(-round(sum(x * u.get(w, 0) for w, x in v.items()), 6), b) for b, u in t.items() if b % 2 == k and bool(a % 5) == bool(b % 5)]
            want |= {(a, b, i) for i, (_, b) in enumerate(sorted(x for x in sims if x[0] < 0)[:3])}
    assert got == want and whole == (budget > 1000)


@pytest.mark.parametrize(("blocks", "dense"), [((10**6, 10**6), 10**6), ((10, 60), 10**6), ((20, 100), 3), ((10**6, 10**6), 8)])
def test_best_is_exact_with_any_blocks_and_keeps_no_table_of_pairs(spark, blocks, dense):
    r = random.Random(dense)
    words = [f"w{i}" for i in range(30)]
    vec = lambda: {w: r.random() + 0.05 for w in r.choices(words, weights=[1 / (i + 1) for i in range(30)], k=r.randint(1, 6))}
    unit = lambda v: {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()}
    q, t = ({i: unit(vec()) for i in range(n)} for n in (25, 120))
    t |= {i + 200: v for i, v in t.items()}  # ties
    rows = lambda vs, f: spark.createDataFrame([(*f(i), "p" if i % 5 else "o", list(v), list(v.values())) for i, v in vs.items()], f"{'q int' if len(f(0)) == 1 else 'g int, t int'}, pool string, terms array<string>, ws array<double>")
    s = tfidf.best(rows(q, lambda i: (i,)), rows(t, lambda i: (i % 2, i)), ["q"], ["g", "t"], "pool", 3, "g", blocks, dense)
    got = {(x.q, x.t, x["rank"]) for x in tfidf.top_k(s, ["q", "g"], "t", 3).collect()}
    want = set()
    for a, v in q.items():
        for k in (0, 1):
            sims = [(-round(sum(x * u.get(w, 0) for w, x in v.items()), 6), b) for b, u in t.items() if b % 2 == k and bool(a % 5) == bool(b % 5)]
            want |= {(a, b, i) for i, (_, b) in enumerate(sorted(x for x in sims if x[0] < 0)[:3])}
    assert got == want
    if min(blocks) == 10**6:
        assert s.count() <= 25 * 2 * 3


def test_blocks_meet_in_rounds_that_write_only_the_best(spark, monkeypatch):
    r = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    rows = [(1 if i < 25 else 2 + i % 2, f"r{i:03d}", "XYZ"[i % 3] if i % 7 else "", " ".join(r.choice(words) for _ in range(r.randint(1, 6))), "", "") for i in range(150)]
    df, spec = records(spark, rows), B.Pass(F.col("core"), 0, 1.0, 3)
    want = [{tuple(x) for x in y.collect()} for y in B.run_pass(df, spec, 2)]
    plain, real, written = tfidf.vectors, tfidf.best, []

    def small(*x):
        y = real(*x, blocks=(30, 50), at_once=200)
        written.append((x[2], [spark.read.parquet(f).count() for f in sorted({f.rsplit("/", 1)[0] for f in y.inputFiles()})]))
        return y

    monkeypatch.setattr(B, "best", small)
    monkeypatch.setattr(B, "vectors", lambda *x: plain(*x, most=100))
    assert [{tuple(x) for x in y.collect()} for y in B.run_pass(df, spec, 2)] == want
    n = sum(3 if not x[2] else 1 for x in rows if x[0] == 1)  # source1 records, once a pool
    assert all(len(w) > 3 for _, w in written) and max(written[0][1]) <= 2 * 3 * n


def test_records_without_any_country_meet(spark):
    df = records(spark, [(1, "a", "", "foo bar", "", ""), (2, "b", "", "foo bar", "", ""), (3, "c", "", "foo baz", "", "")])
    found, back = B.run_pass(df, B.Pass(F.col("core"), 0, 1.0, 5), 1)
    assert {(x.s1, x.r) for x in found.collect()} == {("a", "b"), ("a", "c")} == {(x.s1, x.r) for x in back.collect()}


def test_expansion_passes(spark):
    rows = [(1, f"a{i}", "X", f"foo{i % 3} bar{i}", "1 st", "") for i in range(6)] + [(2, "e", "X", "foo1 baz", "", ""), (3, "n", "X", "foo1 baz bar4", "2 st", ""), (2, "u", "", "foo1", "", "")]
    df = records(spark, rows)
    got = {(x.s1, x.r) for x in B.empty_address_pairs(df, 5, 1.0).collect()}
    assert got == {("a1", "e"), ("a4", "e")}
    near = {(x.r, x.r2) for x in B.neighbours(df, spark.createDataFrame([("s", 2, "e")], "s1 string, src int, r string"), 2, 1.0).collect()}
    assert near == {("e", "e"), ("e", "n")}


def test_records_without_country_meet_every_pool(spark):
    df = records(spark, [(1, "a", "X", "foo bar", "", ""), (2, "b", "", "foo bar", "", ""), (2, "c", "Y", "foo bar", "", ""), (1, "d", "", "foo bar", "", "")])
    found, _ = B.run_pass(df, B.Pass(F.col("core"), 0, 1.0, 5))
    assert {(x.s1, x.r) for x in found.collect()} == {("a", "b"), ("d", "b"), ("d", "c")}


def test_char_terms(spark):
    assert spark.range(1).select(tfidf.char_terms(F.lit("ab cdef"), 4)).first()[0] == [" ab ", " cde", "cdef", "def "]
    assert spark.range(1).select(tfidf.char_terms(F.lit("a"), 4)).first()[0] == [" a "]


def test_empty_pass(spark):
    found, _ = B.run_pass(records(spark, []), B.Pass(F.col("core"), 0, 1.0, 5))
    assert found.count() == 0


PAIRS = [("a", "x", 0.8), ("b", "x", 0.8), ("a", "y", 0.7), ("a", "z", 0.5), ("b", "w", 0.55)]


def test_owner_and_keep_rule(spark):
    df = spark.createDataFrame(PAIRS, "q string, r string, p double")
    assert {(x.q, x.r) for x in D.owned(df, "q", ["r"], "p").filter("is_owner").collect()} == {("a", "x"), ("a", "y"), ("a", "z"), ("b", "w")}
    r = D.ranked(df, "q", ["r"], "p")
    assert {(x.q, x.r) for x in r.filter(D.kept(0.6, 0.65)).collect()} == {("a", "x"), ("a", "y")}
    assert r.filter(D.kept(0.9, 0.4)).count() == 0
    few, many = ({tuple(x)[:2] for x in r.filter(D.kept(*t)).collect()} for t in ((0.6, 0.75), (0.5, 0.45)))
    assert few <= many
    assert D.ranked(df.limit(0), "q", ["r"], "p").filter(D.kept(0.1, 0.1)).count() == 0


def test_f05_examples(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "q string")
    pred = spark.createDataFrame([("a", "47"), ("a", "193"), ("a", "812"), ("c", "1")], "q string, r string")
    true = spark.createDataFrame([("a", "47"), ("a", "812"), ("d", "5")], "q string, r string")
    got = {x.q: round(x.f05, 3) for x in D.entity_scores(q, pred, true, "q", "r").collect()}
    assert got == {"a": 0.714, "b": 1.0, "c": 0.0, "d": 0.0}


def test_sampled_competition_with_all_drawn_is_plain(spark):
    r = random.Random(4)
    df = spark.createDataFrame([(i, r.randint(0, 9), r.choice([0.1, 0.4, 0.6, 0.9])) for i in range(80)], "q int, r int, p double")
    a = {(x.q, x.r): (x["rank"], x.hi_other) for x in C.sampled_competition(df.withColumn("d", F.lit(True)), "p", ["r"], "d").collect()}
    b = {(x.q, x.r): (x.c_rank, x.c_n_hi - (x.p > 0.5)) for x in C.competition(df, "p", ["r"], "c").collect()}
    assert a == b


def test_context_of_missing_scores(spark):
    df = spark.createDataFrame([("a", 2, "x", float("nan")), ("a", 2, "y", None), ("a", 2, "z", 0.5)], "q string, src int, r string, s double")
    got = {x.r: (x.ctx_rank_s1, x.ctx_gap_s1) for x in C.add_context(df, "s", ["q", "src"], ["src", "r"]).collect()}
    assert got == {"x": (2, 1.5), "y": (2, 1.5), "z": (1, 0.0)}


def test_validation_finds_each_fault(spark):
    lists = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", ""), ("S1-2", "S1-9,X-3,S3-7"), ("S1-8", None)], "k string, l string")
    queries = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "k string")
    known = spark.createDataFrame([("S2-1",)], "id string")
    report = V.problems(lists, "k", "l", queries, known)
    assert {x.rule: (x.n, x.examples) for x in report.collect()} == {
        "duplicate_rows": (1, "S1-1"), "duplicate_ids": (1, "S1-1"), "self_matches": (1, "S1-9"), "wrong_prefix": (1, "X-3"), "missing_rows": (1, "S1-3"), "extra_rows": (1, "S1-8"), "unknown_ids": (1, "S3-7"),
    }
    assert not V.passed(report)


def test_feature_store(spark, tmp_path):
    f = spark.createDataFrame([("a", 2, "x", 0.5), ("a", 3, "y", None), ("b", 2, "x", 0.25)], "s1 string, src int, r string, v double")
    kept = IO.store(f, str(tmp_path / "f"), ["src"])
    assert kept.columns == f.columns and set(kept.collect()) == set(f.collect()) == set(IO.store(f.limit(0), str(tmp_path / "f"), ["src"]).collect())
    keys = spark.createDataFrame([("a", 2, "x"), ("a", 2, "x"), ("z", 2, "x")], "s1 string, src int, r string")
    assert [tuple(x) for x in IO.lookup(kept, keys, ["s1", "src", "r"]).collect()] == [("a", 2, "x", 0.5)]
    with pytest.raises(ValueError):
        IO.store(f.drop("v"), str(tmp_path / "f"), ["src"])


def test_files_round_trip(spark, tmp_path):
    q = spark.createDataFrame([("S1-2",), ("S1-1",)], "k string")
    p = spark.createDataFrame([("S1-1", 3, 1, "S3-1"), ("S1-1", 2, 5, "S2-5"), ("S1-1", 2, 1, "S2-1")], "k string, src int, pos int, id string")
    lists = IO.result_lists(q, p, "k", "src", "pos", "id", "l")
    assert {tuple(x) for x in lists.collect()} == {("S1-1", "S2-1,S2-5,S3-1"), ("S1-2", "")}
    IO.write_lists(lists, "k", str(tmp_path / "out"))
    back = IO.read_tsv(spark, str(tmp_path / "out"), "k string, l string")
    assert {tuple(x) for x in back.collect()} == {("S1-1", "S2-1,S2-5,S3-1"), ("S1-2", "")}
    assert IO.split_list(back, "k", "l", "id").count() == 3
    (tmp_path / "raw.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"Foo" & Co\t\tUS\n')
    assert tuple(IO.read_tsv(spark, str(tmp_path / "raw.tsv")).first()) == ("S1-1", '"Foo" & Co', "", "US")
    assert V.header_fault(spark, str(tmp_path / "raw.tsv"), ["a", "b"]).startswith("the header is")
    assert V.malformed(spark, str(tmp_path / "raw.tsv"), 4).count() == 0
    assert IO.cached(q, str(tmp_path / "c")).count() == 2 == IO.cached(q.limit(0), str(tmp_path / "c")).count()


def test_uniform_is_portable_and_nested(spark):
    df = spark.createDataFrame([("S1-1",)], "k string").select((IO.uniform(F.col("k")) * (1 << 32)).cast("long"))
    assert df.first()[0] == 2591652941


def test_model_learns_and_folds_keep_groups(spark):
    r = random.Random(2)
    rows = [(f"s{i % 40}", float(y := r.randint(0, 1)), y * 0.5 + r.random() * 0.6, None if r.random() < 0.2 else r.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "s1 string, y double, a double, b double")
    scored, models = M.out_of_fold(df, ["a", "b"], "s1", 2, "p", trees=3, depth=2)
    assert scored.count() == 400 and len(models) == 2
    assert scored.groupBy("s1").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    means = {x.y: x.p for x in scored.groupBy("y").agg(F.avg("p").alias("p")).collect()}
    assert means[1.0] > means[0.0] + 0.2
    assert M.importance(models[0], ["a", "b"], df).first().feature == "a"


def test_threshold_search_against_brute_force(spark):
    r = random.Random(8)
    pairs = [(f"q{r.randint(0, 14)}", f"r{i}", round(r.random(), 3), float(r.random() < 0.4)) for i in range(150)]
    df = spark.createDataFrame(pairs, "q string, r string, p double, y double")
    true = {f"q{i}": sum(y for q, _, _, y in pairs if q == f"q{i}") + (i % 4 == 0) for i in range(17)}
    n = spark.createDataFrame([(q, int(k)) for q, k in true.items()], "q string, n_true long")

    def macro(first, add):
        total = 0.0
        for q, k in true.items():
            mine = sorted((x for x in pairs if x[0] == q), key=lambda x: (-x[2], x[1]))
            kept = [x for i, x in enumerate(mine) if mine[0][2] >= first - 1e-9 and x[2] >= (add if i else first) - 1e-9]
            tp = sum(x[3] for x in kept)
            p, c = (tp / len(kept), tp / k) if kept and k else (0, 0)
            total += float(not kept) if not k else 1.25 * p * c / (0.25 * p + c) if tp else 0.0
        return total / len(true)

    grid = D.threshold_grid(df, "p", 8)
    ranked = D.ranked(df, "q", ["r"], "p")
    assert len(grid) == 8 and all(f == pytest.approx(macro(a, b), abs=1e-8) for a, b, f in D.tune(ranked, n, "q", "y", grid, grid))
    score, first, add = D.best_thresholds(df, n, "q", ["r"], "p", "y", 8)
    assert score == pytest.approx(macro(first, add), abs=1e-8) and score >= max(macro(a, b) for a in grid for b in grid) - 1e-9
    assert D.tune(ranked.limit(0), n, "q", "y", [0.5], [0.5])[0][2] == pytest.approx(sum(k == 0 for k in true.values()) / len(true))


def test_models_are_saved_and_score_live_rows_only(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"q{i % 40}", float(i % 2), i % 2 + r.random() * 0.8, r.random(), 0.3) for i in range(300)]
    df = spark.createDataFrame(rows, "s1 string, y double, a double, b double, p1 double")
    scored, models = M.out_of_fold(df, ["a", "b"], "s1", 3, "p", F.col("b") > 0.2, trees=4, depth=2)
    assert scored.count() == 300 and scored.filter("p is null").count() == 0
    m = M.refit(df, ["a", "b"], models, trees=4, depth=2)
    assert m.getNumTrees == round(sum(x.getNumTrees for x in models) / 3)
    M.save(m, ["a", "b"], str(tmp_path / "m"))
    again, names = M.load(str(tmp_path / "m"))
    one = lambda model: {(x.s1, x.a): x.p2 for x in M.score_live(df, model, names, F.col("a") > 1, "p1", "p2").collect()}
    assert names == ["a", "b"] and one(m) == one(again) and all((p == 0.3) for (_, a), p in one(m).items() if a <= 1)
    assert M.by_fold(scored.drop("p"), models, names).count() == 300


def test_sibling_counts(spark):
    pairs = spark.createDataFrame([("q", f"r{i}", 0.9 - i / 100) for i in range(30)] + [("q", "low", 0.1)], "q string, r string, p double")
    rec = spark.createDataFrame([(f"r{i}", f"core {i % 3}", "", ["1"]) for i in range(30)] + [("low", "", "", [])], "r string, core string, addr string, nums array<string>")
    got = {x.r: x for x in C.siblings(pairs, rec, "q", "r", "p").collect()}
    assert got["r0"].sib_n == 29 and got["low"].sib_n == 30 and got["r0"].sib_name_max == 1 and got["low"].sib_name_max is None
    assert got["r0"].sib_num_eq_frac == pytest.approx(1)


def test_sibling_agreement_takes_every_sibling(spark):
    r = random.Random(4)
    rec = {f"r{i}": (r.choice(["", *(f"core {r.choice('abc')}{k}" for k in range(9))]), r.sample(["1", "2", "3"], r.randint(0, 3))) for i in range(70)}
    rec["r65"] = rec["far"] = ("nothing like it", ["77"])
    prob = {f"r{i}": round(0.98 - i / 150, 4) for i in range(70)} | {"far": 0.2}
    pairs = spark.createDataFrame([("q", k, v) for k, v in prob.items()], "q string, r string, p double")
    got = {x.r: x for x in C.siblings(pairs, spark.createDataFrame([(k, v[0], v[0][::-1], v[1]) for k, v in rec.items()], "r string, core string, addr string, nums array<string>"), "q", "r", "p", block=4, queries=spark.createDataFrame([("q", ["1", "77"])], "q string, nums array<string>")).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, up = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(up[j] + 1, row[-1] + 1, up[j - 1] + (x != y)))
        return row[-1]

    assert got["far"].sib_name_max == 1 and got["far"].sib_num_jacc_max == 1  # r65 is the 66th best
    for k, (core, nums) in rec.items():
        sibs = [(prob[o], *rec[o]) for o in rec if o != k and prob[o] >= 0.5]
        names = [(p, 1 - lev(core, c) / max(len(core), len(c))) for p, c, _ in sibs if core and c]
        sets = [(p, len({*nums} & {*m}) / len({*nums} | {*m}), {*nums} == {*m}) for p, _, m in sibs if nums and m]
        mean = lambda v: sum(x[0] * x[1] for x in v) / sum(x[0] for x in v) if v else None
        want = [max((x[1] for x in names), default=None), mean(names), max((x[1] for x in sets), default=None), mean(sets), sum(x[2] for x in sets) / len(sets) if sets else None]
        assert [got[k].sib_name_max, got[k].sib_name_wmean, got[k].sib_num_jacc_max, got[k].sib_num_jacc_wmean, got[k].sib_num_eq_frac] == pytest.approx(want)
        assert [got[k].sib_addr_max, got[k].sib_addr_wmean] == pytest.approx(want[:2]) and got[k].sib_num_supported == (float(bool({*nums} & {"1", "77"})) if nums else None)
        assert got[k].sib_n == len(sibs)


def test_shift_holds_out_every_label(spark):
    rows = [(f"L{i % 7}", float(i // 7 % 2), (i // 7 % 2) * 0.5 + i % 5 / 10) for i in range(84)] + [("one", 1.0, 0.4)]
    got = {x.held_out: (x.n, x.auc) for x in M.shift(spark.createDataFrame(rows, "country string, y double, a double"), ["a"], "country", trees=1, depth=1)[0].collect()}
    assert {k: n for k, (n, _) in got.items()} == {**{f"L{i}": 12 for i in range(7)}, "one": 1}
    assert got["one"][1] is None and all(got[f"L{i}"][1] > 0.5 for i in range(7))


def test_word_features_know_every_word(spark, monkeypatch):
    from recordweave.plans import features as W

    cores = [(1, "a", "smith sons"), (2, "b", "smiht sons"), (2, "c", "smith sons"), *((3, f"x{i}", "sons trading") for i in range(20))]
    rec = spark.createDataFrame([(*x, *[""] * 7) for x in cores], "src int, id string, core string, name string, variants string, addr string, postal string, nums string, phon string, country string")
    given = spark.createDataFrame([("a", 2, "b"), ("a", 2, "c")], "s1 string, src int, r string")
    monkeypatch.setattr(W.base, "records", lambda *_: rec)
    monkeypatch.setattr(W.B, "rarest_token", lambda *_: given)
    idf = lambda df: math.log(24 / (1 + df)) + 1
    sons, smith, smiht = idf(23), idf(2), idf(1)
    cos = {x.r: x.name_word_tfidf for x in W.feat_tfidf_cosine(spark, "").collect()}
    assert cos["c"] == 1 and cos["b"] == pytest.approx(sons**2 / math.hypot(sons, smith) / math.hypot(sons, smiht), abs=1e-6)
    assert {x.r: x.name_wjacc for x in W.feat_weighted_jaccard(spark, "").collect()} == pytest.approx({"b": sons / (sons + smith + smiht), "c": 1}, abs=1e-6)
    cov = {x.r: x for x in W.feat_coverage(spark, "").collect()}
    assert cov["c"].a_cov == 1 and cov["b"].a_cov == pytest.approx(1 if cov["b"].a_n_miss == 0 else sons / (sons + smith)) and cov["b"].b_miss == pytest.approx(0 if cov["b"].b_n_miss == 0 else smiht)
    plain = spark.createDataFrame([("sons alpha", {"sons": 1.0, "alpha": 3.0}, "sons omega", {"sons": 1.0, "omega": 5.0})], "a string, u map<string,double>, b string, v map<string,double>")
    side = lambda t, o, w: W.S.covered(F.split(t, " "), W.S.near_tokens(F.split(t, " "), F.split(o, " ")), F.col(w))
    assert tuple(plain.select(*side("a", "b", "u"), *side("b", "a", "v")).first()) == (0.25, 3.0, 1.0, pytest.approx(1 / 6), 5.0, 1.0)

