"""How much is done, and how far apart: passes that are run, tasks that pairs are joined in, folds that are fitted at once."""

from __future__ import annotations

import random
from threading import Barrier

from pyspark.sql import functions as F

from recordweave.functions import strings as S
from recordweave.operators import context as C
from recordweave.operators import model as M
from recordweave.operators import pairs as P
from recordweave.operators import tfidf
from recordweave.plans import base, block
from recordweave.runtime import parallelism

RECORDS = [(1, "a", "X", "smith sons", "1 main st"), (2, "b", "X", "smith sons", "1 main st"), (2, "c", "X", "smith sons ltd", "1 main st"), (3, "d", "X", "jones", "2 high st"), (1, "e", "X", "jones", "2 high st")]


def _records(spark):
    return spark.createDataFrame(RECORDS, "src int, id string, country string, core string, addr string").withColumn("phon", F.col("core"))


def test_sibling_queries_run_only_the_pass_they_read(spark, monkeypatch):
    run, ran = block.B.run_pass, []
    monkeypatch.setattr(base, "records", lambda *_: _records(spark))
    monkeypatch.setattr(base, "truth", lambda *_: spark.createDataFrame([("a", "b")], "s1 string, r string"))
    monkeypatch.setattr(block, "once", lambda _s, _n, _i, make: make())
    monkeypatch.setattr(block.B, "passes", lambda p=block.B.passes(): {n: x._replace(max_df=1.0) for n, x in p.items()})
    monkeypatch.setattr(block.B, "run_pass", lambda r, spec, k=0: ran.append((spec.chars, spec.k)) or run(r, spec, k))
    wanted = {tuple(x) for x in block.round1(spark, "", "test").filter("rank_na < 255").select("s1", "src", "r", "rank_na", "sim_na").collect()}
    ran.clear()
    assert {tuple(x) for x in block._found(spark, "", "test").collect()} == wanted
    block.pass_sibling(spark, "")
    block.sibling_variants(spark, "")
    assert ran == [(0, 10)] * 3


def test_pairs_are_joined_in_tasks_for_every_core(spark):
    rec = _records(spark)
    pairs = spark.createDataFrame([("a", 2, "b"), ("e", 3, "d")], "s1 string, src int, r string")
    j = P.joined(pairs, rec, ["core"])
    assert {(x.s1, x.r, x.l_core, x.r_core) for x in j.collect()} == {("a", "b", "smith sons", "smith sons"), ("e", "d", "jones", "jones")}
    assert j.rdd.getNumPartitions() >= parallelism(spark)


def test_folds_are_fitted_at_once(spark, monkeypatch):
    met, fit = Barrier(3, timeout=60), M.classifier

    class Meeting:
        def __init__(self, inner):
            self.inner = inner

        def fit(self, x):
            met.wait()
            return self.inner.fit(x)

    monkeypatch.setattr(M, "classifier", lambda **kw: Meeting(fit(**kw)))
    rows = spark.createDataFrame([(f"g{i % 40}", float(i % 7), float(i % 7 > 3)) for i in range(400)], "g string, v double, y double")
    p, models = M.out_of_fold(rows, ["v"], "g", 3, trees=2, depth=2)
    assert len(models) == 3 and p.count() == 400
    held = [sorted({x.g for x in p.filter(F.col("fold") == k).select("g").distinct().collect()}) for k in range(3)]
    assert sum(map(len, held)) == 40


def test_edit_ratios_by_bits_equal_the_plain_ones(spark):
    draw = random.Random(5)
    text = lambda most: "".join(draw.choice("aab \u00e9\U0001f600") for _ in range(draw.randint(0, most)))
    rows = [(text(m), text(m)) for m in (3, 12, 64, 66, 90) for _ in range(120)] + [("a" * 64, "b" * 64), ("a" * 65, "a" * 66), ("", ""), ("", "abc"), (None, "a"), (None, None)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.edit_ratio_by_bits(F.col("a"), F.col("b")).alias("x"), S.edit_ratio(F.col("a"), F.col("b")).alias("y")).collect()
    assert len(got) == len(rows) and all(r.x == r.y for r in got)


def test_siblings_are_compared_by_batches(spark, capsys):
    pairs = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.8), (1, "c", 0.7)], "q int, rec string, p double")
    rec = spark.createDataFrame([("a", "smith", "1 main st", ["1"]), ("b", "smyth", "1 main st", ["1"]), ("c", "jones", "2 high st", ["2"])], "rec string, core string, addr string, nums array<string>")
    s = C.siblings(pairs, rec, "q", "rec", "p")
    got = {r.rec: (r.sib_name_max, r.sib_addr_max) for r in s.collect()}
    assert got["a"] == (0.8, 1.0) and got["b"] == (0.8, 1.0)
    s.explain()
    assert "ArrowEval" in capsys.readouterr().out


def test_vectors_keep_texts_not_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a", "", "oak hill oak"), (1, "b", "", "oak hill"), (2, "c", "", "hill elm"), (2, "c", "X", "oak")], "src int, id string, country string, core string")
    cut, kept = tfidf.cut, []
    monkeypatch.setattr(tfidf, "cut", lambda df: kept.append(df.columns) or cut(df))
    plain = {(x.src, x.id): x for x in tfidf.vectors(docs, ["src", "id"], F.col("core"), tfidf.word_terms, "country", 4, 2, 1.0).collect()}
    assert "x" in kept[0] and not any("t" in c for c in kept)
    parted = {(x.src, x.id): x for x in tfidf.vectors(docs, ["src", "id"], F.col("core"), tfidf.word_terms, "country", 4, 2, 1.0, most=2).collect()}
    look = lambda v: {k: (sorted(x.labels), sorted(round(r, 9) for r in x.rs), round(x.norm, 9)) for k, x in v.items()}
    assert look(plain) == look(parted) and set(plain) == {(1, "a"), (1, "b"), (2, "c")}
    assert sorted(plain[2, "c"].labels) == ["", "X"] and len(plain[1, "a"].terms) == 2
