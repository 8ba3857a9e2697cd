"""The stack's queries on a few made-up pairs: what models learn from, and which context they see."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from recordweave.operators import model as M
from recordweave.operators.pairs import STAGE1
from recordweave.plans import models as Q


def _pairs(df):
    """df with the features of STAGE1 that it lacks, as nulls."""
    return df.select("*", *[F.lit(None).cast("double").alias(c) for c in STAGE1 if c not in df.columns])


def test_models_and_thresholds_of_the_shift_check_see_every_pair(spark, monkeypatch):
    fitted, fit = [], M.classifier

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def fit(self, x):
            fitted.append(x.count())
            return self.inner.fit(x)

    rows = [(f"q{i % 12:02d}", 2, f"r{i}", float(i % 5 == 0), 9, 9, i % 7 / 7) for i in range(120)]
    rows = _pairs(spark.createDataFrame(rows, "s1 string, src int, r string, y double, ctx_rank_s1 int, ctx_rank_rec int, base double"))
    rec = spark.createDataFrame([(1, f"q{i:02d}", "A" if i < 8 else "B") for i in range(12)], "src int, id string, country string")
    monkeypatch.setattr(M, "classifier", lambda **kw: Counting(fit(**kw)))
    monkeypatch.setattr(Q, "memo", lambda _s, _n, _i, make: make())
    monkeypatch.setattr(Q, "first_rows", lambda *_: rows)
    monkeypatch.setattr(Q.base, "records", lambda *_: rec)
    monkeypatch.setattr(Q, "_true_counts", lambda *_: rows.groupBy("s1").agg(F.sum("y").cast("long").alias("n_true")))
    monkeypatch.setattr(Q, "second_stage", lambda *_: (None, None, None, (1.0, 0.5, 0.5)))
    assert Q.first_stage(spark, "")[0].count() == 120 and fitted == [120] * (Q.FOLDS + 1)  # a fold's own rows are those it stops on
    fitted.clear()
    got = {x.held_out: x.n for x in Q.shift_check(spark, "").collect()}
    assert got == {"A": 80, "B": 40} and fitted == [40, 80]


@pytest.mark.parametrize("all_drawn", [False, True])
def test_density_match_scores_both_stages_anew(spark, monkeypatch, all_drawn):
    monkeypatch.setattr(M, "predict", lambda model, df, out="p": df.withColumn(out, F.expr(model)))
    monkeypatch.setattr(Q.IO, "uniform", lambda key: F.when(key == "b", 0.0 if all_drawn else 0.9).otherwise(0.1))
    first, second = "base / ctx_n_rec", "p1_rec_sum + sib_n"
    pairs = [("a", "x", 1.2, 0, 3), ("b", "x", 0.8, 0, 3), ("c", "x", 0.5, 0, 3), ("a", "y", 0.7, 0, 1), ("b", "y", 0.6, 1, 2), ("a", "w", 0.015, 0, 2), ("b", "w", 0.001, 0, 2)]
    rows = [(s, 2, r, p, float(two), float(n), p / n) for s, r, p, two, n in pairs]
    u = _pairs(spark.createDataFrame(rows, "s1 string, src int, r string, base double, is_round2 double, ctx_n_rec double, p1 double"))
    rec = [(1, s, "X", f"core {s}", "", "") for s in "abc"] + [(2, r, "X", f"core {r}", "", "") for r in "xyw"]
    rec = spark.createDataFrame(rec, "src int, id string, country string, core string, addr string, nums string")
    plain = Q.K.stage2_rows(*[u.filter(F.col("is_round2") == k).drop("is_round2") for k in (0, 1)], rec)
    monkeypatch.setattr(Q.base, "records", lambda *_: rec)
    monkeypatch.setattr(Q, "first_stage", lambda *_: (None, None, first))
    monkeypatch.setattr(Q, "second_stage", lambda *_: (None, None, second, None))
    monkeypatch.setattr(Q, "second_rows", lambda *_: plain)
    got = {(x.s1, x.r): (x.p, x.p_matched) for x in Q.density_match(spark, "").collect()}
    assert len(got) == len(pairs)
    if all_drawn:
        assert all(p == pytest.approx(m) for p, m in got.values())
    else:  # a and c compete, b doesn't: a's pair of x becomes a sibling, and that of w live
        want = {("a", "x"): 0.6 + 0.25 + 1, ("b", "x"): 0.8 / 3 + 0.6 + 0.25, ("c", "x"): 0.25 + 0.6, ("a", "y"): 0.7 + 1, ("b", "y"): 0.3 + 0.7, ("a", "w"): 0.015 + 2, ("b", "w"): 0.0005}
        assert {k: m for k, (_, m) in got.items()} == pytest.approx(want)
        assert got["a", "w"][0] == pytest.approx(0.0075) and got["a", "x"][0] == pytest.approx(0.4 + 0.8 / 3 + 0.5 / 3 + 1)
