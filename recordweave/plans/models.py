"""Queries: the two-stage stack, from candidates to result lists. Results depend on the training, so they have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordweave.operators import context as C
from recordweave.operators import decide as D
from recordweave.operators import model as M
from recordweave.operators import stack as K
from recordweave.operators.pairs import KEY, STAGE1, stage1_features
from recordweave.plans import base
from recordweave.plans.block import round1
from recordweave.runtime import cut, memo, once
from recordweave.sources import files as IO

KW = {"trees": 12, "depth": 4}
FOLDS = 3


def _inputs(d):
    return [f"{d}/{t}.parquet" for t in ("source1", "source2", "source3", "train_matches")]


def _labelled(pairs, spark, d):
    y = base.truth(spark, d).withColumn("y", F.lit(1.0))
    return pairs.join(y, ["s1", "r"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))


def first_rows(spark, d, split):
    """Candidates of round 1 with all first-stage features, of the train split with y."""

    def make():
        f = stage1_features(round1(spark, d, split), base.records(spark, d, split))
        return _labelled(f, spark, d) if split == "train" else f

    return once(spark, f"first rows {split}", _inputs(d), make)


def first_stage(spark, d):
    """(train rows with fold and out-of-fold p1, fold models, the model of all). All rows are learned from."""

    def make():
        rows = first_rows(spark, d, "train")
        p, models = M.out_of_fold(rows, STAGE1, "s1", FOLDS, "p1", **KW)
        return cut(p), models, M.refit(rows, STAGE1, models, **KW)

    return memo(spark, "first stage", _inputs(d), make)


def second_rows(spark, d, split):
    """(all pairs of both rounds, the live ones with all second-stage features)."""

    def make():
        scored, models, model = first_stage(spark, d)
        rec = base.records(spark, d, split)
        if split == "test":
            scored = cut(M.predict(model, M.assembled(first_rows(spark, d, "test"), STAGE1), "p1").drop("features"))
        new = cut(K.expanded(rec, scored))
        f = K.round2_features(new, rec, scored)
        if split == "test":
            second = M.predict(model, M.assembled(f, STAGE1), "p1").drop("features")
        else:
            second = M.by_fold(_labelled(f, spark, d).withColumn("fold", M.fold(F.col("s1"), FOLDS)), models, STAGE1, "p1")
        return K.stage2_rows(scored, cut(second), rec)

    return memo(spark, f"second rows {split}", _inputs(d), make)


def second_stage(spark, d):
    """(all train pairs with p: second-stage out of fold where live, else p1; fold models; the model of all; (score, t_first, t_add))."""

    def make():
        u, rows = second_rows(spark, d, "train")
        p, models = M.out_of_fold(rows.drop("fold"), K.STAGE2, "s1", FOLDS, "p2", **KW)
        all_ = cut(u.select(*KEY, "y", "p1", "is_round2").join(p.select(*KEY, "p2"), KEY, "left").withColumn("p", F.coalesce("p2", "p1")))
        return all_, models, M.refit(rows, K.STAGE2, models, **KW), D.best_thresholds(all_, _true_counts(spark, d), "s1", ["src", "r"], "p", "y")

    return memo(spark, "second stage", _inputs(d), make)


def _true_counts(spark, d):
    s1 = base.records(spark, d, "train").filter("src = 1").select(F.col("id").alias("s1")).distinct()
    n = base.truth(spark, d).groupBy("s1").agg(F.count(F.lit(1)).alias("n_true"))
    return cut(s1.join(n, "s1", "left").select("s1", F.coalesce("n_true", F.lit(0)).alias("n_true")))


def gbt_stage1(spark, d):
    """Out-of-fold first-stage probabilities of the train candidates."""
    return first_stage(spark, d)[0].select(*KEY, "y", "fold", "p1")


def gbt_round2(spark, d):
    """New pairs of round 2 of the train split, scored by the model that left their fold out."""
    return second_rows(spark, d, "train")[0].filter("is_round2 = 1").select(*KEY, "y", "p1")


def gbt_stage2(spark, d):
    """Second-stage probabilities of all train pairs of both rounds; pairs that aren't live keep the first stage's."""
    return second_stage(spark, d)[0].select(*KEY, "y", "is_round2", "p1", "p")


def gbt_features(spark, d):
    """The second-stage feature rows of live train pairs."""
    return second_rows(spark, d, "train")[1].select(*KEY, "y", *K.STAGE2)


def stage_scores(spark, d):
    """Macro F0.5 of each stage with its own thresholds: the first, both rounds with the first stage's scores, and the second."""
    n = _true_counts(spark, d)
    first, (all_, _, _, best) = first_stage(spark, d)[0], second_stage(spark, d)
    rows = [("stage1", *D.best_thresholds(first, n, "s1", ["src", "r"], "p1", "y")), ("round2", *D.best_thresholds(all_, n, "s1", ["src", "r"], "p1", "y")), ("stage2", *best)]
    return spark.createDataFrame(rows, "stage string, macro_f05 double, t_first double, t_add double")


def gbt_blend(spark, d):
    """The mean of both stages' probabilities of live train pairs."""
    x = second_stage(spark, d)[0].filter("p2 is not null")
    return M.blend(x.select(*KEY, F.col("p1").alias("p")), x.select(*KEY, "p"), KEY)


def gbt_importance(spark, d):
    """The features that the second stage gains most by."""
    return M.importance(second_stage(spark, d)[2], K.STAGE2, second_rows(spark, d, "train")[1])


def _final(model, u, rows):
    """All pairs u with p: second-stage where live, else first-stage."""
    p = M.predict(model, M.assembled(rows, K.STAGE2), "p2").select(*KEY, "p2")
    return cut(u.select(*KEY, "p1").join(p, KEY, "left").withColumn("p", F.coalesce("p2", "p1")))


def test_scores(spark, d):
    """Test pairs of both rounds with p: second-stage where live, else first-stage."""
    return _final(second_stage(spark, d)[2], *second_rows(spark, d, "test"))


def gbt_predict_test(spark, d):
    """Test scores, decided under the thresholds found on train."""
    _, first, add = second_stage(spark, d)[3]
    return D.ranked(test_scores(spark, d), "s1", ["src", "r"], "p").filter(D.kept(first, add)).select(*KEY, "p")


def gbt_result_lists(spark, d):
    """The result: one row per source1 record of the test split, with the list of its records."""
    rec = base.records(spark, d, "test")
    s1 = rec.filter("src = 1").select(F.col("id").alias("source1_entity_id")).distinct()
    at = rec.filter("src != 1").groupBy("src", F.col("id").alias("r")).agg(F.min("pos").alias("pos"))
    kept = gbt_predict_test(spark, d).join(at, ["src", "r"]).withColumnRenamed("s1", "source1_entity_id")
    return IO.result_lists(s1, kept, "source1_entity_id", "src", "pos", "r", "matched_entity_ids")


def shift_check(spark, d):
    """Each label held out: AUC, and macro F0.5 with thresholds of its own and with those found on all; of all its candidates, by a model of all others'."""
    rec = base.records(spark, d, "train").filter("src = 1").groupBy(F.col("id").alias("s1")).agg(F.min("country").alias("country"))
    x = cut(first_rows(spark, d, "train").join(rec, "s1"))
    report, scored = M.shift(x, STAGE1, "country", trees=10, depth=3)
    _, first, add = second_stage(spark, d)[3]
    n, out = _true_counts(spark, d).join(rec, "s1"), []
    scored = None if scored is None else cut(scored.select(*KEY, "country", "y", "p"))
    for r in report.collect():
        own = fixed = None
        if r.auc is not None:
            mine, true = scored.filter(F.col("country") == r.held_out), n.filter(F.col("country") == r.held_out)
            own = D.best_thresholds(mine, true, "s1", ["src", "r"], "p", "y", 12)[0]
            fixed = D.tune(D.ranked(mine, "s1", ["src", "r"], "p"), true, "s1", "y", [first], [add])[0][2]
        out.append((r.held_out, r.n, r.auc, own, fixed))
    return spark.createDataFrame(out, "held_out string, n long, auc double, own_thresholds double, main_thresholds double")


def adversarial_auc(spark, d):
    """How well train and test pairs can be told apart by their features: AUC of each fold."""
    x = first_rows(spark, d, "train").select(*KEY, *STAGE1).withColumn("y", F.lit(0.0)).unionByName(first_rows(spark, d, "test").select(*KEY, *STAGE1).withColumn("y", F.lit(1.0)))
    x = cut(M.assembled(x.withColumn("fold", M.fold(F.col("s1"), FOLDS)), STAGE1))
    rows = [(k, float(M.auc(M.classifier(trees=10, depth=3).fit(x.filter(F.col("fold") != k)).transform(x.filter(F.col("fold") == k))))) for k in range(FOLDS)]
    return spark.createDataFrame(rows, "fold int, auc double")


RECORD_SIDE = ["ctx_rank_rec", "ctx_gap_rec", "ctx_n_rec", *[c for c in K.CONTEXT if c.startswith("p1_rec")]]


def ablation(spark, d):
    """Macro F0.5 of the second stage with all features, and without those of a record's competition."""
    rows, n, out = second_rows(spark, d, "train")[1], _true_counts(spark, d), []
    for name, cols in (("all", K.STAGE2), ("no_record_side", [c for c in K.STAGE2 if c not in RECORD_SIDE])):
        p, _ = M.out_of_fold(rows.drop("fold"), cols, "s1", 3, "p", trees=10, depth=3)
        out.append((name, len(cols), *D.best_thresholds(cut(p.select(*KEY, "y", "p")), n, "s1", ["src", "r"], "p", "y", 20)))
    return spark.createDataFrame(out, "features string, n_features int, macro_f05 double, t_first double, t_add double")


def density_match(spark, d):
    """Test scores of all pairs, with the record-side context of both stages taken within a half of source1 records, beside the plain ones.

    The first stage scores all pairs anew, so what follows from its scores is new as well: which pairs are live, both sides'
    competition, and siblings. Models are not trained again.
    """
    u, drawn = second_rows(spark, d, "test")[0], IO.uniform(F.col("s1")) < 0.5
    first, second = first_stage(spark, d)[2], second_stage(spark, d)[2]
    x = cut(M.predict(first, M.assembled(K.matched_first(u.drop("p1"), drawn), STAGE1), "p1").drop("features"))
    rounds = [x.filter(F.col("is_round2") == k).drop("is_round2") for k in (0, 1)]
    matched = _final(second, *K.stage2_rows(*rounds, base.records(spark, d, "test"), drawn))
    return test_scores(spark, d).select(*KEY, "p").join(matched.select(*KEY, F.col("p").alias("p_matched")), KEY)


QUERIES = {f.__name__: f for f in (gbt_stage1, gbt_round2, gbt_stage2, gbt_features, stage_scores, gbt_blend, gbt_importance, gbt_predict_test, gbt_result_lists, shift_check, adversarial_auc, ablation, density_match)}
ORACLE: dict[str, str] = {}
