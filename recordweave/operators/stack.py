"""The two-round stack: first-stage scores, expansion around its best pairs, second stage over both rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.functions import strings as S
from recordweave.operators import blocking as B
from recordweave.operators import context as C
from recordweave.operators.pairs import KEY, PASSES, STAGE1, pair_features
from recordweave.runtime import by_key, cut

CONTEXT = ["p1", *[f"p1_{k}_{x}" for k in ("s1", "rec") for x in ("max", "gap", "rank", "n_hi", "sum", "best_other")]]
FREQUENCY = ["nf_s1_same_rcore", "nf_rec_same_rcore"]
STAGE2 = [*STAGE1, *CONTEXT, *C.SIBLING, *FREQUENCY, "is_round2"]
LIVE, LIVE2, SEEN = 0.01, 0.001, 1e-4  # least first-stage probabilities: re-scored of round 1, of round 2, and counted as competition


def columns_of(df: DataFrame, *starts: str) -> list[str]:
    """Columns whose names begin with one of the given prefixes."""
    return [c for c in df.columns if c.startswith(starts)]


def live(df: DataFrame, p: str = "p1") -> DataFrame:
    """Pairs of either round that the second stage scores."""
    return df.filter(F.col(p) >= F.when(F.col("is_round2") == 1, LIVE2).otherwise(LIVE))


def expanded(rec: DataFrame, scored: DataFrame, top: int = 5, near: int = 11) -> DataFrame:
    """(s1, src, r): new pairs: neighbours of each source1 record's best pairs by p1, and best source1 records of records without address."""
    a = cut(B.anchors(scored.select(*KEY, "p1"), "p1", top))
    found = B.sibling_pairs(a, B.neighbours(rec, a, near)).unionByName(B.empty_address_pairs(rec).select(*KEY))
    return B.new_pairs(found, scored)


def round2_features(new: DataFrame, rec: DataFrame, first: DataFrame) -> DataFrame:
    """new pairs with STAGE1: what blocking passes would say is null, and competition is that of both rounds together.

    first: the pairs of round 1 with their base score.
    """
    f = cut(pair_features(new.select(*KEY, *[F.lit(None).cast("double").alias(c) for c in PASSES]), rec))
    both = first.select(*KEY, "base", F.lit(1).alias("round")).unionByName(f.select(*KEY, "base", F.lit(2).alias("round")))
    c = C.add_context(both, "base", ["s1", "src"], ["src", "r"]).filter("round = 2").drop("base", "round")
    return f.join(by_key(c), KEY).select(*KEY, *STAGE1)


def name_frequency(rec: DataFrame) -> DataFrame:
    """(country, core, n_s1, n_rec): how many source1 records, and how many others, of a country have a core name."""
    return rec.groupBy("country", "core").agg(F.sum((F.col("src") == 1).cast("long")).alias("n_s1"), F.sum((F.col("src") != 1).cast("long")).alias("n_rec"))


def matched_first(u: DataFrame, drawn: F.Column) -> DataFrame:
    """u, pairs of both rounds with base and is_round2, with STAGE1's competition of a record among its drawn pairs; a pair itself always counts.

    As without a draw, pairs of round 1 compete within it, and those of round 2 with both.
    """
    x = u.select(*KEY, "base", "is_round2").withColumn("drawn", drawn)
    within = lambda y: C.matched_context(y, "base", ["src", "r"], "drawn")
    m = within(x.filter("is_round2 = 0")).unionByName(within(x).filter("is_round2 = 1"))
    names = {"m_rank": "ctx_rank_rec", "m_gap": "ctx_gap_rec", "m_n": "ctx_n_rec"}
    return u.drop(*names.values()).join(by_key(m.select(*KEY, *[F.col(a).alias(b) for a, b in names.items()])), KEY)


def stage2_rows(first: DataFrame, second: DataFrame, rec: DataFrame, drawn: F.Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(all pairs of both rounds with p1 and is_round2, the live ones with all of STAGE2). first and second have KEY, STAGE1, p1 and maybe y.

    drawn: whether a pair's source1 record competes for records; a pair itself always counts.
    """
    u = first.withColumn("is_round2", F.lit(0.0)).unionByName(second.withColumn("is_round2", F.lit(1.0)), allowMissingColumns=True)
    u = cut(u)
    c = C.competition(u.filter(F.col("p1") >= SEEN).select(*KEY, "p1"), "p1", ["s1"], "p1_s1")
    if drawn is None:
        c = C.competition(c, "p1", ["src", "r"], "p1_rec")
    else:
        m = C.matched_competition(c.withColumn("drawn", drawn), "p1", ["src", "r"], "drawn")
        c = m.select(*c.columns, *[F.col(x).alias(f"p1_rec_{x[2:]}") for x in columns_of(m, "m_")])
    c = c.drop("p1")
    d = cut(live(u).join(by_key(c), KEY, "left"))
    one = rec.groupBy("src", "id").agg(*[F.min(x).alias(x) for x in ("country", "core", "addr", "nums")]).withColumn("nums", F.filter(F.split("nums", " "), lambda x: x != ""))
    one = cut(one)
    records = one.filter("src != 1").select(F.struct("src", F.col("id").alias("r")).alias("rec"), "core", "addr", "nums")
    queries = one.filter("src = 1").select(F.col("id").alias("s1"), "nums")
    ratio = lambda a, b: S.score(["token_set_ratio"], a, b)["token_set_ratio"]
    sib = C.siblings(d.select("s1", F.struct("src", "r").alias("rec"), "p1"), records, "s1", "rec", "p1", queries=queries, ratio=ratio).select("s1", "rec.*", *C.SIBLING)
    freq = name_frequency(rec)
    names = d.select(*KEY).join(by_key(one.filter("src != 1").select("src", F.col("id").alias("r"), "core")), ["src", "r"]).join(by_key(one.filter("src = 1").select(F.col("id").alias("s1"), "country")), "s1").join(by_key(freq), ["country", "core"], "left")
    names = names.select(*KEY, *[F.coalesce(F.col(a), F.lit(0)).cast("double").alias(b) for a, b in zip(("n_s1", "n_rec"), FREQUENCY, strict=True)])
    return u, cut(d.join(by_key(sib), KEY, "left").join(by_key(names), KEY, "left"))
