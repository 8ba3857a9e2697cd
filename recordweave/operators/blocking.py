"""Candidate pairs: multi-pass exact TF-IDF top-k within pools, reverse and expansion passes, union and recall."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordweave.functions.text import numbers, tokens
from recordweave.operators.tfidf import best, char_terms, top_k, vectors, vocabulary, weights, word_terms
from recordweave.runtime import by_key, cut, dropped


class Pass(NamedTuple):
    """One blocking pass: the text, its terms, the bound on document frequency and the neighbours kept."""

    text: Column
    chars: int  # 0: words
    max_df: float
    k: int

    def terms(self, text: Column | None = None) -> Column:
        text = self.text if text is None else text
        return char_terms(text, self.chars) if self.chars else word_terms(text)


def passes() -> dict[str, Pass]:
    core, addr, phon = F.col("core"), F.col("addr"), F.col("phon")
    both = lambda a: F.concat_ws(" ", a, addr)
    return {"na": Pass(both(core), 0, 0.01, 10), "c4": Pass(both(core), 4, 0.002, 5), "ph": Pass(both(phon), 0, 0.01, 5), "nm": Pass(core, 0, 0.01, 5)}


def pooled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (with labels, the label of each of its rows) once in each of its pools: its label, or every label for rows without one; all in one pool where there is no label at all."""
    x = docs.join(F.broadcast(labels.agg(F.collect_list("pool").alias("_all"))))  # one row
    every = F.when(F.size("_all") == 0, F.array(F.lit(""))).otherwise(F.col("_all"))
    return x.withColumn("pool", F.explode(F.flatten(F.transform("labels", lambda c: F.when(c == "", every).otherwise(F.array(c)))))).drop("_all", "labels")


def run_pass(records: DataFrame, spec: Pass, reverse_k: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """((s1, src, r, rank, sim), and the reverse pass: each record's best source1 records).

    records has src (1, 2, 3), id, country and the text columns; the vocabulary is fitted on all of them together. Ranks are
    taken per source1 record, source and pool; a pair found in several pools keeps its best rank. The reverse pass competes
    against all source1 records.
    """
    labels = records.filter("country != ''").select(F.col("country").alias("pool")).distinct()
    v = vectors(records, ["src", "id"], spec.text, spec.terms, "country", records.count(), 2, spec.max_df)
    w = pooled(v, cut(labels)).withColumn("ws", F.transform("rs", lambda r: r / F.col("norm")))
    q = w.filter("src = 1").select("pool", F.col("id").alias("s1"), "terms", "ws")
    t = w.filter("src != 1").select("pool", "src", F.col("id").alias("r"), "terms", "ws")
    once_a_pair = lambda x: x.groupBy("s1", "src", "r").agg(F.min("rank").alias("rank"), F.max("sim").alias("sim"))
    there = best(q, t, ["s1"], ["src", "r"], "pool", spec.k, "src")
    back = best(t, q, ["src", "r"], ["s1"], "pool", reverse_k) if reverse_k else None
    dropped(v)
    forward = once_a_pair(top_k(there, ["s1", "src", "pool"], "r", spec.k))
    return forward, once_a_pair(top_k(back, ["r", "src", "pool"], "s1", reverse_k)) if reverse_k else None


def within_label(records: DataFrame, text: Column, fit_on: Column, max_df: float) -> DataFrame:
    """(src, id, pool, terms, ws): word weights with a vocabulary per label, fitted on the label's records of fit_on; records without a label have none."""
    known = records.filter("country != ''").withColumn("_key", F.struct("country", "src", "id"))
    c = cut(known.select("_key", fit_on.alias("_fit"), F.explode(word_terms(text)).alias("term")).groupBy("_key", "_fit", "term").agg(F.count(F.lit(1)).alias("tf")).withColumn("pool", F.col("_key.country")))
    n = known.filter(fit_on).groupBy(F.col("country").alias("pool")).agg(F.count(F.lit(1)).alias("n"))
    v = vocabulary(c.filter("_fit"), n, 2, max_df, ["pool"])
    w = weights(c.drop("_fit"), v, "_key", by=["pool"]).groupBy("_key", "pool").agg(F.collect_list(F.struct("term", "w")).alias("v"))
    return w.select("_key.src", "_key.id", "pool", F.col("v.term").alias("terms"), F.col("v.w").alias("ws"))


def empty_address_pairs(records: DataFrame, k: int = 50, max_df: float = 0.01) -> DataFrame:
    """(s1, src, r, rank, sim): of each record without an address the k source1 records of its label with the most similar core name."""
    some = records.filter("country != '' and (src = 1 or addr = '')")
    w = cut(within_label(some, F.col("core"), F.col("src") == 1, max_df))
    q = w.filter("src != 1").select("pool", "src", F.col("id").alias("r"), "terms", "ws")
    t = w.filter("src = 1").select("pool", F.col("id").alias("s1"), "terms", "ws")
    return top_k(best(q, t, ["src", "r"], ["s1"], "pool", k).select("s1", "src", "r", "sim"), ["r", "src"], "s1", k)


def neighbours(records: DataFrame, anchors: DataFrame, k: int = 11, max_df: float = 0.01) -> DataFrame:
    """(src, r, src2, r2): of each anchor (src, r) the k source2 and source3 records of its label, itself included, with the most similar name and address."""
    some = records.filter("country != '' and src != 1")
    w = cut(within_label(some, F.concat_ws(" ", "core", "addr"), F.lit(True), max_df))
    t = w.select("pool", F.col("src").alias("src2"), F.col("id").alias("r2"), "terms", "ws")
    q = w.join(by_key(anchors.select("src", F.col("r").alias("id")).distinct()), ["src", "id"], "left_semi").select("pool", "src", F.col("id").alias("r"), "terms", "ws")
    s = best(q, t, ["src", "r"], ["src2", "r2"], "pool", k).withColumn("_o", F.struct("src2", "r2"))
    return top_k(s, ["src", "r"], "_o", k).select("src", "r", "src2", "r2")


def united(found: dict[str, DataFrame]) -> DataFrame:
    """(s1, src, r, rank_NAME and sim_NAME per pass): distinct pairs; rank 255 and a null sim where a pass lacks the pair."""
    all_ = None
    for name, x in found.items():
        x = x.select("s1", "src", "r", "rank", "sim", F.lit(name).alias("pass"))
        all_ = x if all_ is None else all_.unionByName(x)
    of = lambda c, n: F.max(F.when(F.col("pass") == n, F.col(c)))
    cols = [x for n in found for x in (F.coalesce(of("rank", n), F.lit(255)).cast("int").alias(f"rank_{n}"), of("sim", n).alias(f"sim_{n}"))]
    return all_.groupBy("s1", "src", "r").agg(*cols)


def new_pairs(found: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct pairs of found that known doesn't have."""
    on = ["s1", "src", "r"]
    return found.select(*on).distinct().join(known.select(*on), on, "left_anti")


def shared_keys(records: DataFrame, key: Column, most: int) -> DataFrame:
    """(s1, src, r): records that share a key with source1 records, for keys of at most `most` source1 records."""
    k = records.select("src", "id", F.explode(key).alias("key"))
    s = k.filter("src = 1").select("key", F.col("id").alias("s1"))
    few = s.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).select("key")
    return s.join(few, "key").join(k.filter("src != 1").select("key", "src", F.col("id").alias("r")), "key").select("s1", "src", "r").distinct()


def postal_number_key() -> Column:
    """country|postal|number of each number of the address; none without a postal code."""
    ns = F.filter(numbers(F.col("addr")), lambda n: n != F.col("postal"))
    return F.when(F.col("postal") != "", F.transform(ns, lambda n: F.concat_ws("|", "country", "postal", n))).otherwise(F.array().cast("array<string>"))


def rarest_token(records: DataFrame, most: int) -> DataFrame:
    """(s1, src, r): each record's rarest core token among its country's source1 records (ties: the smaller token), joined
    to the source1 records that have it, if at most `most` do."""
    t = records.select("src", "id", "country", F.explode(F.array_distinct(tokens(F.col("core")))).alias("token"))
    s = t.filter("src = 1").select("country", "token", F.col("id").alias("s1"))
    df = s.groupBy("country", "token").agg(F.count(F.lit(1)).alias("df"))
    rare = t.filter("src != 1").join(df, ["country", "token"]).groupBy("src", "id", "country").agg(F.min(F.struct("df", "token")).alias("m")).filter(F.col("m.df") <= most)
    return rare.select("src", F.col("id").alias("r"), "country", F.col("m.token").alias("token")).join(s, ["country", "token"]).select("s1", "src", "r").distinct()


def sibling_pairs(anchors: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(s1, src, r): neighbours (src, r, src2, r2) of the anchors (s1, src, r)."""
    return anchors.join(neighbours, ["src", "r"]).select("s1", F.col("src2").alias("src"), F.col("r2").alias("r")).distinct()


def report(candidates: DataFrame, truth: DataFrame, records: DataFrame, ranks: dict[str, str], ks=(1, 3, 5, 10, 20)) -> DataFrame:
    """(metric, value): recall of all candidates and of each pass at k, candidates per source1 record, reduction ratio within countries and overall."""
    y = truth.select("s1", "r").withColumn("_y", F.lit(1))
    c = candidates.join(y, ["s1", "r"], "left")
    n_true = F.lit(float(max(1, truth.count())))
    sizes = records.groupBy("country").agg(F.sum((F.col("src") == 1).cast("long")).alias("a"), F.sum((F.col("src") != 1).cast("long")).alias("b"))
    full, n1, n2 = sizes.agg(F.sum(F.col("a") * F.col("b")), F.sum("a"), F.sum("b")).first()
    aggs = [(F.sum("_y") / n_true).alias("recall"), (F.count(F.lit(1)) / F.lit(float(max(1, n1 or 0)))).alias("per_s1"), (1 - F.count(F.lit(1)) / F.lit(float(max(1, full or 0)))).alias("reduction"), (1 - F.count(F.lit(1)) / F.lit(float(max(1, (n1 or 0) * (n2 or 0))))).alias("reduction_full")]
    aggs += [(F.coalesce(F.sum(F.when(F.col(col) < k, F.col("_y"))), F.lit(0)) / n_true).alias(f"{name}_at_{k}") for name, col in ranks.items() for k in ks]
    one = c.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.round(F.coalesce(n, F.lit(0.0)), 6).alias("value")) for n in one.columns])).alias("m")).select("m.*")


def category(name_ratio: Column, no_address: Column, foreign: Column, same_postal: Column) -> Column:
    """Why a pair is hard, first reason first: no address on a side, another script, names apart, postal codes apart, else other."""
    return F.when(no_address, "empty_address").when(foreign, "other_script").when(name_ratio < 0.7, "names_apart").when(~F.coalesce(same_postal, F.lit(True)), "postal_apart").otherwise("other")


def gain(found: DataFrame, known: DataFrame, truth: DataFrame, n_queries: int) -> DataFrame:
    """(recall, gain, per_s1): share of the truth among known pairs, what the new pairs of found add to it, and how many new pairs a query costs."""
    on = ["s1", "r"]
    new = new_pairs(found, known)
    t = truth.select(*on).distinct()
    hit = lambda x: t.join(by_key(x.select(*on).distinct()), on, "left_semi").agg(F.count(F.lit(1)).alias("n"))
    j = hit(known).select(F.col("n").alias("a")).join(hit(new).select(F.col("n").alias("b")), F.lit(True)).join(t.agg(F.count(F.lit(1)).alias("t")), F.lit(True)).join(new.agg(F.count(F.lit(1)).alias("c")), F.lit(True))
    all_ = F.greatest(F.col("t"), F.lit(1))
    return j.select(F.round(F.col("a") / all_, 6).alias("recall"), F.round(F.col("b") / all_, 6).alias("gain"), F.round(F.col("c") / F.lit(float(max(1, n_queries))), 6).alias("per_s1"))


def anchors(pairs: DataFrame, p: str, n: int = 5) -> DataFrame:
    """The n best pairs of each source1 record."""
    w = Window.partitionBy("s1").orderBy(F.col(p).desc(), "src", "r")
    return pairs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
