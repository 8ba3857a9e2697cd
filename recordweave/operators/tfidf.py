"""TF-IDF as postings: (id, term, weight) tables and the exact top-k similarity join over them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordweave.functions.strings import sparse_dot
from recordweave.functions.text import tokens
from recordweave.runtime import by_key, collected, cut, dropped, parallelism


def word_terms(text: Column) -> Column:
    return tokens(text)


def char_terms(text: Column, n: int) -> Column:
    """n-grams within words padded by a space on both sides; a shorter padded word gives itself once."""

    def of(w: Column) -> Column:
        p = F.concat(F.lit(" "), w, F.lit(" "))
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(p) - (n - 1)))
        return F.transform(starts, lambda i: F.substring(p, i, F.lit(n)))

    return F.flatten(F.transform(tokens(text), of))


def term_counts(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """(key, term, tf)."""
    return docs.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, n_docs: int | DataFrame, min_df: int = 2, max_df: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """(by, term, df, idf) of terms in at least min_df and at most max_df of all documents; idf = ln((1 + n) / (1 + df)) + 1.

    by: columns that part the documents into collections with a vocabulary each; n_docs is then a table (by, n).
    """
    by = by or []
    df = counts.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"))
    df = df.join(F.broadcast(n_docs.withColumnRenamed("n", "_n")), by) if by else df.withColumn("_n", F.lit(n_docs))  # one row a collection
    df = df.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("_n")))
    return df.select(*by, "term", "df", (F.log((1.0 + F.col("_n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def weights(counts: DataFrame, vocab: DataFrame, key: str, sublinear: bool | Column = True, by: list[str] | None = None) -> DataFrame:
    """(by, key, term, w, idf): tf-idf weights, each document of length 1. Documents without a term of the vocabulary have no rows."""
    by = by or []
    tf = F.when(sublinear if isinstance(sublinear, Column) else F.lit(sublinear), 1.0 + F.log("tf")).otherwise(F.col("tf").cast("double"))
    raw = counts.join(by_key(vocab.select(*by, "term", "idf")), [*by, "term"]).select(*by, key, "term", "idf", (tf * F.col("idf")).alias("r"))
    norm = raw.groupBy(*by, key).agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"))
    return raw.join(by_key(norm), [*by, key]).select(*by, key, "term", (F.col("r") / F.col("norm")).alias("w"), "idf")


def nearest(q: DataFrame, t: DataFrame, q_key: str, t_key: str, pool: str, k: int, group: Column | None = None, groups: int = 1, budget: int = 20_000, digits: int = 6) -> tuple[DataFrame, bool]:
    """((q_key, t_key, sim), whole): of each q row set the targets of highest cosine in its pool, exactly; at least the k best of each group.

    q and t are postings (key, term, pool, w) of vectors of length 1. A query first meets the postings of its rarest terms,
    together at most budget of them (one term at least): that is all there is to do where no term is left (whole: the table
    then has all pairs with a common term). Else the k-th best partial sum so far bounds what can still be among the k best:
    a target without any of the rarest terms can't be longer than the query's remaining weights, so frequent terms are looked
    up only while those outweigh the bound. Partial sums that could reach it are completed from the targets' own vectors.
    group: the part of t_key that ranks are taken in (groups: how many there are).
    """
    group = F.lit(0) if group is None else group
    df = t.groupBy(pool, "term").agg(F.count(F.lit(1)).alias("_df"))
    by_df = Window.partitionBy(q_key).orderBy("_df", "term")
    x = q.join(by_key(df), [pool, "term"]).withColumns({"_met": F.sum("_df").over(by_df.rowsBetween(Window.unboundedPreceding, 0)), "_i": F.row_number().over(by_df)})
    x = x.withColumn("_early", (F.col("_met") <= budget) | (F.col("_i") == 1))
    x = cut(x.withColumn("_left", F.sqrt(F.sum(F.col("w") * F.col("w")).over(by_df.rowsBetween(0, Window.unboundedFollowing)))))
    right = by_key(t.withColumnRenamed("w", "_w"))
    meet = lambda rows: rows.join(right, ["term", pool]).groupBy(q_key, t_key).agg(F.sum(F.col("w") * F.col("_w")).alias("s"))
    out = lambda s: s.select(q_key, t_key, F.round("s", digits).alias("sim")).filter("sim > 0.000001")
    if x.filter("not _early").isEmpty():
        return out(meet(x)), True
    early = cut(meet(x.filter("_early")))
    w = Window.partitionBy(q_key, group).orderBy(F.col("s").desc())
    kth = early.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == k).groupBy(q_key).agg(F.when(F.count(F.lit(1)) >= groups, F.min("s")).otherwise(0.0).alias("_kth"))
    late = x.filter("not _early").join(by_key(kth), q_key, "left").withColumn("_kth", F.coalesce("_kth", F.lit(0.0)))
    late = cut(late.withColumn("_need", F.col("_left") + 2e-6 >= F.col("_kth")))
    partial = early.unionByName(meet(late.filter("_need"))).groupBy(q_key, t_key).agg(F.sum("s").alias("s"))
    rest = late.filter("not _need").groupBy(q_key).agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("_rest"), F.max("_left").alias("_slack"), F.first("_kth").alias("_kth"))
    p = partial.join(by_key(rest), q_key, "left")
    done = p.filter("_rest is null")
    asked = p.filter(F.col("_rest").isNotNull() & (F.col("s") + F.col("_slack") + 2e-6 >= F.col("_kth")))
    whole = t.groupBy(t_key).agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("_all"))
    full = asked.join(by_key(whole), t_key).withColumn("s", F.col("s") + sparse_dot(F.col("_rest"), F.col("_all")))
    return out(done.select(q_key, t_key, "s").unionByName(full.select(q_key, t_key, "s"))), False


def vectors(docs: DataFrame, key: list[str], text: Column, terms: Callable[[Column], Column], label: str, n_docs: int, min_df: int = 2, max_df: float = 1.0, most: int = 20_000_000) -> DataFrame:
    """(key, labels, terms, rs, norm): what term_counts, vocabulary and weights give together, one row a document; rows of one key are one document.

    terms are numbers of the vocabulary, rs weights before they are divided by the norm: of those there are as many as
    document frequencies, so the table packs them well. labels has the label of each row of the document. Terms above max_df
    don't travel at all: there are at most terms a document / max_df of them, which are broadcast. Documents meet the vocabulary
    in parts of about `most` postings, and each part's shuffles are deleted before the next, so they don't grow with the input.
    Only texts are kept between the steps, terms are made again from them, and postings carry a number for their document.
    """
    spark = docs.sparkSession
    collected(spark)
    whole = docs.select(*key, text.alias("x"), label).repartition(parallelism(spark), *key).groupBy(*key).agg(F.concat_ws(" ", F.collect_list("x")).alias("x"), F.collect_list(label).alias("labels"))
    own = cut(whole.withColumn("_d", F.monotonically_increasing_id()))
    del whole
    collected(spark)
    read = own.select("_d", terms(F.col("x")).alias("t"))
    df = read.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df)
    vocab = cut(df.withColumns({"idf": F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0, "n": F.monotonically_increasing_id()}))
    del df
    collected(spark)
    frequent = vocab.filter(F.col("df") > max_df * n_docs).select("term")
    known = vocab.filter(F.col("df") <= max_df * n_docs).select("term", "n", "idf")
    tf = F.transform(F.array_distinct("t"), lambda x: F.struct(x.alias("term"), F.size(F.filter("t", lambda y: y == x)).alias("tf")))
    parts = 1 + (read.agg(F.sum(F.size("t"))).first()[0] or 0) // most
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x["r"] * x["r"]))
    out = None
    for i in range(parts):
        here = F.lit(True) if parts == 1 else F.pmod(F.xxhash64("_d", F.lit(parts)), F.lit(parts)) == i
        c = read.filter(here).select("_d", F.inline(tf)).join(F.broadcast(frequent), "term", "left_anti")
        raw = c.join(by_key(known), "term").groupBy("_d").agg(F.collect_list(F.struct(F.col("n").alias("term"), ((1.0 + F.log("tf")) * F.col("idf")).alias("r"))).alias("v"))
        x = cut(raw.join(by_key(own.filter(here).select("_d", *key, "labels")), "_d").select(*key, "labels", F.col("v.term").alias("terms"), F.col("v.r").alias("rs"), norm.alias("norm")))
        out = x if out is None else out.unionByName(x)
        del c, raw
        collected(spark)
    dropped(own, vocab)
    return out


def _postings(x: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Terms and weights of all rows, and where each row's end."""
    terms, ws = (x[c].combine_chunks() for c in ("terms", "ws"))
    n = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
    return terms.flatten(), ws.flatten().to_numpy(zero_copy_only=False), np.cumsum(n)


def _kth(s: np.ndarray, k: int) -> float:
    return float(np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else 0.0


def best(q: DataFrame, t: DataFrame, q_key: list[str], t_key: list[str], pool: str, k: int, group: str | None = None, blocks: tuple[int, int] = (2_000_000, 2_500_000), dense: int = 2048, digits: int = 6, at_once: int | None = None) -> DataFrame:
    """(pool, q_key, t_key, sim): of each q row the k targets of highest cosine in its pool and each group, exactly, and a few more; ties go by t_key.

    q and t are (key, pool, terms, ws) with vectors of length 1; group is the first of t_key or none. Queries and targets of a
    pool meet in blocks of about so many postings a side. A block adds up a query's sums in memory, rarest terms first, and
    gives only its k best, so of all pairs only those are written. Before a term of more than `dense` postings the k-th best sum
    so far tells whether a target with no rarer term can still be among the k best; if not, the remaining terms are looked up
    only for the targets met so far that can.

    Pairs of blocks are met in rounds of about `at_once` postings (None: two pairs a core). A round's shuffles are deleted before
    the next and only its k best are written, so the disk that copies of the blocks take doesn't grow with their number.
    """
    assert group in (None, t_key[0])
    spark = q.sparkSession
    at_once = at_once or 2 * spark.sparkContext.defaultParallelism * sum(blocks)
    sizes = lambda x, n: x.groupBy(pool).agg(F.sum(F.size("terms")).alias(n))
    plan, done = [], 0  # one row a pool: its blocks, where it begins among all pairs of blocks, and the postings of a pair
    for name, a, b in sizes(q, "a").join(sizes(t, "b"), pool).orderBy(pool).collect():
        qn, tn = max(1, -(-a // blocks[0])), max(1, -(-b // blocks[1]))
        plan.append((name, qn, tn, done, a // qn + b // tn))
        done += qn * tn * plan[-1][-1]
    rounds = 1 + done // at_once
    parts = spark.createDataFrame(plan, f"{pool} string, _qn int, _tn int, _from long, _pair long")
    hashed = lambda cols, n: F.pmod(F.xxhash64(*cols), F.col(n)).cast("int")
    now = lambda qi, ti: F.floor((F.col("_from") + (qi * F.col("_tn") + ti) * F.col("_pair")) / at_once)
    own = lambda *cols: [F.col(c).alias(c) for c in cols]  # noqa: E731  # q and t may be parts of one table
    at = [pool, "_qi", "_ti"]

    def sides(i: int) -> tuple[DataFrame, DataFrame]:
        """Both sides of the pairs of blocks of round i."""
        every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        left = q.join(F.broadcast(parts), pool).withColumn("_qi", hashed(q_key, "_qn"))
        right = t.join(F.broadcast(parts), pool).withColumn("_ti", hashed(t_key, "_tn"))
        left = left.withColumn("_ti", F.filter(every("_tn"), lambda x: now(F.col("_qi"), x) == i))
        right = right.withColumn("_qi", F.filter(every("_qn"), lambda x: now(x, F.col("_ti")) == i))
        left, right = left.filter("size(_ti) > 0"), right.filter("size(_qi) > 0")
        return left.select(*own(pool), "_qi", F.explode("_ti").alias("_ti"), *own(*q_key, "terms", "ws")), right.select(*own(pool), F.explode("_qi").alias("_qi"), "_ti", *own(*t_key, "terms", "ws"))

    unit = 10.0**digits

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.take(pc.sort_indices(b, sort_keys=[(c, "ascending") for c in t_key]))
        (b_terms, b_w, b_end), (a_terms, a_w, a_end) = _postings(b), _postings(a)
        code = pa.concat_arrays([b_terms, a_terms]).dictionary_encode()
        code, n_terms = code.indices.to_numpy(), len(code.dictionary)
        b_code, a_code = code[: len(b_w)], code[len(b_w) :]
        df = np.bincount(b_code, minlength=n_terms)
        end = np.cumsum(df)
        order = np.argsort(b_code, kind="stable")
        row, w = np.repeat(np.arange(len(b_end)), np.diff(b_end, prepend=0))[order], b_w[order]
        owner = np.repeat(np.arange(len(a_end)), np.diff(a_end, prepend=0))
        met = df[a_code] > 0
        owner, a_code, a_w = owner[met], a_code[met], a_w[met]
        by = np.lexsort((a_code, df[a_code], owner))  # a query's terms, rarest first
        owner, a_code, a_w = owner[by], a_code[by], a_w[by]
        first = np.searchsorted(owner, np.arange(len(a_end) + 1)).tolist()
        los, his = (end - df)[a_code], end[a_code]
        edges = [0, len(b_end)]
        if group:
            g = b[group].to_numpy()
            edges = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        sums = np.zeros(len(b_end))
        from_, to, sim = [], [], []

        def parted(c: np.ndarray) -> list[np.ndarray | slice]:
            return [slice(None)] if len(edges) == 2 else [(c >= x) & (c < y) for x, y in zip(edges[:-1], edges[1:], strict=True)]

        for i in range(len(a_end)):
            f, e, new = first[i], first[i + 1], []
            lo, hi, ws = los[f:e].tolist(), his[f:e].tolist(), a_w[f:e].tolist()
            for j in range(e - f):
                if j and hi[j] - lo[j] > dense:
                    rest = float(np.sqrt(np.dot(ws[j:], ws[j:]))) + 1e-6
                    c = np.concatenate(new)
                    s = sums[c]
                    kth = min(_kth(s[m], k) for m in parted(c))
                    if rest < kth - 2 / unit:
                        sums[c] = 0.0
                        c = c[s + rest >= kth - 2 / unit]
                        s = s[s + rest >= kth - 2 / unit]
                        for x in range(j, e - f):
                            p = row[lo[x] : hi[x]]
                            there = np.minimum(np.searchsorted(p, c), len(p) - 1)
                            s += np.where(p[there] == c, ws[x] * w[lo[x] : hi[x]][there], 0.0)
                        sums[c], new = s, [c]
                        break
                r = row[lo[j] : hi[j]]
                v = sums[r]
                new.append(r[v == 0.0])
                sums[r] = v + ws[j] * w[lo[j] : hi[j]]
            if not new:
                continue
            c = np.concatenate(new)
            s = sums[c]
            sums[c] = 0.0
            for m in parted(c):
                cm, sm = c[m], s[m]
                if len(cm) > k:
                    v = np.floor(sm * unit + 0.5)
                    kth = np.partition(v, len(v) - k)[len(v) - k]
                    above, tied = np.flatnonzero(v > kth), np.flatnonzero(v == kth)
                    kept = np.r_[above, tied[np.argsort(cm[tied])[: k - len(above)]]]
                    cm, sm = cm[kept], sm[kept]
                from_.append(np.full(len(cm), i))
                to.append(cm)
                sim.append(sm)
        empty = np.zeros(0, np.int64)
        i, c = np.concatenate([empty, *from_]), np.concatenate([empty, *to])
        cols = {pool: pa.array([key[0].as_py()] * len(i), pa.string()), **{n: a[n].take(pa.array(i)) for n in q_key}, **{n: b[n].take(pa.array(c)) for n in t_key}}
        return pa.table(cols | {"sim": pa.array(np.concatenate([np.zeros(0), *sim]), pa.float64())})

    kinds = {**dict(q.dtypes), **dict(t.dtypes)}
    shape = ", ".join(f"{c} {kinds[c]}" for c in (pool, *q_key, *t_key)) + ", sim double"
    order = Window.partitionBy(pool, *q_key, *[group] * bool(group)).orderBy(F.col("sim").desc(), *t_key)
    out = None
    for i in range(rounds):
        left, right = sides(i)
        x = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(run, shape)
        x = x.withColumn("sim", F.round("sim", digits)).filter("sim > 0.000001")
        if any(p[2] > 1 for p in plan):
            x = x.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= k).drop("_k")
        x = cut(x)
        out = x if out is None else out.unionByName(x)
        del left, right
        collected(spark)
    return out


def top_k(sims: DataFrame, by: list[str], other: str, k: int, rank: str = "rank", cap: int = 254) -> DataFrame:
    """The k best rows of each `by`, with their rank from 0; equal similarities go by the smaller other.

    Planned with a group limit before the shuffle, so each task sends at most k rows of a group.
    """
    w = Window.partitionBy(*by).orderBy(F.col("sim").desc(), other)
    return sims.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k).withColumn(rank, F.least(F.col(rank) - 1, F.lit(cap)))
