"""Pigeonhole segment join: all pairs of strings within k edits, by an inverted index of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordweave.runtime import by_key, cut

HOT = 3000


def _start(i: Column, n: Column, m: Column) -> Column:
    """Where segment i of m even ones begins in a string of n letters; the last n mod m are one longer."""
    return (i * F.floor(n / m) + F.greatest(F.lit(0), i - (m - n % m))).cast("int")


def _length(i: Column, n: Column, m: Column) -> Column:
    return (F.floor(n / m) + F.when(i >= m - n % m, 1).otherwise(0)).cast("int")


def _key(*cols: Column) -> Column:
    return F.xxhash64(*cols)


def _index(df: DataFrame) -> DataFrame:
    n, m = F.length("s"), F.col("k") + 1
    segs = F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: F.struct(i.alias("i"), _start(i, n, m).alias("p"), _length(i, n, m).alias("w")))
    x = df.filter(n > F.col("k")).select("*", F.explode(segs).alias("g"))
    return x.select("id", "whole", "s", "k", _key(F.col("bucket"), F.length("s"), F.col("g.i"), F.expr("substring(s, g.p + 1, g.w)")).alias("key"), F.expr("concat(substring(s, 1, g.p), substring(s, g.p + g.w + 1))").alias("left"))


def _shapes(df: DataFrame) -> DataFrame:
    """(n, k, wide, g): for each length of a string up to the longest the places where a segment of a string within k edits can stand; of longer strings only where wide.

    A few rows a letter of the longest string, worked out once instead of for every string.
    """
    n, k, m = F.col("n"), F.col("k"), F.col("k") + 1
    lengths = F.sequence(F.greatest(k + 1, n - k), F.greatest(k + 1, F.when(F.col("wide"), n + k).otherwise(n)))

    def places(l: Column) -> Column:
        d = n - l

        def at(i: Column) -> Column:
            p, w = _start(i, l, m), _length(i, l, m)
            lo = F.greatest(F.lit(0), p - i, p + d - (k - i)).cast("int")
            hi = F.least(n - w, p + i, p + d + (k - i)).cast("int")
            return F.when(lo <= hi, F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda q: F.struct(l.alias("l"), i.alias("i"), q.alias("p"), w.alias("w")))).otherwise(F.expr("cast(array() as array<struct<l:int,i:int,p:int,w:int>>)"))

        return F.flatten(F.transform(F.sequence(F.lit(0), k), at))

    longest = df.groupBy("k").agg(F.max(F.length("s")).alias("n"))
    every = longest.select("k", F.explode(F.sequence(F.lit(0), "n")).alias("n")).select("k", "n", F.explode(F.array(F.lit(True), F.lit(False))).alias("wide"))
    return cut(every.select("n", "k", "wide", F.flatten(F.transform(lengths, places)).alias("g")))


def _probe(df: DataFrame, shapes: DataFrame) -> DataFrame:
    """Substrings of every string at the places that _shapes has for its length."""
    n = F.length("s")
    x = df.filter((n > 0) & ((n > F.col("k")) | F.col("wide"))).withColumn("n", n).join(F.broadcast(shapes), ["n", "k", "wide"]).select("id", "whole", "s", "k", "bucket", F.explode("g").alias("g"))
    return x.select("id", "whole", "s", "k", _key(F.col("bucket"), F.col("g.l"), F.col("g.i"), F.expr("substring(s, g.p + 1, g.w)")).alias("key"), F.expr("concat(substring(s, 1, g.p), substring(s, g.p + g.w + 1))").alias("left"))


def _candidates(index: DataFrame, probe: DataFrame, shapes: DataFrame, depth: int, hot: int) -> DataFrame:
    i, p = _index(index), _probe(probe, shapes)
    one = lambda x, side: x.select(F.col("id").alias(f"{side}id"), F.col("whole").alias(f"{side}s"), F.col("k").alias(f"{side}k"), "key")
    # pairs whose strings need not be compared again are left out by the caller
    crowded = cut(i.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot))
    if crowded.isEmpty():
        return one(i, "i").join(by_key(one(p, "p")), "key")
    cold = one(i.join(by_key(crowded), "key", "left_anti"), "i").join(by_key(one(p.join(by_key(crowded), "key", "left_anti"), "p")), "key")
    if depth == 0:  # the last level: a crowded segment's rows are split over salts, and what asks for it goes to each
        salts = F.ceil(F.col("n") / hot).cast("int")
        left = one(i.join(by_key(crowded), "key").withColumn("key", F.struct("key", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"))), "i")
        right = one(p.join(by_key(crowded), "key").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).withColumn("key", F.struct("key", "salt")), "p")
        return cold.unionByName(left.join(by_key(right), "key").withColumn("key", F.col("key.key")))
    # a segment that very many strings share says little: what stands beside it must be similar, too
    again = lambda x: x.join(by_key(crowded), "key", "left_semi").select("id", "whole", F.col("left").alias("s"), "k", F.col("key").alias("bucket"), F.lit(True).alias("wide"))
    short = lambda x: x.filter(F.length("s") <= F.col("k"))
    beside = _candidates(again(i), again(p), shapes, depth - 1, hot)
    rest = one(short(again(i)).withColumn("key", F.col("bucket")), "i").join(by_key(one(again(p).filter(F.length("s") <= 2 * F.col("k")).withColumn("key", F.col("bucket")), "p")), "key")
    return cold.unionByName(beside).unionByName(rest)


def similar(index: DataFrame, probe: DataFrame | None = None, hot: int = HOT, depth: int = 2) -> DataFrame:
    """(a, b, distance): pairs of rows of index and probe, in one bucket, whose strings are at most k edits apart.

    Both tables have id, s, bucket and k (edits allowed; k of both rows must be equal to meet). Without probe the index is
    joined with itself and each pair comes once, a < b. Every string of the index is cut into k + 1 segments: k edits
    leave one of them whole, so it stands in the other string, shifted by at most k. Segments are looked up in the
    inverted index by hash, and pairs verified by edit distance in a band of width k. Strings of at most k letters match
    equal ones only. A segment that more than `hot` strings have is not compared pair by pair: the parts beside it are
    joined in the same way, down to `depth` levels; on the last one it is split over salts. All joins of strings are by key; what is broadcast has a few rows a letter of the longest string. Null strings match nothing.
    """
    self_join = probe is None
    own = lambda x: x.select("id", "s", F.xxhash64("bucket", F.col("k").cast("int")).alias("bucket"), F.col("k").cast("int").alias("k"), F.col("s").alias("whole"), (F.col("wide") if "wide" in x.columns else F.lit(not self_join)).alias("wide")).filter("s is not null")
    i = own(index)
    p = i if self_join else own(probe)
    c = _candidates(i.drop("wide"), p, _shapes(p), depth, hot)
    differ = F.col("iid") != F.col("pid")
    if self_join:
        differ &= (F.length("is") < F.length("ps")) | (F.length("is") == F.length("ps")) & (F.col("iid") < F.col("pid"))
    far = F.expr("levenshtein(`is`, ps, ik)")
    found = c.filter(differ).withColumn("distance", far).filter("distance >= 0")
    short = i.filter(F.length("s") <= F.col("k")).select(F.col("id").alias("iid"), "bucket", "s").join(by_key(p.select(F.col("id").alias("pid"), "bucket", "s")), ["bucket", "s"]).filter("iid < pid" if self_join else "iid != pid").select("iid", "pid", F.lit(0).alias("distance"))
    both = found.select("iid", "pid", "distance").unionByName(short)
    if self_join:
        both = both.select(F.least("iid", "pid").alias("iid"), F.greatest("iid", "pid").alias("pid"), "distance")
    return both.groupBy(F.col("iid").alias("a"), F.col("pid").alias("b")).agg(F.min("distance").alias("distance"))
