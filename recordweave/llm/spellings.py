"""Variant spellings of organisation names: proper words, pigeonhole segment join, linked classes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordweave.llm.names import GIVEN, SHORT, TRADE, near, plain, proper_words, same_words, sound
from recordweave.llm.pairs import pairs_within
from recordweave.llm.segments import similar
from recordweave.operators.components import components
from recordweave.runtime import by_key, cut, identity, spread

START = re.compile(r"[^aeiou]*[aeiou][^aeiou]*[aeiou]")
FORMS = "array<struct<role:string,kind:string,s:string,k:int,wide:boolean>>"


def start(word: str) -> str:
    """The first two syllables without a closing consonant, as names are shortened: ruso for rusobar."""
    m = START.match(word)
    return m[0] if m else word


def bones(word: str) -> str:
    return re.sub("[aeiou]", "", word)


def tidy(words: list[str]) -> list[str]:
    """At most two proper words where some of more look like misspelt trade words."""
    if sum(len(w) > 1 for w in words) > 2:
        kept = [w for w in words if len(w) == 1 or len(w) > 5 or not any(near(w, x) for x in SHORT)]
        kept = kept if sum(len(w) > 1 for w in kept) >= 2 else words
        if sum(len(w) > 1 for w in kept) > 2:
            fewer = [w for w in kept if not any(len(x) > 5 and abs(len(x) - len(w)) < 3 and x[0] == w[0] and (near(w, x) or len(set(x) & set(w)) > 0.8 * len(set(x))) for x in TRADE)]
            kept = fewer if len(fewer) >= 2 else kept
        words = kept
    return [w for w in words if len(w) > 1] if sum(len(w) > 1 for w in words) > 1 else words


def forms(words: list[str]) -> list[tuple[str, str, str, int, bool]]:
    """(role, kind, string, edits, wide): what a name puts into the index and asks of it; wide: longer strings, too, as the string isn't in the index itself.

    Kinds: F full words, C their consonants (swapped letters and wrong vowels leave them as they are), T first word cut to
    its start, I to its initial. Only names with two words stand for the cut ones.
    """
    long = [w for w in words if len(w) > 1]
    k = lambda s, most: min(most, 2 if len(s) >= 9 else 1)
    out = []
    if len(long) >= 2:
        whole = "".join(long)
        orders = {whole, "".join(reversed(long))} | ({a + b for a, b in zip(long, long[1:])} if len(long) > 2 else set())
        out += [("i", "F", whole, e, False) for e in (1, 2)] + [("p", "F", s, k(s, 2), s != whole) for s in orders]
        out += [("i", "C", bones(whole), 1, False)] + [("p", "C", b, 1, b != bones(whole)) for b in {bones(s) for s in orders} if len(b) > 3]
        for a, b in zip(long, long[1:], strict=False):
            if start(a) != a:
                out.append(("i", "T", start(a) + b, 1, False))
            out.append(("i", "I", a[0] + b, 1, False))
        for a, b in [*zip(long, long[1:], strict=False), *zip(long[1:], long, strict=False)]:
            if len(a) <= 6 and (start(a) == a or len(a) <= 5):
                out.append(("p", "T", a + b, 1, True))
    elif long:
        letter = [w for w in words if len(w) == 1]
        if letter:
            out.append(("p", "I", letter[0] + long[0], 1, True))
        else:
            out += [("i", "F", long[0], e, False) for e in (1, 2)] + [("p", "F", long[0], k(long[0], 2), False), ("p", "T", long[0], 1, True), ("p", "I", long[0], 1, True)]
            out += [("i", "C", bones(long[0]), 1, False), ("p", "C", bones(long[0]), 1, False)] if len(bones(long[0])) > 3 else []
    return out


def read(name: str) -> tuple[list[str], list[str], list[str]]:
    """(words, the same with their vowels as typed, full given names) of a name."""
    raw, given = proper_words(name)
    both = [(sound(w), plain(w)) if len(w) > 1 else (w, w) for w in raw]
    for w, v in both:  # a misspelt given name beside two other words
        if len(both) > 2 and len(w) > 5 and not given and (g := next((x for x in GIVEN if len(x) > 5 and near(w, x)), None)):
            given, both = [g], [x for x in both if x != (w, v)]
            break
    words = tidy([w for w, _ in both])
    whom = sorted(set().union(*(GIVEN[g] for g in given))) if given else []
    return words, [v for w, v in both if w in words], whom


def parse(names: DataFrame) -> DataFrame:
    """(name, key, words, typed, given, forms) of distinct names; key is the same for equal proper words and given names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for n in b.name:
                words, typed, whom = read(n)
                f = forms(words) if typed == words else sorted({*forms(words), *forms(typed)})
                key = "|".join(" ".join(x) for x in (words, typed, whom)) if words else f"||{n}"
                rows.append((n, key, words, typed, whom, f))
            if rows:
                yield pd.DataFrame(rows, columns=["name", "text", "words", "typed", "given", "forms"])

    p = names.mapInPandas(run, f"name string, text string, words array<string>, typed array<string>, given array<string>, forms {FORMS}")
    return p.withColumn("key", identity("text")).drop("text")


def _agree(kind: pd.Series, a: pd.Series, b: pd.Series, ta: pd.Series, tb: pd.Series) -> pd.Series:
    def same(x, y, tx, ty) -> bool:
        x, y, tx, ty = list(x), list(y), list(tx), list(ty)
        return any(same_words(p, q) for p in ([x] if x == tx else [x, tx]) for q in ([y] if y == ty else [y, ty]))

    return pd.Series([k not in "FC" or same(*v) for k, *v in zip(kind, a, b, ta, tb, strict=True)])


def classes(names: DataFrame) -> DataFrame:
    """(name, class): names of one class are spellings of one organisation's name. names has distinct strings in `name`.

    Null, blank and unreadable names form a class each by themselves. Names with the same proper words share a node. A word
    stands for itself in two spellings, that of its sounds and that with the vowels as typed. Nodes
    are linked by the segment join over their full words, in both orders; then nodes with a shortened first word, an
    initial, or one run-together word are attached to the linked names that they fit best. If several organisations fit
    equally well, and none has two thirds of their names, the name stays apart.
    """
    parsed = cut(parse(spread(names.select("name").filter("trim(name) != ''").distinct(), "name")))
    # written once, so that a retried task can't number the nodes anew
    nodes = parsed.groupBy("key").agg(F.first("words").alias("words"), F.first("typed").alias("typed"), F.first("given").alias("given"), F.first("forms").alias("forms"), F.count(F.lit(1)).alias("names")).withColumn("node", F.monotonically_increasing_id())
    nodes = cut(nodes)
    f = nodes.select("node", F.explode("forms").alias("f")).select(F.struct("f.kind", "node").alias("id"), F.col("f.s").alias("s"), F.col("f.kind").alias("bucket"), F.col("f.k").alias("k"), F.col("f.wide").alias("wide"), F.col("f.role").alias("role"))
    pairs = similar(f.filter("role = 'i'"), f.filter("role = 'p'")).select(F.col("a.kind").alias("kind"), F.col("a.node").alias("a"), F.col("b.node").alias("b"), "distance").filter("a != b")
    about = nodes.select("node", "words", "typed", "given")
    side = lambda x: by_key(about.select(F.col("node").alias(x), F.col("words").alias(f"w{x}"), F.col("typed").alias(f"t{x}"), F.col("given").alias(f"g{x}")))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    j = j.filter((F.size("ga") == 0) | (F.size("gb") == 0) | F.arrays_overlap("ga", "gb"))
    j = j.filter(F.pandas_udf(_agree, "boolean")("kind", "wa", "wb", "ta", "tb"))
    full = lambda c: F.size(F.filter(c, lambda w: F.length(w) > 1)) > 1
    links = cut(j.select("kind", "a", "b", "distance", full("wa").alias("fa"), full("wb").alias("fb")))
    first = components(links.filter("kind in ('F', 'C') and fa and fb"))
    base = nodes.select("node", "names").join(by_key(first), "node", "left").select("node", "names", F.coalesce("component", "node").alias("c0"))
    hub = base.select(F.col("node").alias("a"), F.col("c0").alias("ca"))
    own = base.select(F.col("node").alias("b"), F.col("c0").alias("cb"))
    turned = links.filter("kind in ('F', 'C') and fb and not fa").select("kind", F.col("b").alias("a"), F.col("a").alias("b"), "distance", F.col("fb").alias("fa"), F.col("fa").alias("fb"))
    fits = links.unionByName(turned).filter("fa and (kind in ('T', 'I') or not fb)").join(by_key(hub), "a").join(by_key(own), "b").filter("ca != cb")
    fits = fits.groupBy("b", "cb", "ca").agg(F.min(F.struct(F.when(F.col("kind").isin("F", "C"), 0).otherwise(1).alias("o"), "distance")).alias("how"))
    sizes = base.groupBy(F.col("c0").alias("ca")).agg(F.sum("names").alias("names"))
    w = Window.partitionBy("b")
    best = fits.join(by_key(sizes), "ca").withColumn("best", F.min("how").over(w)).filter("how = best")
    best = best.withColumn("most", F.max("names").over(w)).withColumn("all", F.sum("names").over(w)).filter("names = most and 3 * most > 2 * all")
    second = components(best.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    final = base.join(by_key(second.withColumnRenamed("node", "c0")), "c0", "left").select("node", F.coalesce("component", "c0").alias("class"))
    keyed = nodes.select("key", "node").join(by_key(final), "node").select("key", "class")
    return parsed.join(by_key(keyed), "key").select("name", "class")


def members(records: DataFrame, record: str = "entity_id", name: str = "business_name") -> DataFrame:
    """(id, name, class): the class of every record whose name isn't null or blank; a record given twice counts once."""
    r = records.select(F.col(record).alias("id"), F.col(name).alias("name")).filter("id is not null and trim(name) != ''").distinct()
    return cut(r.join(by_key(classes(r.select("name").distinct())), "name").select("id", "name", "class"))


def spelling_classes(records: DataFrame, record: str = "entity_id", name: str = "business_name") -> DataFrame:
    """(entity_id, class, n_links): per record its class, named by the smallest id in it, and how many records of the class spell the name otherwise."""
    m = members(records, record, name)
    per = m.groupBy("class", "name").agg(F.count(F.lit(1)).alias("same"))
    all_ = m.groupBy("class").agg(F.count(F.lit(1)).alias("all"), F.min("id").alias("first"))
    j = m.join(by_key(per), ["class", "name"]).join(by_key(all_), "class")
    return j.select(F.col("id").alias("entity_id"), F.col("first").alias("class"), (F.col("all") - F.col("same")).alias("n_links"))


def spelling_pairs(records: DataFrame, record: str = "entity_id", name: str = "business_name") -> DataFrame:
    """(entity_id_a, entity_id_b): records whose names are different spellings of one organisation's name, a < b.

    Null and blank names take no part; the same string is no pair; a record given twice counts once. The pairs within a
    class are made on salted keys, so that a class of any size is spread over tasks.
    """
    p = pairs_within(members(records, record, name), "class", "id", "name")
    return p.filter("a_name != b_name").select(F.col("a").alias("entity_id_a"), F.col("b").alias("entity_id_b")).distinct()
