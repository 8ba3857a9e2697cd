"""Texts that lost their end: length-limit spikes per source, and a sentence-end model for cuts in transfer."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordweave.runtime import by_key, cut, spread

TOKENS = regex.compile(r"[\p{L}\p{M}]+|\p{N}+|[.!?।。…]+|[^\s]").findall
# what may stand behind a break or an end: space, signs, closing quotes and brackets
BEHIND = regex.compile(r"(?:[\s\p{So}\p{Sk}\p{Cf}\p{Co}\p{Cc}–—\-»”’\"')\]}]|\p{Emoji_Presentation})+$")
NOTE = regex.compile(r"\s*(?:\[\d+|\(\p{L}{1,3}\. ?\d+)$")  # a reference such as [2] or (K. 14), its bracket stripped
BROKEN = regex.compile(r"(?:<[a-z/]{0,6}|&\w{0,6}|\\|�)+\s*$")  # an entity, tag or character that was cut itself
ENDED = regex.compile(r"[.!?।。]$")
DOTS = regex.compile(r"(?:\.\.+|…)$")
LIMIT, ODD, OPEN, WHOLE = "limit", "broken", "open", "whole"


def strip_behind(text: str) -> tuple[str, str]:
    """(what stands before anything put behind the last words, how it ends: ended, dots, broken or bare)."""
    s, broken = BEHIND.sub("", text), False
    if (m := BROKEN.search(text.rstrip())) or (m := BROKEN.search(s)):
        s, broken = BEHIND.sub("", BROKEN.sub("", text.rstrip() if BROKEN.search(text.rstrip()) else s)), True
    if (m := NOTE.search(s)) and (b := BEHIND.sub("", s[: m.start()])):
        if ENDED.search(b):
            s = b
    if DOTS.search(s):
        return BEHIND.sub("", s.rstrip(".… ")), "dots"
    if ENDED.search(s):
        return s, "ended"
    return s, "broken" if broken else "bare"


def token_class(w: str, vocab) -> str:
    """The word itself if it is common, else its kind: <D> number, <N> capitalised, <r> lower case, <U> script without case."""
    c = w[0]
    if c.isdigit():
        return "<D>"
    if not c.isalpha() or w in vocab:
        return w
    if (low := w.lower()) in vocab:
        return low
    return "<N>" if c.isupper() else "<r>" if c.islower() else "<U>"


def contexts(x: list[str], i: int) -> list[str]:
    """The one to three classes that end with x[i]; ^ stands before the first."""
    y = ["^", *x[max(0, i - 2) : i + 1]] if i < 2 else x[i - 2 : i + 1]
    return [" ".join(y[-n:]) for n in range(1, min(3, len(y)) + 1)]


MARKER = regex.compile(r"^\s*(?:\p{N}+[.)]|[•#*·-]+)\s")


def is_heading(x: list[str], text: str) -> bool:
    """Short and without any sentence mark but a list marker's."""
    return len(text) < 90 and not any(w[0] in ".!?।。…" for w in (x[2:] if MARKER.match(text) else x))


def word(c: str) -> bool:
    """A common word: no kind, no sign."""
    return c[0].isalpha()


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, n), combined in the workers before anything is sent.

    The last word of a text without an end mark doesn't count: it may be a fragment, and one that is as common as words are.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for b in batches:
            for t in b[text]:
                words = [w for w in TOKENS(t) if w[0].isalpha()]
                if words and strip_behind(t)[1] != "ended":
                    words.pop()
                c.update(words)
            if len(c) > 200_000:
                yield pd.DataFrame({"word": list(c), "n": list(c.values())})
                c.clear()
        if c:
            yield pd.DataFrame({"word": list(c), "n": list(c.values())})

    return docs.select(text).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_contexts(docs: DataFrame, text: str, vocab) -> DataFrame:
    """(context, n, ends): how often a context stands in the texts, and how often a sentence or text ends behind it.

    The end of a text without a mark counts as an end only in headings (short, without any mark) and behind a common word
    or a number: longer texts may be cut, and rare words and capitalised ones may be fragments.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        ends: Counter = Counter()
        known, share, cache = vocab.value, ("<N>", "<r>", "<U>"), {}

        def table() -> pd.DataFrame:
            return pd.DataFrame({"context": list(n), "n": list(n.values()), "ends": [ends[k] for k in n]})

        for b in batches:
            for t in b[text]:
                x = []
                for w in TOKENS(t):
                    k = cache.get(w)
                    if k is None:
                        if len(cache) > 200_000:
                            cache.clear()
                        k = cache[w] = token_class(w, known)
                    x.append(k)
                last, head = len(x) - 1, is_heading(x, t)
                for i, w in enumerate(x):
                    if not (w[0] == "<" and len(w) == 3 or w[0].isalpha()):
                        continue
                    e = (x[i + 1][0] in ".!?।。…") if i < last else (head and w not in share)
                    for c in contexts(x, i):
                        n[c] += 1
                        if e:
                            ends[c] += 1
            if len(n) > 300_000:
                yield table()
                n.clear()
                ends.clear()
        if n:
            yield table()

    return docs.select(text).mapInPandas(count, "context string, n long, ends long").groupBy("context").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


def broken_words(last: DataFrame, words: DataFrame) -> DataFrame:
    """(last): last words that stand nowhere else in the corpus and begin a longer word that is known: that word was cut.

    last has the words in `last`; words is the table of counts. Only beginnings of words that stand at least twice are made.
    """
    asked = last.filter("last is not null").distinct().join(by_key(words.select(F.col("word").alias("last"))), "last", "left_anti")
    starts = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda n: F.substring(F.col("word"), F.lit(1), n))
    known = words.filter("n >= 2 and length(word) > 1").select(F.explode(starts).alias("last")).distinct()
    return asked.join(by_key(known), "last", "left_semi")


def length_limits(docs: DataFrame, text: str, source: str, least: int = 5, factor: float = 4.0) -> DataFrame:
    """(source, unit, at_limit): sources whose lengths, in characters or bytes, pile up at their maximum.

    A length is a limit if the three lengths up to it hold at least `least` rows and factor times what the 40 lengths
    before lead to expect, and hardly any text is longer. The histogram has one row per source and length.
    """
    lengths = docs.select(F.col(source).alias("source"), F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.length(text).alias("length")), F.struct(F.lit("bytes").alias("unit"), F.octet_length(text).alias("length")))).alias("u")).select("source", "u.*")
    hist = lengths.groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source", "unit").orderBy("length")
    h = hist.select(
        "*", F.sum("n").over(w.rangeBetween(-2, 0)).alias("top"), F.coalesce(F.sum("n").over(w.rangeBetween(-42, -3)), F.lit(0)).alias("before"), F.coalesce(F.sum("n").over(w.rangeBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("beyond")
    )
    h = h.filter((F.col("top") >= least) & (F.col("top") >= factor * 3 * F.col("before") / 40) & (F.col("beyond") <= 0.02 * F.col("top")) & (F.col("length") > 40))
    return h.groupBy("source", "unit").agg(F.max("length").alias("at_limit"))


def find_truncated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 5e-5, unlikely: float = 0.04, seen: int = 8, salts: int = 8) -> DataFrame:
    """(doc_id, source, why): documents whose text was cut off; why is limit, broken or open.

    limit: the length is at a spike of its source's length histogram (characters or bytes) and no sentence ends there.
    broken: a cut tag, entity or character ends the text. open: the last words, without what was put behind them, are ones
    after which sentences of this corpus don't end (share of ends at most `unlikely`, counted over all texts, longest
    context of up to three words seen often enough), or the text ends in a fragment: a rare lower-case word after a common one,
    or a word that no other text has and that begins one which others have (see broken_words).
    Texts with an end mark, headings and lists, whole sentences without mark or with dots are whole, as are null, empty and
    blank texts. A null source is a source. The vocabulary sent to the executors has at most 1 / share words.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source")).filter("trim(text) != ''")
    own = spread(own, "doc_id")
    spark = docs.sparkSession
    words = cut(count_words(own, "text"))
    total = words.agg(F.sum("n")).first()[0] or 0
    vocab = spark.sparkContext.broadcast(frozenset(r.word for r in words.filter(F.col("n") >= max(3, share * total)).collect()))
    limits = length_limits(own, "text", "source")
    limits = cut(limits.groupBy("source").agg(F.max(F.when(F.col("unit") == "chars", F.col("at_limit"))).alias("max_chars"), F.max(F.when(F.col("unit") == "bytes", F.col("at_limit"))).alias("max_bytes")).withColumnRenamed("source", "_source"))
    near = F.broadcast(limits) if limits.count() <= 100_000 else limits
    at = F.coalesce(F.length("text") >= F.col("max_chars") - 1, F.lit(False)) | F.coalesce(F.octet_length("text") >= F.col("max_bytes") - 4, F.lit(False))
    marked = own.join(near, own["source"].eqNullSafe(near["_source"]), "left").select("doc_id", "source", "text", at.alias("at_limit"))

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocab.value
        for b in batches:
            rows = []
            for d, src, t, limit in zip(b.doc_id, b.source, b.text, b.at_limit, strict=True):
                s, how = strip_behind(t)
                if how == "ended" or not s:
                    continue
                if limit:
                    rows.append((d, src, LIMIT, [], False, False, None))
                    continue
                if how == "broken":
                    rows.append((d, src, ODD, [], False, False, None))
                    continue
                raw = TOKENS(s)
                x = [token_class(w, known) for w in raw]
                if not (x[-1][0] == "<" and len(x[-1]) == 3 or x[-1][0].isalpha()):
                    continue
                last = raw[-1] if raw[-1][0].isalpha() and raw[-1] not in known else None
                heading = is_heading(x, s)
                before = x[-3:-1]
                if heading:  # two common words before a rare one
                    fragment = x[-1] == "<r>" and len(before) == 2 and all(map(word, before))
                else:
                    fragment = x[-1] == "<r>" and bool(before) and (word(before[-1]) or before[-1] in ("<N>", "<D>")) and sum(map(word, x)) > 2
                cased = s[-1].lower() != s[-1].upper()
                if not fragment and (not any(map(word, x[-3:])) or heading and not cased or "://" in s.split()[-1]):
                    if last:
                        rows.append((d, src, OPEN, [], heading, False, last))
                    continue
                rows.append((d, src, OPEN, contexts(x, len(x) - 1), heading, fragment, last))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "source", "why", "contexts", "heading", "fragment", "last"])

    kind = {k: v for k, v in marked.dtypes}
    ends = cut(marked.mapInPandas(tails, f"doc_id {kind['doc_id']}, source {kind['source']}, why string, contexts array<string>, heading boolean, fragment boolean, last string"))
    part = broken_words(ends.select("last"), words).withColumn("part", F.lit(True))
    ends = ends.join(by_key(part), "last", "left").withColumn("fragment", F.col("fragment") | F.coalesce("part", F.lit(False)))
    sure = ends.filter(F.col("why") != OPEN).select("doc_id", "source", "why")
    asked = ends.filter((F.col("why") == OPEN) & ~F.col("fragment")).select("doc_id", "source", "heading", F.posexplode("contexts").alias("order", "context"))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    counts = count_contexts(own, "text", vocab).filter(F.col("n") >= seen)
    counts = counts.select("context", "n", "ends", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    known = asked.join(by_key(counts), ["context", "salt"]).groupBy("doc_id").agg(F.first("source").alias("source"), F.first("heading").alias("heading"), F.max(F.struct("order", "context", "n", "ends")).alias("m"))
    rate = F.col("m.ends") / F.col("m.n")
    plain = ~F.col("m.context").rlike("<[NrUD]>")
    known = known.filter(F.col("m.context").rlike(r"(^|\s)\p{L}"))
    decided = F.when(F.col("heading"), plain & (F.col("m.n") >= 2 * seen) & (rate <= unlikely / 4)).otherwise(rate <= unlikely)
    opened = known.filter(decided).select("doc_id", "source", F.lit(OPEN).alias("why"))
    fragments = ends.filter((F.col("why") == OPEN) & F.col("fragment")).select("doc_id", "source", "why")
    return sure.unionByName(fragments).unionByName(opened)


def source_rates(docs: DataFrame, truncated: DataFrame, source: str = "source") -> DataFrame:
    """(source, n_texts, n_cut, cut_share) for every source; n_texts counts the rows with a text that isn't blank."""
    all_ = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.when(F.trim("text") != "", 1)).alias("n_texts"))
    bad = truncated.groupBy(F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("n_cut"))
    return all_.join(bad, all_["source"].eqNullSafe(bad["_s"]), "left").select("source", "n_texts", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), F.round(F.when(F.col("n_texts") > 0, F.coalesce("n_cut", F.lit(0)) / F.col("n_texts")).otherwise(0.0), 6).alias("cut_share"))
