"""Evaluation passages in training text, by suffix arrays over shards of the training words."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.runtime import spread

WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall


def words(text: str | None) -> list[str]:
    """Runs of letters, combining marks and digits, without case (ß is ss) and with accents decomposed."""
    if not text:
        return []
    if text.isascii():
        return WORDS(text.lower())
    return WORDS(unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).casefold()))


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of x in the order of their first depth (or more) values, by prefix doubling."""
    n, rank, k = len(x), np.unique(x, return_inverse=True)[1].astype(np.int64), 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = rank[k:] + 1
        if k >= n:
            nxt[:] = 0
        key = rank * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        if k >= depth:
            return order
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


def _narrow(x: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of the ranges [lo, hi) of the suffix array whose value at offset at is word, by binary search."""
    n = len(x)

    def bound(right: bool) -> np.ndarray:
        a, b = lo.copy(), hi.copy()
        while (live := a < b).any():
            mid = (a + b) >> 1
            p = sa[np.minimum(mid, n - 1)] + at
            v = np.where(p < n, x[np.minimum(p, n - 1)], -1)
            up = live & ((v <= word) if right else (v < word))
            a = np.where(up, mid + 1, a)
            b = np.where(live & ~up, mid, b)
        return a

    return bound(False), bound(True)


class Items:
    """Word ids of all evaluation items in a row, with the suffixes of at least least words."""

    def __init__(self, ids: list, texts: list[str | None], least: int):
        self.vocab: dict[str, int] = {}
        seqs = [[self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(t)] for t in texts]
        pairs = [(i, s) for i, s in zip(ids, seqs, strict=True) if len(s) >= least]
        self.longest = max((len(s) for _, s in pairs), default=0)
        self.words = np.array([w for _, s in pairs for w in s], np.int64)
        left = np.concatenate([np.arange(len(s), 0, -1) for _, s in pairs]) if pairs else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(pairs)), [len(s) for _, s in pairs])
        self.starts = np.flatnonzero(left >= least)
        self.left, self.owner, self.ids, self.least = left, owner, [i for i, _ in pairs], least


def search(items: Items, doc_ids: np.ndarray, texts: list[str | None]) -> pd.DataFrame:
    """(doc_id, item_id, n_words, doc_word, item_word): per document and item the longest verbatim match in one shard."""
    get, cols = items.vocab.get, ["doc_id", "item_id", "n_words", "doc_word", "item_word"]
    seqs = [np.fromiter((get(w, 0) for w in words(t)), np.int64) for t in texts]
    runs = []  # (document, first word, ids): maximal runs of words that items have; other words can't be in a match
    for d, s in enumerate(seqs):
        if len(s) < items.least:
            continue
        edge = np.flatnonzero(np.diff(np.r_[0, (s > 0).astype(np.int8), 0]))
        for a, b in edge.reshape(-1, 2):
            if b - a >= items.least:
                runs.append((d, a, s[a:b]))
    if not runs or not len(items.starts):
        return pd.DataFrame(columns=cols)
    x = np.concatenate([np.r_[r, 0] for _, _, r in runs])  # 0 ends a run and is no word
    lengths = [len(r) + 1 for _, _, r in runs]
    doc = np.repeat([d for d, _, _ in runs], lengths)
    word = np.concatenate([np.arange(a, a + n) for (_, a, _), n in zip(runs, lengths, strict=True)])
    sa = suffix_array(x, items.longest)
    q = items.starts
    lo, hi, found = np.zeros(len(q), np.int64), np.full(len(q), len(x), np.int64), []
    for at in range(items.longest):
        live = items.left[q] > at
        l2, h2 = _narrow(x, sa, lo, np.where(live, hi, lo), at, items.words[np.minimum(q + at, len(items.words) - 1)])
        if at >= items.least:  # suffixes in the range so far that don't go on are longest here
            for i in np.flatnonzero((h2 - l2) < (hi - lo)):
                p = np.r_[sa[lo[i] : l2[i]], sa[h2[i] : hi[i]]] if h2[i] > l2[i] else sa[lo[i] : hi[i]]
                found.append((p, np.full(len(p), q[i]), np.full(len(p), at)))
        keep = (h2 > l2) & live
        q, lo, hi = q[keep], l2[keep], h2[keep]
        if not len(q):
            break
    if len(q):
        for i in range(len(q)):
            p = sa[lo[i] : hi[i]]
            found.append((p, np.full(len(p), q[i]), np.full(len(p), items.longest)))
    if not found:
        return pd.DataFrame(columns=cols)
    p, s, n = (np.concatenate(c) for c in zip(*found, strict=True))
    base = np.flatnonzero(np.r_[True, np.diff(items.owner) > 0]) if len(items.owner) else np.zeros(0, int)
    out = pd.DataFrame({"doc_id": doc_ids[doc[p]], "item_id": np.array(items.ids, dtype=object)[items.owner[s]], "n_words": n, "doc_word": word[p], "item_word": s - base[items.owner[s]]})
    return out.sort_values(["n_words", "doc_word", "item_word"], ascending=[False, True, True], kind="stable").drop_duplicates(["doc_id", "item_id"])


def find_leaks(docs: DataFrame, items: DataFrame, least: int = 12, shard_rows: int = 4000, block_items: int = 100_000) -> DataFrame:
    """(doc_id, item_id, n_words, doc_word, item_word) of all documents that share at least `least` words in a row with an item.

    Training text is cut into shards (Arrow batches of a partition, joined up to shard_rows rows); each gets a suffix array
    over word ids, and every suffix of every item is binary-searched in it. n_words is the longest match of the pair, the
    word positions count from 0. Items are sent to the executors in blocks of about block_items, each of which is searched in
    all documents; a fixed evaluation set is one block. Null, empty and short texts match nothing; an item given twice under
    one id counts once; repeated documents each give their rows. No shuffle but the spreading of a small input. doc_id is unique.
    """
    kind, key = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    texts = spread(docs.select("doc_id", "text").filter("text is not null"), "doc_id")
    sent = items.select("item_id", "text").filter("text is not null")
    blocks, found = max(1, -(-sent.count() // block_items)), None
    for k in range(blocks):
        rows = (sent if blocks == 1 else sent.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)).collect()
        one = _searched(texts, docs.sparkSession.sparkContext.broadcast(Items([r.item_id for r in rows], [r.text for r in rows], least)), shard_rows, f"doc_id {kind}, item_id {key}, n_words int, doc_word int, item_word int")
        found = one if found is None else found.unionByName(one)
    best = F.max(F.struct("n_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", "m.n_words", (-F.col("m.d")).alias("doc_word"), (-F.col("m.i")).alias("item_word"))


def _searched(texts: DataFrame, shared, shard_rows: int, schema: str) -> DataFrame:
    """The longest match per document and item of a shard, of the broadcast items."""

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= shard_rows:
                both, held, n = pd.concat(held), [], 0
                if len(found := search(shared.value, both.doc_id.to_numpy(), both.text.tolist())):
                    yield found
        if held:
            both = pd.concat(held)
            if len(found := search(shared.value, both.doc_id.to_numpy(), both.text.tolist())):
                yield found

    return texts.mapInPandas(shards, schema)


def remove_leaks(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """Documents without the leaking ones, all their columns; a null doc_id stays."""
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
