"""Byte-level BPE encoding by a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.runtime import spread

# Fixed value: the published pre-tokenization pattern of the 50k byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NAME = "byte_bpe_50k.tiktoken"
NONE = 1 << 40


def vocabulary_path(path: str | None = None) -> str:
    """The given path, else the file of the installed public tokenizers."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(NAME)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token.

    The leaves of a segment tree hold the rank of the pair that starts at each living part, or NONE; an inner node holds
    the lower of its children, the left one if equal. The root's value leads to the leftmost pair of lowest rank; a merge
    changes three leaves. Each merge thus costs O(log n) and a piece of any length O(n log n).
    """
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], NONE)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends
    before = list(range(-1, n - 1))  # start of the part before

    def put(i: int, value: int) -> None:
        i += size
        if tree[i] == value:
            return
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a <= b else b
            if tree[i] == low:
                return
            tree[i] = low
            i >>= 1

    while (low := tree[1]) != NONE:
        i = 1
        while i < size:
            i = 2 * i if tree[2 * i] == low else 2 * i + 1
        i -= size
        j = end[i]
        stop = end[i] = end[j]
        put(j, NONE)
        if stop < n:
            before[stop] = i
            put(i, get(piece[i : end[stop]], NONE))
        else:
            put(i, NONE)
        if i:
            h = before[i]
            put(h, get(piece[h:stop], NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes texts; remembers the ids of pre-tokens, up to a bound of memory, then starts again."""

    def __init__(self, ranks: dict[bytes, int], remember: int = 200_000, longest: int = 64):
        self.ranks, self.remember, self.longest, self.known = ranks, remember, longest, {}
        self.find = regex.compile(PATTERN).findall

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out, known = [], self.known
        for w in self.find(text):
            ids = known.get(w)
            if ids is None:
                ids = merge(w.encode("utf-8", "replace"), self.ranks)
                if len(w) <= self.longest:
                    if len(known) >= self.remember:
                        known.clear()
                    known[w] = ids
            out += ids
        return out


def encode_column(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """df with ids, the token ids of text, without special tokens.

    Null and empty texts give an empty list; their strings for special tokens are ordinary text. The vocabulary file (a
    fixed size, under 1 MB) is read once on the driver and broadcast. Narrow: one Arrow pass, no shuffle.
    Raises ValueError when the name ids is taken.
    """
    if ids in df.columns:
        raise ValueError(f"{ids} is a column already")
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path(path)))

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = Encoder(shared.value)
        for s in batches:
            yield pd.Series([e.encode(t) for t in s], dtype=object)

    return df.withColumn(ids, encode(F.col(text)))


def corpus_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document."""
    return encode_column(spread(docs.select("doc_id", "text"), "doc_id"), path=path).select("doc_id", "ids")
