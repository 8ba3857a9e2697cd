"""String similarities of record linkage, for whole batches at a time: edit ratios, token ratios, Jaro-Winkler.

Strings of a batch stand in matrices of code points, sorted by length so that blocks have little padding. The longest common
subsequence of all pairs of a block advances together, one letter of the longer strings a step, in 64-bit rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 63  # letters of the shorter string that fit a row
BLOCK, CELLS = 2048, 1 << 20  # most pairs and letters of a block


def _codes(xs: list[str], width: int, pad: int) -> np.ndarray:
    m = np.full((len(xs), max(width, 1)), pad, np.uint32)
    for i, x in enumerate(xs):
        m[i, : len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
    return m


def _long_lcs(a: str, b: str) -> int:
    """The same recurrence in one big integer, for strings longer than a row."""
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _hits(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """(rows, letters of the longer string): bits of the shorter string's places that hold the letter."""
    bit = np.uint64(1) << np.arange(short.shape[1], dtype=np.uint64)
    out = np.zeros(long.shape, np.uint64)
    for i in range(short.shape[1]):
        out |= np.where(short[:, i : i + 1] == long, bit[i], np.uint64(0))
    return out


def _zeros(row: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of the first n bits are 0."""
    return np.bitwise_count(~row & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))).astype(np.int64)


def _blocks(a: list[str], b: list[str]):
    """(rows, shorter strings, longer strings) of blocks of pairs with like lengths; rows whose shorter string is too long come singly."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    fit = [i for i in order if len(pairs[i][0]) <= WORD]
    at = 0
    while at < len(fit):
        rows, width = [], 1
        for i in fit[at : at + BLOCK]:
            width = max(width, len(pairs[i][1]))
            if rows and width * (len(rows) + 1) > CELLS:
                break
            rows.append(i)
        at += len(rows)
        yield np.array(rows), [pairs[i][0] for i in rows], [pairs[i][1] for i in rows]
    for i in order[len(fit) :]:
        yield i, pairs[i][0], pairs[i][1]


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of the pairs."""
    out = np.zeros(len(a), np.int64)
    for rows, short, long in _blocks(a, b):
        if isinstance(rows, int):
            out[rows] = _long_lcs(short, long)
            continue
        n = np.array([len(x) for x in short])
        hits = _hits(_codes(short, n.max(), 0xFFFFFFFF), _codes(long, max(map(len, long)), 0xFFFFFFFE))
        row = np.full(len(short), ~np.uint64(0))
        for j in range(hits.shape[1]):
            hit = row & hits[:, j]
            row = (row + hit) | (row - hit)
        out[rows] = _zeros(row, n)
    return out


def indel_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """2 LCS / (length + length); 1 for two empty strings."""
    n = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], float)
    return np.where(n > 0, 2 * lcs_lengths(a, b) / np.maximum(n, 1), 1.0)


def token_sort_ratios(a: list[str], b: list[str]) -> np.ndarray:
    tidy = lambda xs: [" ".join(sorted(x.split())) for x in xs]
    return indel_ratios(tidy(a), tidy(b))


def token_set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Best ratio of the shared tokens, and of those with either side's others; 1 if one side's tokens are all shared, 0 without tokens."""
    out = np.zeros(len(a))
    owner, left, right = [], [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        s, t = set(x.split()), set(y.split())
        if not s or not t:
            continue
        common = " ".join(sorted(s & t))
        if common and (s <= t or t <= s):
            out[i] = 1.0
            continue
        one, two = (" ".join(filter(None, (common, " ".join(sorted(u))))) for u in (s - t, t - s))
        for p, q in ((one, two), (common, one), (common, two)) if common else ((one, two),):
            owner.append(i)
            left.append(p)
            right.append(q)
    if owner:
        np.maximum.at(out, owner, indel_ratios(left, right))
    return out


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Best ratio of the shorter string with a window of the longer one, of its length or cut off at an end; 0 if it is empty, 1 if both are."""
    out = np.zeros(len(a))
    for rows, short, long in _blocks(a, b):
        if isinstance(rows, int):
            k = len(short)
            windows = [long[max(0, i) : i + k] for i in range(1 - k, len(long))]
            out[rows] = max(2 * _long_lcs(short, w) / (k + len(w)) for w in windows)
            continue
        k, n = np.array([len(x) for x in short]), np.array([len(x) for x in long])
        most, width = int(k.max()), int(n.max())
        out[rows] = (n == 0).astype(float)
        if not most:
            continue
        hits = _hits(_codes(short, most, 0xFFFFFFFF), _codes(long, width, 0xFFFFFFFE))
        starts = np.arange(1 - most, width)
        for at in range(0, len(rows), 64):  # all windows of a row advance together
            s = slice(at, at + 64)
            padded = np.pad(hits[s], ((0, 0), (most - 1, most)))
            row = np.full((len(padded), len(starts)), ~np.uint64(0))
            for step in range(most):
                hit = row & padded[:, step : step + len(starts)] * (step < k[s, None]).astype(np.uint64)
                row = (row + hit) | (row - hit)
            inside = np.minimum(starts[None, :] + k[s, None], n[s, None]) - np.maximum(starts, 0)[None, :]
            ratio = 2 * _zeros(row, np.broadcast_to(k[s, None], row.shape)) / (k[s, None] + np.maximum(inside, 1))
            out[rows[s]] = np.maximum(out[rows[s]], np.where((inside > 0) & (k[s, None] > 0), ratio, 0).max(1))
    return out


def jaro_winklers(a: list[str], b: list[str], weight: float = 0.1) -> np.ndarray:
    """Jaro-Winkler similarities; the prefix of up to four letters counts for Jaro above 0.7. 1 for equal strings, 0 if one is empty."""
    out = np.zeros(len(a))
    order = np.array(sorted(range(len(a)), key=lambda i: (len(a[i]), len(b[i]))), np.int64)
    for at in range(0, len(order), BLOCK):
        rows = order[at : at + BLOCK]
        xs, ys = [a[i] for i in rows], [b[i] for i in rows]
        nx, ny = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
        x, y = _codes(xs, nx.max(), 0xFFFFFFFF), _codes(ys, ny.max(), 0xFFFFFFFE)
        span = np.maximum(np.maximum(nx, ny) // 2 - 1, 0)
        place = np.arange(y.shape[1])
        mine, free = np.zeros(x.shape, bool), np.ones(y.shape, bool)
        for i in range(x.shape[1]):
            able = (y == x[:, i : i + 1]) & free & (np.abs(place - i) <= span[:, None])
            hit = able.any(1)
            free[np.flatnonzero(hit), able.argmax(1)[hit]] = False
            mine[:, i] = hit
        theirs = ~free
        m = mine.sum(1)
        pack = lambda codes, taken: np.take_along_axis(np.where(taken, codes, 0), np.argsort(~taken, axis=1, kind="stable"), 1)
        p, q = pack(x, mine), pack(y, theirs)
        w = min(p.shape[1], q.shape[1])
        swaps = ((p[:, :w] != q[:, :w]) & (np.arange(w) < m[:, None])).sum(1) // 2
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = np.where(m > 0, (m / nx + m / ny + (m - swaps) / m) / 3, 0.0)
        w = min(4, x.shape[1], y.shape[1])
        same = np.cumprod(x[:, :w] == y[:, :w], axis=1).sum(1)
        value = np.where(jaro > 0.7, jaro + same * weight * (1 - jaro), jaro)
        out[rows] = np.where([p == q for p, q in zip(xs, ys, strict=True)], 1.0, value)
    return out


SCORERS: dict[str, Callable[[list[str], list[str]], np.ndarray]] = {"indel_ratio": indel_ratios, "token_sort_ratio": token_sort_ratios, "token_set_ratio": token_set_ratios, "partial_ratio": partial_ratios, "jaro_winkler": jaro_winklers}


def _distinct(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, np.ndarray, list[str], list[str]]:
    """(rows with both strings, their place among the distinct pairs, the distinct pairs' strings)."""
    there = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    place: dict[tuple[str, str], int] = {}
    at = np.array([place.setdefault(k, len(place)) for k in zip(a.to_numpy()[there], b.to_numpy()[there], strict=True)], np.int64)
    return there, at, [k[0] for k in place], [k[1] for k in place]


def score(names: list[str], a: Column, b: Column) -> Column:
    """A struct of the named similarities of two strings, in one Arrow pass over a batch's distinct pairs; null where either string is null."""

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        there, at, left, right = _distinct(x, y)
        out = pd.DataFrame(np.full((len(x), len(names)), np.nan), columns=names)
        for n in names if len(there) else []:
            out.loc[there, n] = SCORERS[n](left, right)[at]
        return out.astype(object).where(out.notna(), None)

    return F.pandas_udf(run, ", ".join(f"{n} double" for n in names))(a, b)


def best_score(name: str, a: Column, b: Column) -> Column:
    """The best similarity of any string of one array with any of the other; null where an array is null or empty."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        owner, left, right = [], [], []
        for i, (p, q) in enumerate(zip(x, y, strict=True)):
            for s in p if p is not None else []:
                for t in q if q is not None else []:
                    owner.append(i)
                    left.append(s)
                    right.append(t)
        out = np.full(len(x), -1.0)
        if owner:
            np.maximum.at(out, owner, SCORERS[name](left, right))
        return pd.Series(out).astype(object).where(out >= 0, None)

    return F.pandas_udf(run, "double")(a, b)


def near_tokens(a: Column, b: Column, least: float = 0.8) -> Column:
    """For each token of array a whether array b has one with an indel ratio of `least` or more; null where either is null."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        place: dict[tuple[str, str], int] = {}
        for p, q in zip(x, y, strict=True):
            for s in p if p is not None and q is not None else []:
                for t in q:
                    if s != t:
                        place.setdefault((s, t), len(place))
        close = indel_ratios([k[0] for k in place], [k[1] for k in place]) >= least - 1e-9 if place else np.zeros(0, bool)
        return pd.Series([None if p is None or q is None else [any(s == t or close[place[s, t]] for t in q) for s in p] for p, q in zip(x, y, strict=True)], dtype=object)

    return F.pandas_udf(run, "array<boolean>")(a, b)


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length, JVM-side; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def _edits(texts: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Levenshtein distances of texts[i] and texts[j], all pairs a letter of the longer text at a time, in 64-bit columns; -1 where both are longer than 64 letters."""
    n = np.array([len(x) for x in texts], np.int64)
    out = np.full(len(i), -1, np.int64)
    i, j = np.where(n[i] <= n[j], i, j), np.where(n[i] <= n[j], j, i)
    rows = np.flatnonzero(n[i] <= 64)
    rows = rows[np.argsort(-n[j[rows]], kind="stable")]
    if not len(rows):
        return out
    letters, codes = np.unique(_codes(texts, int(n.max()), 0xFFFFFFFF), return_inverse=True)
    if len(texts) * len(letters) > 1 << 23 and len(i) > 1:  # bits of so many letters in two halves
        for part in np.array_split(np.arange(len(i)), 2):
            used, at = np.unique(np.r_[i[part], j[part]], return_inverse=True)
            out[part] = _edits([texts[u] for u in used], at[: len(part)], at[len(part) :])
        return out
    codes = codes.reshape(len(texts), -1)
    bits = np.zeros((len(texts), len(letters)), np.uint64)
    for p in range(min(64, codes.shape[1])):
        has = np.flatnonzero(n > p)
        bits[has, codes[has, p]] |= np.uint64(1 << p)
    i, j, one = i[rows], j[rows], np.uint64(1)
    short, long, places = n[i], n[j], i * len(letters)
    last = np.where(short > 0, one << np.maximum(short - 1, 0).astype(np.uint64), np.uint64(0))
    up, down, score = np.full(len(rows), ~np.uint64(0)), np.zeros(len(rows), np.uint64), short.copy()
    bits, columns = bits.ravel(), np.ascontiguousarray(codes.T)
    for p in range(int(long.max())):
        m = np.searchsorted(-long, -p, "left")  # pairs whose longer text has the letter
        u, d, z = up[:m], down[:m], last[:m]
        x = bits[places[:m] + columns[p][j[:m]]] | d
        same = ((u + (x & u)) ^ u) | x
        less, more = u & same, d | ~(u | same)
        score[:m] += ((more & z) != 0).astype(np.int64) - ((less & z) != 0)
        more = (more << one) | one
        down[:m] = more & same
        up[:m] = (less << one) | ~(more | same)
    out[rows] = np.where(short > 0, score, long)
    return out


def edit_ratio_by_bits(a: Column, b: Column) -> Column:
    """edit_ratio, for whole batches at a time: for all pairs of few strings; only pairs of more than 64 letters each are left to the JVM."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        null = ~(x.is_valid().to_numpy(False) & y.is_valid().to_numpy(False))
        both = pa.concat_arrays([x, y]).fill_null("").dictionary_encode()
        at = both.indices.to_numpy().astype(np.int64)
        d = _edits(both.dictionary.to_pylist(), at[: len(x)], at[len(x) :])
        return pa.array(d, pa.int32(), mask=null | (d < 0))

    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.coalesce(F.arrow_udf(run, "int")(a, b), F.levenshtein(a, b)) / longer)


def set_jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays' distinct values; null where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b)))


def set_contained(a: Column, b: Column) -> Column:
    """Shared values over the smaller set; null where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def known_equal(a: Column, b: Column) -> Column:
    """1 or 0; null where either string is empty."""
    return F.when((a != "") & (b != ""), (a == b).cast("int"))


def length_ratio(a: Column, b: Column) -> Column:
    x, y = F.length(a), F.length(b)
    return F.least(x, y) / F.greatest(x, y, F.lit(1))


def _met(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row and value of each entry of the maps a, the value of its key in the same row's map of b or NaN, row and value of each entry of b)."""
    rows, values, n = [], [], len(a)
    for m in (a, b):
        ends = m.offsets.to_numpy().astype(np.int64)
        rows.append(np.repeat(np.arange(n), np.diff(ends)))
        values.append(m.items.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False))
    keys = [m.keys.slice(m.offsets[0].as_py(), len(r)) for m, r in zip((a, b), rows, strict=True)]
    code = pa.concat_arrays(keys).dictionary_encode()
    at = code.indices.to_numpy().astype(np.int64) + np.concatenate(rows) * max(1, len(code.dictionary))
    mine, theirs = at[: len(rows[0])], at[len(rows[0]) :]
    by = np.argsort(theirs, kind="stable")
    place = np.searchsorted(theirs[by], mine)
    found = np.full(len(mine), np.nan)
    there = place < len(theirs)
    there[there] = theirs[by][place[there]] == mine[there]
    found[there] = values[1][by][place[there]]
    return rows[0], values[0], found, rows[1], values[1]


def _doubles(x: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.array(x, pa.float64(), mask=null)


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of two maps from term to weight, for whole batches at a time; null where either map is null."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        row, v, w, _, _ = _met(x, y)
        null = ~(x.is_valid().to_numpy(False) & y.is_valid().to_numpy(False))
        return _doubles(np.bincount(row, v * np.where(np.isnan(w), 0.0, w), len(x)), null)

    return F.arrow_udf(run, "double")(a, b)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Weight of the shared terms over that of all, of two maps from term to weight, for whole batches at a time; null for 0 over 0."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        row, v, w, other, u = _met(x, y)
        both = np.bincount(row, np.where(np.isnan(w), 0.0, v), len(x))
        union = np.bincount(row, v, len(x)) + np.bincount(other, u, len(x)) - both
        null = ~(x.is_valid().to_numpy(False) & y.is_valid().to_numpy(False)) | ~(union > 0)
        return _doubles(both / np.where(union > 0, union, 1.0), null)

    return F.arrow_udf(run, "double")(a, b)


def _telling(n: Column) -> Column:
    """The numbers of two digits or more; all of them where there are none."""
    long = F.filter(n, lambda x: F.length(x) > 1)
    return F.when(F.size(long) > 0, long).otherwise(n)


def number_features(a: Column, b: Column) -> Column:
    """Struct of house-number comparisons of two arrays of digit strings; all null where either is null or empty.

    Numbers of two digits or more count, or all where there are none: longest_eq, longest_in, best_ratio (indel ratio of
    digit strings), min_reldiff (smallest relative difference on the first twelve digits, at most 1) and prefix (a number
    begins with a different one).
    """
    p, q = _telling(a), _telling(b)
    there = (F.size(a) > 0) & (F.size(b) > 0)
    longest = lambda n: F.array_max(F.transform(n, lambda x: F.struct(F.length(x).alias("l"), x.alias("x"))))["x"]
    value = lambda x: F.substring(x, 1, 12).cast("long")
    apart = lambda x, y: F.abs(value(x) - value(y)) / F.greatest(value(x), value(y), F.lit(1))
    nearest = F.array_min(F.transform(p, lambda x: F.array_min(F.transform(q, lambda y: F.when(x == y, 0.0).otherwise(apart(x, y))))))
    begins = F.exists(p, lambda x: F.exists(q, lambda y: (x != y) & (x.startswith(y) | y.startswith(x))))
    as_double = lambda c: F.when(there, c.cast("double"))
    return F.struct(
        as_double(longest(p) == longest(q)).alias("longest_eq"), as_double(F.array_contains(q, longest(p))).alias("longest_in"), best_score("indel_ratio", p, q).alias("best_ratio"),
        as_double(F.least(nearest, F.lit(1.0))).alias("min_reldiff"), as_double(begins).alias("prefix"),
    )


def covered(tokens: Column, flags: Column, weights: Column) -> list[Column]:
    """(share of the tokens' weight that is flagged, largest weight that isn't, number that aren't), of parallel arrays; null where tokens are empty.

    weights: a map from token to weight; a token it lacks weighs as much as its heaviest.
    """
    rare = F.array_max(F.map_values(weights))
    each = F.zip_with(tokens, flags, lambda t, f: F.struct(f.alias("f"), F.coalesce(F.try_element_at(weights, t), rare, F.lit(0.0)).alias("w")))
    total = F.aggregate(each, F.lit(0.0), lambda s, x: s + x["w"])
    found = F.aggregate(each, F.lit(0.0), lambda s, x: s + F.when(x["f"], x["w"]).otherwise(0.0))
    missed = F.filter(each, lambda x: ~x["f"])
    there = F.size(tokens) > 0
    return [F.when(there & (total > 0), found / total), F.when(there, F.coalesce(F.array_max(F.transform(missed, lambda x: x["w"])), F.lit(0.0))), F.when(there, F.size(missed).cast("double"))]


# ---- the same in SQL, for checks


def sql_lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two columns: rows of the table, one letter of b after the other, folded by list_reduce."""
    marks = f"list_transform(string_split({b}, ''), lambda c: list_transform(string_split({a}, ''), lambda x: (x = c)::integer))"
    step = f"list_transform(range(1, length({a}) + 2), lambda j: greatest(row_[j], coalesce(list_max(list_transform(range(1, j), lambda i: case when m[i] = 1 then row_[i] + 1 else 0 end)), 0))::integer)"
    first = f"[list_transform(range(length({a}) + 1), lambda i: 0::integer)]"
    return f"case when {a} = '' or {b} = '' then 0 else list_reduce(list_concat({first}, {marks}), lambda row_, m: {step})[-1] end"


def sql_indel(a: str, b: str) -> str:
    return f"case when length({a}) + length({b}) = 0 then 1.0 else 2.0 * ({sql_lcs(a, b)}) / (length({a}) + length({b})) end"


def sql_token_sets(name: str, source: str, a: str, b: str) -> str:
    """CTE NAME(all columns of source, tset): the token set ratio of its columns a and b."""
    words = lambda c: f"list_sort(list_distinct(list_filter(string_split({c}, ' '), lambda t: t != '')))"
    less = lambda x, y: f"array_to_string(list_sort(list_filter({x}, lambda t: not list_contains({y}, t))), ' ')"
    return f"""{name}_w as (select *, {words(a)} as _x, {words(b)} as _y from {source}),
{name}_s as (select *, array_to_string(list_sort(list_filter(_x, lambda t: list_contains(_y, t))), ' ') as _c, {less('_x', '_y')} as _l, {less('_y', '_x')} as _r from {name}_w),
{name}_j as (select *, trim(_c || ' ' || _l) as _p, trim(_c || ' ' || _r) as _q from {name}_s),
{name} as (select * exclude (_x, _y, _c, _l, _r, _p, _q), case when len(_x) = 0 or len(_y) = 0 then 0.0 when _c != '' and (_l = '' or _r = '') then 1.0
when _c = '' then {sql_indel('_p', '_q')} else greatest({sql_indel('_p', '_q')}, {sql_indel('_c', '_p')}, {sql_indel('_c', '_q')}) end as tset from {name}_j)"""
