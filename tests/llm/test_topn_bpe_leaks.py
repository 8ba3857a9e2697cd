import random

import pytest
from pyspark.sql import functions as F

from recordweave.llm import bpe, leaks, topn

SCORES = ["sim_a", "sim_b"]
NAN = float("nan")


def test_best_candidates_rules(spark):
    rows = [(1, 2, 5, 0.5, NAN), (1, 2, 5, 0.9, None), (1, 3, 1, 0.9, 0.1), (1, 2, 7, NAN, 0.9), (1, 2, 8, NAN, None), (1, 2, 9, 0.2, 0.3), (None, 2, 1, 0.1, None), (2, 2, 1, None, NAN)]
    df = spark.createDataFrame(rows, "g int, src int, r int, sim_a float, sim_b float").withColumn("extra", F.lit("x"))
    got = sorted((str(x.g), x.position, x.src, x.r) for x in topn.best_candidates(df, "g", ["src", "r"], SCORES, 3).collect())
    assert got == [("1", 1, 2, 5), ("1", 2, 2, 7), ("1", 3, 3, 1), ("None", 1, 2, 1)]
    assert topn.best_candidates(df.limit(0), "g", ["src", "r"], SCORES, 3).count() == 0


def test_best_candidates_of_a_hot_group(spark):
    r = random.Random(1)
    rows = [(0 if r.random() < 0.7 else r.randint(1, 9), 2, r.randint(0, 800), round(r.random(), 1), None) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g int, src int, r int, sim_a double, sim_b double").repartition(5)
    best = {}
    for g, s, i, a, _ in rows:
        best[g, s, i] = max(a, best.get((g, s, i), -1))
    want = set()
    for g in {x[0] for x in rows}:
        for p, (_, s, i) in enumerate(sorted((-v, s, i) for (q, s, i), v in best.items() if q == g)[:5], 1):
            want.add((g, s, i, p))
    assert {(x.g, x.src, x.r, x.position) for x in topn.best_candidates(df, "g", ["src", "r"], SCORES, 5).collect()} == want


TEXTS = [None, "", " ", "Hello, world! don't I'll", "ß ẞ ﬁ Ünïcödé", "日本語 दोहरे पते 🙂🙂", "<|endoftext|> x", "a" * 3000, "ab" * 2000 + "  \n\n x", "\ud83d" if False else "tab\tand\r\nline", " ".join(["the quick brown fox"] * 500)]


def test_ids_equal_the_public_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    r = random.Random(2)
    texts = TEXTS + ["".join(r.choice("abcdeé 12'\n日ि") for _ in range(r.randint(1, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("x"))
    got = {x.doc_id: list(x.ids) for x in bpe.corpus_ids(df).collect()}
    for i, s in enumerate(texts):
        assert got[i] == (t.encode(s, add_special_tokens=False).ids if s else []), s
    assert bpe.corpus_ids(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        bpe.encode_column(df.withColumn("ids", F.lit(1)))


def test_merge_is_the_plain_rule():
    ranks = bpe.read_ranks(bpe.vocabulary_path())

    def plain(p):
        parts = [p[i : i + 1] for i in range(len(p))]
        while True:
            best = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                return [ranks[x] for x in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    r = random.Random(3)
    for _ in range(300):
        p = bytes(r.choice(b"aabcdetsnr ") for _ in range(r.randint(1, 40)))
        assert bpe.merge(p, ranks) == plain(p)


def brute(docs, items, least):
    out = set()
    grams = {}
    for i, t in items:
        w = leaks.words(t)
        for k in range(len(w) - least + 1):
            grams.setdefault(tuple(w[k : k + least]), set()).add(i)
    for d, t in docs:
        w = leaks.words(t)
        for k in range(len(w) - least + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + least]), ())}
    return out


def test_leaks_against_brute_force(spark):
    r = random.Random(4)
    vocab = ["a", "b", "c", "Straße", "é", "x1"]
    passage = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, passage(r.randint(2, 12))) for i in range(20)] + [(50, None), (51, "")]
    docs = [(d, passage(r.randint(0, 25))) for d in range(150)] + [(900, None), (901, ""), (902, "  "), (903, items[0][1]), (904, items[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    it = spark.createDataFrame(items, "item_id int, text string")
    for least in (3, 5):
        got = leaks.find_leaks(df, it, least, shard_rows=40).collect()
        assert {(x.doc_id, x.item_id) for x in got} == brute(docs, items, least)
        assert set(leaks.find_leaks(df, it, least, shard_rows=40, block_items=4).collect()) == set(got)
        for x in got[:40]:  # the longest match stands where it is said to
            d, i = leaks.words(dict(docs)[x.doc_id]), leaks.words(dict(items)[x.item_id])
            assert d[x.doc_word : x.doc_word + x.n_words] == i[x.item_word : x.item_word + x.n_words]


def test_words_of_one_form():
    assert leaks.words("STRASSE, é!") == leaks.words("straße É") and leaks.words(None) == []


def test_leaks_of_long_and_empty_tables(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "z " * 100_000 + item), (2, "z")], "doc_id long, text string")
    it = spark.createDataFrame([(7, item)], "item_id int, text string")
    assert [tuple(x) for x in leaks.find_leaks(docs, it).collect()] == [(1, 7, 30, 100_000, 0)]
    assert leaks.find_leaks(docs, it.limit(0)).count() == 0 and leaks.find_leaks(docs.limit(0), it).count() == 0
    assert [x.doc_id for x in leaks.remove_leaks(docs, leaks.find_leaks(docs, it)).collect()] == [2]
