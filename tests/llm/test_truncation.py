import random

from pyspark.sql import functions as F

from recordweave.llm import truncation as T

NAMES = ["Bora", "Kelu", "Mopa", "Tiro", "Vesa", "Duna", "Fili", "Gora"]


def sentence(r):
    return r.choice([
        f"The mill sold {r.randint(2, 90)} sacks of grain to {r.choice(NAMES)} before noon.",
        f"According to {r.choice(NAMES)}, the archive repaired the old bridge during the floods.",
        f"Nobody answered the questions about spare parts in {r.choice(NAMES)}.",
    ])


def corpus(spark):
    r = random.Random(1)
    rows, cut, whole = [], set(), set()
    for i in range(1500):
        text = " ".join(sentence(r) for _ in range(r.randint(1, 6)))
        if i % 3 == 0:
            if len(text) > 120:
                text = text[:120]
                (whole if text.rstrip().endswith(".") else cut).add(i)
            rows.append((i, text, "limited"))
        elif i % 50 == 1:
            rows.append((i, text + " According to Bora, the", "free"))
            cut.add(i)
        elif i % 50 == 2:
            rows.append((i, text + " The mill sold sacks of gr…", "free"))
            cut.add(i)
        elif i % 50 == 4:
            rows.append((i, text[:-1], "free"))
            whole.add(i)
        elif i % 50 == 5:
            rows.append((i, text[:-1] + "...", "free"))
            whole.add(i)
        elif i % 50 == 7:
            rows.append((i, f"List of members {i}/{i % 7}", None))
            whole.add(i)
        else:
            rows.append((i, text, "free"))
            whole.add(i)
    rows += [(9001, None, "free"), (9002, "", "free"), (9003, "  ", None), (9004, "🙂", "free"), (9005, rows[1][1], "free")]
    return rows, cut, whole, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("at_limit", F.lit(1))


def test_finds_cut_texts(spark):
    rows, cut, whole, df = corpus(spark)
    found = T.find_truncated(df)
    got = {x.doc_id for x in found.collect()}
    assert len(got & cut) >= 0.97 * len(cut)
    assert len(got & (whole | {9001, 9002, 9003, 9004})) <= 0.01 * len(whole)
    assert (9005 in got) == (1 in got)
    rates = {x.source: x for x in T.source_rates(df, found).collect()}
    assert rates["limited"].n_cut > 0.3 * rates["limited"].n_texts and rates["free"].cut_share < 0.2 and rates[None].n_cut == 0
    limits = {(x.source, x.unit): x.at_limit for x in T.length_limits(df.filter("trim(text) != ''"), "text", "source").collect()}
    assert limits == {("limited", "chars"): 120, ("limited", "bytes"): 120}


def test_broken_words(spark):
    words = spark.createDataFrame([("October", 5), ("Oct", 1), ("पुराना", 2), ("once", 1)], "word string, n long")
    last = spark.createDataFrame([("Octo",), ("Oct",), ("Octo",), ("पुर",), ("onc",), ("October",), (None,)], "last string")
    assert sorted(x["last"] for x in T.broken_words(last, words).collect()) == ["Octo", "पुर"]
    assert T.broken_words(last, words.limit(0)).count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert T.find_truncated(df).count() == 0 and T.source_rates(df, T.find_truncated(df)).count() == 0


def test_what_stands_behind():
    assert T.strip_behind("It ended. 🙂")[1] == "ended" and T.strip_behind("It ended. [2]")[1] == "ended" and T.strip_behind("Fin. »")[1] == "ended"
    assert T.strip_behind("It was the…") == ("It was the", "dots") and T.strip_behind("was the <br")[1] == "broken" and T.strip_behind("was the")[1] == "bare"
