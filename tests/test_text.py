import pytest
from pyspark.sql import functions as F

from recordweave.functions import strings as S
from recordweave.functions import text as X
from recordweave.functions.translit import fold, romanise


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (X.phonetic, "good trading", "kt trtnk"),
        (X.phonetic, "gud treding", "kt trtnk"),
        (X.phonetic, "purotyuchar", "prtsr"),
        (X.clean_name, "c0rp g1oba 5ervices 123", "corp globa services 123"),
        (X.clean_name, "pra li", "pvt ltd"),
        (X.clean_name, "Acme Corporation Private Limited", "acme corp pvt ltd"),
        (X.clean_name, "www.kemp-globa.com", "kemp globa"),
        (X.clean_name, None, ""),
        (X.base_clean, "  Çà & Là... n/a NULL ", "ca and la n a"),
        (X.base_clean, "", ""),
        (X.clean_address, "H.No 12, North Street 560001", "12 n st 560001"),
        (X.clean_address, "0201 Main", "201 mn"),
        (lambda c: X.core_of(X.clean_name(c)), "The Company", "the co"),
        (lambda c: X.core_of(X.clean_name(c)), "Acme Ltd", "acme"),
        (X.name_variants, "Foo Ltd d/b/a Bar", ["foo ltd", "bar"]),
        (X.name_variants, None, []),
        (X.postal, "12 n st 560001", "560001"),
        (X.numbers, "12 n st 560001 12", ["12", "560001"]),
        (X.whole_name, "Foo Ltd d/b/a Bar", "foo ltd bar"),
        (X.whole_name, "निजागु कंपनी", "nijagu kanpani"),
        (X.clean_address, "१२ निजागु", "12 nijagu"),
        (X.romanised, "निजागु", "nijagu"),
        (X.romanised, None, None),
    ],
)
def test_examples(spark, f, given, want):
    assert one(spark, f, given) == want


def test_very_long_text(spark):
    assert len(one(spark, X.base_clean, "Ab, " * 200_000)) == 600_000 - 1


def test_romanise():
    assert romanise("कंपनी") == "kanpani" and romanise("abc") == "abc" and romanise("१२") == "12"
    assert fold("Élysée") == "Elysee" and fold(None) is None


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_ratios_against_brute_force():
    import random

    r = random.Random(1)
    a, b = (["".join(r.choice("abc é") for _ in range(r.randint(0, r.choice([4, 12, 90])))) for _ in range(300)] for _ in range(2))
    assert S.lcs_lengths(a, b).tolist() == [lcs(x, y) for x, y in zip(a, b, strict=True)]

    def partial(x, y):
        s, t = sorted((x, y), key=len)
        windows = [t[max(0, i) : i + len(s)] for i in range(1 - len(s), len(t))] if s else []
        return max((2 * lcs(s, w) / (len(s) + len(w)) for w in windows if w), default=float(not t))

    assert S.partial_ratios(a[:120], b[:120]) == pytest.approx([partial(x, y) for x, y in zip(a[:120], b[:120], strict=True)])


def test_ratio_conventions():
    assert S.indel_ratios(["", "a"], ["", ""]).tolist() == [1, 0]
    assert S.token_set_ratios(["a b", "", "a b x"], ["b a c", "a", "a b y"]).tolist() == pytest.approx([1, 0, 2 * 4 / 10])
    assert S.token_sort_ratios(["b a"], ["a b"])[0] == 1
    assert S.jaro_winklers(["martha", "", "", "dixon", "a"], ["marhta", "", "a", "dicksonx", "b"]).tolist() == pytest.approx([0.961111, 1, 0, 0.813333, 0], abs=1e-6)


def test_array_scores(spark):
    df = spark.createDataFrame([(["foo ltd", "bar"], ["bar"], {"foo": 2.0, "bar": 1.0}, {"bar": 3.0}), ([], ["x"], {}, {}), (None, ["x"], None, {"a": 1.0})], "a array<string>, b array<string>, m map<string,double>, n map<string,double>")
    rows = df.select(
        S.best_score("token_set_ratio", F.col("a"), F.col("b")).alias("v"), S.near_tokens(F.col("a"), F.array(F.lit("baar"), F.lit("q"))).alias("near"), S.sparse_dot(F.col("m"), F.col("n")).alias("dot"), S.weighted_jaccard(F.col("m"), F.col("m")).alias("wj"),
        F.array(*S.covered(F.array(F.lit("foo"), F.lit("zip")), F.array(F.lit(True), F.lit(False)), F.col("m"))).alias("cov"),
    ).collect()
    assert rows[0].v == 1 and rows[0].near == [False, True] and rows[0].dot == 3 and rows[0].wj == 1 and rows[0].cov == [0.5, 2.0, 1.0]
    assert rows[1].v is None and rows[1].near == [] and rows[1].dot == 0 and rows[1].wj is None
    assert rows[2].v is None and rows[2].near is None and rows[2].dot is None


def test_romanised_equals_the_state_machine(spark):
    import random

    r = random.Random(5)
    block = [chr(c) for c in range(0x0900, 0x0D80)]
    texts = ["".join(r.choice(block[128 * (i % 9) : 128 * (i % 9) + 128] if r.random() < 0.9 else ["a", " ", "-", "é"]) for _ in range(r.randint(1, 14))) for i in range(900)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.romanised(F.col("t")).alias("r")).collect()
    assert [x.r for x in got] == [romanise(x.t) for x in got]


def test_folded_equals_the_normal_form(spark):
    texts = ["ﬁn ﬀ №5 ½ ™ ＡＢ１ é é ç ǅ ş ạ", "plain", "", None, "Ω ß ø"]
    got = [x[0] for x in spark.createDataFrame([(t,) for t in texts], "t string").select(X.folded(F.col("t"))).collect()]
    assert got[0].replace("⁄", "/") == fold(texts[0]).replace("⁄", "/") and got[1:4] == ["plain", "", None] and got[4][1:] == " ß ø"


def test_scores_with_nulls_and_ties(spark):
    df = spark.createDataFrame([("a b", "b a", ["12", "3"], ["12"]), (None, "x", None, ["1"]), ("", "", [], [])], "a string, b string, m array<string>, n array<string>")
    rows = df.select(S.score(["indel_ratio", "token_sort_ratio"], F.col("a"), F.col("b")).alias("s"), S.set_jaccard(F.col("m"), F.col("n")).alias("j"), S.number_features(F.col("m"), F.col("n")).alias("h")).collect()
    assert rows[0].s.token_sort_ratio == 1 and rows[0].j == 0.5 and rows[0].h.longest_eq == 1 and rows[0].h.best_ratio == 1
    assert rows[1].s.indel_ratio is None and rows[1].h.prefix is None
    assert rows[2].s.indel_ratio == 1 and rows[2].j is None
