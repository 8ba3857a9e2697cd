import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recordweave.llm import locations, matching, segments, spellings
from recordweave.llm.names import edits
from recordweave.llm.segments import similar


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@pytest.mark.parametrize("hot", [3000, 25])
def test_segment_join_against_brute_force(spark, hot):
    r = random.Random(hot)
    ws = ["".join(r.choice("abcd") for _ in range(r.randint(1, 10))) for _ in range(300)] + ["aaaaaa" + "".join(r.choice("abcd") for _ in range(4)) for _ in range(80)]
    df = spark.createDataFrame([(i, w, 0, 2) for i, w in enumerate(ws)] + [(-1, None, 0, 2)], "id long, s string, bucket int, k int")
    want = {(i, j) for j in range(len(ws)) for i in range(j) if lev(ws[i], ws[j]) <= 2 and (ws[i] == ws[j] or min(len(ws[i]), len(ws[j])) > 2)}
    assert {(x.a, x.b) for x in similar(df, hot=hot).collect()} == want
    assert similar(df.limit(0)).count() == 0


def people(spark, rows):
    return spark.createDataFrame(rows, "entity_id string, business_name string").withColumn("class", F.lit(1)).withColumn("node", F.lit(2))


def test_spellings(spark):
    same = ["Kutudem Buvapos Manufacturing Pvt Ltd", "KUTUD3M BUVAPOS MFG", "www.kutubuvapos.example", "K. Buvapos Manufacturing", "Buvapos Kutudem & Co", "Kutudm Buvapso Ltd", "Kutudem Buvapos t/a Luleo"]
    other = ["Kutudem Tolames Ltd", "Kiteshor Duriner Inc", "Kiteshor Vuriser Inc"]
    rows = [(f"S1-{i}", n) for i, n in enumerate(same + other)] + [("S2-n", None), ("S2-e", ""), ("S2-b", " "), ("S2-0", same[0]), ("S2-0", same[0])]
    got = {(x.entity_id_a, x.entity_id_b) for x in spellings.spelling_pairs(people(spark, rows)).collect()}
    ids = [f"S1-{i}" for i in range(len(same))]
    want = {(a, b) for a in ids for b in ids if a < b} | {(a, "S2-0") for a in ids if a != "S1-0"}
    assert got == want
    assert spellings.spelling_pairs(people(spark, rows).limit(0)).count() == 0


def test_spellings_of_a_hot_name(spark):
    rows = [(f"S1-{i:03d}", "Kutudem Buvapos Ltd") for i in range(200)] + [("S2-x", "Kutudem Buvapos Limited")]
    got = spellings.spelling_pairs(people(spark, rows)).collect()
    assert len(got) == 200 and {x.entity_id_b for x in got} == {"S2-x"}


def places(spark, rows):
    return spark.createDataFrame(rows, "entity_id string, business_address string, postal string").withColumn("location", F.lit("x"))


def test_locations(spark):
    rows = [
        ("S1-1", "6776 Nemitim Kujolin Lane, Sishin, Tirisland", None), ("S1-2", "6776 Nemitim Kujolin Ln, Apt 22, Sishin, TD", None), ("S2-1", "TD; SISHIN; 06776 Nemtim Kujolin Ln", ""), ("S3-1", "6776 Nemitim Kujolin Ln", None),
        ("S1-3", "6777 Nemitim Kujolin Lane, Sishin, TD", None), ("S1-4", "12 Church Street, Sishin, TD", None), ("S1-5", "12 Church Street, Rasho, LA 40155", "40155"), ("S3-2", "12 Church St", "40155"), ("S3-3", "12 Church St", None), ("S3-4", "", "1"), ("S3-5", None, None), ("S3-6", "Sishin", None), ("S1-1", "6776 Nemitim Kujolin Lane, Sishin, Tirisland", None),
    ]
    df = places(spark, rows)
    got = {(x.entity_id_a, x.entity_id_b) for x in locations.location_pairs(df, clean=df.filter("entity_id like 'S1%'")).collect()}
    one = ["S1-1", "S1-2", "S2-1", "S3-1"]
    assert got == {(a, b) for a in one for b in one if a < b} | {("S1-5", "S3-2")}
    assert locations.location_pairs(df.limit(0)).count() == 0


CONS, VOWELS = "bdgjklmnprstv", "aeiou"


def world(seed=1, n=120):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice(CONS) + r.choice(VOWELS) for _ in range(k)) + r.choice("lmnrs")
    s1, s2, truth = [], [], []
    for i in range(n):
        a, b, st, town = word(3), word(3), f"{word(3)} {word(3)}", word(2)
        num = r.randint(1, 9999)
        s1.append((f"S1-{i:04d}", f"{a.title()} {b.title()} Foods Ltd", f"{num} {st.title()} Road, {town.title()}, Leda"))
        s2.append((f"S2-{i:04d}", f"{a.upper()} {b.upper()} FDS", f"{num} {st} rd, {town}"))
        s2.append((f"S3-{i:04d}", f"{b.title()} {a[:4].title()}", f"No {num}, {st[1:]} Rd"))
        s2.append((f"S3-x{i:03d}", f"{a.title()} {b.title()} Foods", f"{num + 3} {st.title()} Road, {town.title()}"))
        truth += [(f"S1-{i:04d}", f"S2-{i:04d}"), (f"S1-{i:04d}", f"S3-{i:04d}")]
    s2 += [("S2-m", s1[0][1], None), ("S2-n", None, s1[1][2]), ("S2-0", None, ""), ("S2-e", "", None), ("S2-m", s1[0][1], None)]
    return s1, s2, truth + [("S1-0000", "S2-m"), ("S1-0001", "S2-n")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "entity_id string, business_name string, business_address string").withColumn("pid", F.lit("x"))


def test_matching_finds_the_pairs(spark):
    s1, s2, truth = world()
    t = spark.createDataFrame(truth, "source1_entity_id string, matched_entity_id string")
    labels = (frame(spark, s1), frame(spark, s2), t)
    got = matching.match(frame(spark, s1), frame(spark, s2), labels, matching.Plan(fit_records=400)).collect()
    pairs = {(x.source1_entity_id, x.matched_entity_id) for x in got}
    assert len({x.matched_entity_id for x in got}) == len(got) and all(0.5 <= x.confidence <= 1 for x in got)
    assert len(pairs & set(truth)) >= 0.97 * len(truth) and len(pairs - set(truth)) <= 2


def test_matching_of_nothing(spark):
    s1, s2, _ = world(2, 5)
    assert matching.match(frame(spark, s1).limit(0), frame(spark, s2)).count() == 0
    assert matching.match(frame(spark, s1), frame(spark, s2).limit(0)).count() == 0


def test_index_recall_against_brute_force(spark):
    """Every hundredth... every source1 profile against all records: pairs of high cosine in one house number must be candidates."""
    s1, s2, _ = world(3, 200)
    plan = matching.Plan(fit_records=400)
    idx = matching.candidates(frame(spark, s1), frame(spark, s2), plan)
    p = idx.shapes.toPandas()
    v = idx.vectors.value
    nm = np.stack([v.of(matching.name_tokens(list(w))) for w in p.words])
    st = np.stack([v.of(matching.street_tokens(s)) for s in p.street])
    near = []
    for i in np.flatnonzero(p.one & p.number.notna()):
        same = np.flatnonzero((p.number == p.number[i]).to_numpy())
        near += [(p.pid[i], p.pid[j]) for j in same if j != i and nm[i] @ nm[j] >= 0.7 and st[i] @ st[j] >= 0.7 and p.other[j]]
    found = set(map(tuple, idx.pairs.select("s1", "other").toPandas().to_numpy().tolist()))
    assert len(near) > 100 and sum(x in found for x in near) >= 0.9 * len(near)


def test_walk_vectors_of_empty_rows():
    assert len(matching.walk_vectors(pd.DataFrame({"words": [[]], "number": [None], "street": [None], "towns": [[]]}), matching.Plan())) == 0


def test_calibration_separates():
    r = np.random.default_rng(1)
    y = r.integers(0, 2, 500).astype(float)
    x = np.stack([np.ones(500), y * 0.6 + r.random(500) * 0.5], 1)
    w = matching.calibrate(x, y)
    p = 1 / (1 + np.exp(-x @ w))
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.9


def test_edits_equal_the_table_of_distances():
    r = random.Random(5)

    def table(a, b):  # distances with swaps of neighbours, cell by cell
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    for letters in ("ab", "abcdef"):
        for _ in range(1500):
            a = [r.choice(letters) for _ in range(r.randint(0, 9))]
            b = [x if r.random() < 0.8 else r.choice(letters) for x in a if r.random() < 0.9]
            i = r.randint(0, len(b))
            b[i : i + 2] = b[i : i + 2][::-1]
            a, b = "".join(a), "".join(b)
            for most in (0, 1, 2, 5):
                assert edits(a, b, most) == min(table(a, b), most + 1), (a, b)


def test_pairs_that_no_name_can_save_are_left_out_and_no_other(spark):
    r = np.random.default_rng(2)
    cn, cs, s = r.random(400), r.random(400), r.choice([-1.0, 0.0, 0.1, 0.5, 0.9, 1.0], 400)
    left = matching.hopeful(cn, cs, s, matching.DEFAULT, 0.03)
    best = np.max([matching.vector(cn, cs, np.full(400, n), s) @ matching.DEFAULT for n in [-1.0, *np.linspace(0, 1, 41)]], axis=0)
    assert (left == (1 / (1 + np.exp(-best)) >= 0.03)).all() and 0 < left.sum() < 400
    two = spark.createDataFrame([(i, ["kutudem", "buvapos"], ["kutudem", "buvapos"], [], "12", st, st, []) for i, st in ((1, "gosibagashamor"), (2, "gosibagashamor"), (3, "luleotirim"))], "pid long, " + matching.FIELDS)
    pairs = spark.createDataFrame([(1, 2, 0.9, 0.9), (1, 3, 0.9, 0.3)], "s1 long, other long, cos_name double, cos_street double")
    whole = {x.other: x for x in matching.features(pairs, two).collect()}
    few = matching.features(pairs, two, (matching.DEFAULT, 0.5 / 16)).collect()
    assert set(whole) == {2, 3} and few == [whole[2]]


def test_rows_are_added_place_by_place():
    r = np.random.default_rng(1)
    at, rows, m = r.integers(0, 9, 200), r.random((200, 4)), np.zeros((9, 4))
    want = m.copy()
    np.add.at(want, at, rows)
    matching.add_rows(m, at, rows)
    matching.add_rows(m, at[:0], rows[:0])
    assert (m == want).all()


def test_places_of_segments_are_worked_out_once_a_length(spark):
    df = spark.createDataFrame([("abcdefg", 2, True), ("xyz", 1, False), ("", 1, False)], "s string, k int, wide boolean")
    got = {(x.k, x.n, x.wide): {tuple(g) for g in x.g} for x in segments._shapes(df).collect()}
    assert set(got) == {(k, n, w) for k, most in ((2, 7), (1, 3)) for n in range(most + 1) for w in (True, False)}
    assert got[1, 3, False] == {(2, 0, 0, 1), (2, 1, 2, 1), (3, 0, 0, 1), (3, 1, 1, 2)}
