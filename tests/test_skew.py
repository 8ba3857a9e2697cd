import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from recordweave.operators.components import components
from recordweave.operators.frequency import matching_values, percentiles, profile
from recordweave.operators.positions import running_sum, top_n


def hot(spark, n=3000, seed=1):
    r = random.Random(seed)
    rows = [("hot" if r.random() < 0.6 else r.choice(["a", "b", None, ""]), r.choice([None, "x", "y", f"v{r.randint(0, 400)}"])) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "k string, v string").repartition(7)


def test_profile_against_brute_force(spark):
    rows, df = hot(spark)
    want = {}
    for k in {k for k, _ in rows}:
        vs = [v for q, v in rows if q == k]
        c = Counter(v for v in vs if v is not None)
        mode = min(c, key=lambda v: (-c[v], v)) if c else None
        want[k] = (len(vs), sum(c.values()), len(c), mode, c[mode] if c else 0)
    assert {r.k: tuple(r)[1:] for r in profile(df, ["k"], "v").collect()} == want


def test_profile_edges(spark):
    assert profile(spark.createDataFrame([], "k string, v string"), ["k"], "v").count() == 0
    df = spark.createDataFrame([("k", None), ("k", None)], "k string, v string")
    assert [tuple(r) for r in profile(df, ["k"], "v").collect()] == [("k", 2, 0, 0, None, 0)]
    clash = spark.createDataFrame([("k", "x", 1)], "k string, v string, _n int")
    assert profile(clash, ["k"], "v").first().mode_rows == 1


def test_percentiles_against_brute_force(spark):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.7 else r.choice(["a", None]), r.choice([None, *range(50)])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    by = defaultdict(list)
    for k, v in rows:
        if v is not None:
            by[k].append(v)
    import math

    want = {k: tuple(sorted(v)[max(0, math.ceil(p * len(v)) - 1)] for p in (0.25, 0.5, 0.99)) for k, v in by.items()}
    got = {x.k: tuple(x)[1:] for x in percentiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.99}).collect()}
    assert got == want
    assert percentiles(df.limit(0), ["k"], "v", {"a": 0.5}).count() == 0


def test_matching_values_counts_copies(spark):
    a = spark.createDataFrame([("u", "x")] * 3 + [(None, "x"), ("u", None)], "k string, v string")
    b = spark.createDataFrame([("u", "x")] * 4 + [(None, "x"), ("u", None), ("w", "x")], "k string, v string")
    assert sorted(map(str, matching_values(a, b, ["k"], "v").collect())) == sorted(["Row(k='u', v='x', n_left=3, n_right=4, n_pairs=12)", "Row(k=None, v='x', n_left=1, n_right=1, n_pairs=1)"])


def test_top_n_with_one_group_of_most_rows(spark):
    r = random.Random(3)
    rows = [(0 if r.random() < 0.8 else r.randint(1, 5), r.randint(0, 20), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g int, s int, i int").repartition(6)
    got = sorted(tuple(x) for x in top_n(df, ["g"], [F.col("s").desc(), F.col("i")], 7).collect())
    want = []
    for g in {x[0] for x in rows}:
        for p, x in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))[:7], 1):
            want.append((*x, p))
    assert got == sorted(want)


def test_top_n_null_groups_repeats_and_names(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", 2)], "g string, s int")
    assert sorted(map(str, (tuple(x) for x in top_n(df, ["g"], [F.col("s")], 1).collect()))) == sorted(["(None, 1, 1)", "('a', 2, 1)"])
    assert top_n(df.limit(0), ["g"], [F.col("s")], 3).count() == 0
    with pytest.raises(ValueError):
        top_n(df.withColumn("position", F.lit(1)), ["g"], [F.col("s")], 1)


def test_running_sum(spark):
    df = spark.createDataFrame([("a", i, 2) for i in range(100)] + [("b", 1, None)], "g string, o int, w int").repartition(5)
    got = {(r.g, r.o): r.running for r in running_sum(df, ["g"], [F.col("o")], "w").collect()}
    assert got == {**{("a", i): 2 * (i + 1) for i in range(100)}, ("b", 1): 0}


def test_components_against_union_find(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (3, 4), (4, 3)] + [(2000, 2001 + i) for i in range(60)]
    parent: dict[int, int] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges + [(None, 1)], "a long, b long")
    got = {x.node: x.component for x in components(df).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(df.limit(0)).count() == 0
