from pyspark.sql import functions as F

from recordweave.operators.packed import explode_packed, unpack

ID = r"S\d-"


def lists(spark, texts, **how):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(unpack(F.col("t"), **how)).collect()]


def test_delimiters_quotes_and_brackets(spark):
    a, b = "S2-00000001", "S3-00000002"
    texts = [f"{a},{b}", f" {a} ; {b} ", f"{a}|{b}", f"{a} / {b}", f"{a}\t{b}", f"{a}\n{b}", f"{a}，{b}", f"{{{a},{b}}}", f'["{a}", "{b}"]', f"['{a}','{b}']", f"“{a}”,“{b}”", f'"{a};{b}"', f'"{a}, {b}"', f'{a}; "{b}"', f"{a} {b}"]
    assert all(x == [a, b] for x in lists(spark, texts, item=ID))


def test_quoted_id_with_delimiter(spark):
    assert lists(spark, ['S2-00000001,"S3-00000002,17"', '"S3-00000002|9"', '["S2-00000001","S3-00000002;7"]', '"S2-00000001,S3-00000002"'], item=ID) == [["S2-00000001", "S3-00000002,17"], ["S3-00000002|9"], ["S2-00000001", "S3-00000002;7"], ["S2-00000001", "S3-00000002"]]


def test_doubled_quotes(spark):
    texts = ['"S2-00426016,""S3-00155791,16"""', '"""S2-00000001"",""S3-00000002,16"""', '"S2-00000001,"', '"S2-00000001""S2-00000002"', '"S2-00000001,S2-00000002,""S3-00000003;4"",S2-00000005"', '"",S2-00000001', '"S2-00000001""S2-00000002']
    a, b = "S2-00000001", "S2-00000002"
    assert lists(spark, texts, item=ID) == [["S2-00426016", "S3-00155791,16"], [a, "S3-00000002,16"], [a], [a, b], [a, b, "S3-00000003;4", "S2-00000005"], [a], [a, b]]
    assert lists(spark, ['"a ""b"" c",d', '"a""', '""""', '"";x']) == [['a "b" c', "d"], ["a"], ['"'], ["x"]]


def test_empty_and_placeholders(spark):
    assert lists(spark, [None, "", "  ", "null", "-", '""', "[]", ",", "a,,b", "a, ,b", "a,null,-,b", "None", "n/a"]) == [[], [], [], [], [], [], [], [], ["a", "b"], ["a", "b"], ["a", "b"], [], ["n", "a"]]


def test_repeats_and_unclosed_quotes(spark):
    assert lists(spark, ["a,a,b,a", '"a,b', 'x,"a b"']) == [["a", "a", "b", "a"], ["a", "b"], ["x", "a b"]]


def test_very_long_list(spark):
    assert len(lists(spark, [",".join(f"v{i}" for i in range(20_000))])[0]) == 20_000


def test_positions_keep_other_columns_and_rows(spark):
    df = spark.createDataFrame([("k", "x;y", 1), ("k", "x;y", 1), ("e", None, 2)], "key string, packed string, _n int")
    rows = sorted(map(tuple, explode_packed(df, "packed", "value").collect()))
    assert rows == [("k", 1, 1, "x"), ("k", 1, 1, "x"), ("k", 1, 2, "y"), ("k", 1, 2, "y")]
    assert explode_packed(df.limit(0), "packed", "value").count() == 0


def test_clashing_names(spark):
    import pytest

    df = spark.createDataFrame([("a", 1)], "packed string, list_pos int")
    with pytest.raises(ValueError):
        explode_packed(df, "packed", "value")
