import math

from pyspark.sql import functions as F

from riskloom.functions import scalars as S


def one(df):
    return [tuple(r) for r in df.collect()]


def test_ieee_division(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 2.0), (2.0, None), (6.0, 3.0)], "a double, b double")
    got = [r[0] for r in one(df.select(S.ieee_div("a", "b")))]
    assert got == [math.inf, -math.inf, None, None, None, 2.0]


def test_row_mean_and_std(spark):
    rows = [(None, None, None), (2.0, None, None), (1.0, 3.0, None), (1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = one(df.select(S.row_mean(["a", "b", "c"]), S.row_std(["a", "b", "c"])))
    assert got == [(None, None), (2.0, None), (2.0, math.sqrt(2.0)), (2.0, 1.0)]


def test_fill_with_mean(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "a double")
    assert sorted(r[0] for r in one(S.fill_with_mean(df, "a"))) == [1.0, 2.0, 3.0]


def test_text_parsing(spark):
    df = spark.createDataFrame([(" 36 months",), ("10 years",), ("none",), (None,)], "t string")
    assert [r[0] for r in one(df.select(S.leading_int("t")))] == [36, 10, None, None]
    years = spark.createDataFrame([("Jan-1999",), ("x",), (None,)], "t string")
    assert [r[0] for r in one(years.select(S.trailing_year("t")))] == [1999, None, None]


def test_remap_and_sentinel(spark):
    df = spark.createDataFrame([("NONE", 365243), ("RENT", 5), (None, None)], "h string, d int")
    got = one(df.select(S.remap("h", {"NONE": "OTHER", "ANY": "OTHER"}), S.sentinel_to_null("d", 365243)))
    assert got == [("OTHER", None), ("RENT", 5), (None, None)]


def test_bands_treat_missing_as_no(spark):
    df = spark.createDataFrame([(0,), (1,), (119,), (120,), (None,)], "d int")
    got = one(df.select(*[c.alias(n) for n, c in S.overdue_bands("d", "P").items()]))
    assert got == [(0, 0, 0), (1, 1, 0), (1, 1, 0), (1, 0, 1), (0, 0, 0)]


def test_log_and_midpoint(spark):
    df = spark.createDataFrame([(99.0, 4.0), (-1.0, 6.0), (None, None)], "x double, y double")
    assert one(df.select(S.log10_plus1("x"), S.midpoint("y", F.col("y") + 4))) == [(2.0, 6.0), (None, 8.0), (None, None)]


def test_nan_scrubbed(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (1.0, "b")], "x double, t string")
    assert one(S.scrub_nan(df)) == [(None, "a"), (1.0, "b")]


def test_literals_survive_quotes(spark):
    df = spark.createDataFrame([("it's",), ("a\\b",)], "t string")
    for v in ("it's", "a\\b"):
        assert df.filter(f"t = {S.literal(v)}").count() == 1
