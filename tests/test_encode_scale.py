import math

import pytest
from pyspark.sql import functions as F

from riskloom.operators import encode, profile, scale

ROWS = [(1, "b", "x", 1), (2, None, "b", 2), (3, "a", "x", None), (4, "b", "a", 1)]


def table(spark):
    return spark.createDataFrame(ROWS, "id int, s string, t string, n int").repartition(3)


def column(df, c):
    return [r[c] for r in sorted(df.collect(), key=lambda r: r["id"])]


def test_factorize_by_first_appearance(spark):
    out = encode.factorize(table(spark), ["s", "t"], ["id"])
    assert column(out, "s") == [0, -1, 1, 0] and column(out, "t") == [0, 1, 0, 2]


def test_composite_order(spark):
    df = spark.createDataFrame([(1, 2, "p"), (1, 1, "q"), (0, 9, "r")], "a int, id int, s string")
    got = {r["s"]: r["c"] for r in encode.factorize(df.selectExpr("*", "s AS c"), ["c"], ["a", "id"]).collect()}
    assert got == {"r": 0, "q": 1, "p": 2}


def test_bag_codes_run_on_and_count_missing(spark):
    out, n = encode.bag_encode(table(spark), ["s", "n"], ["id"])
    assert column(out, "s") == [0, 1, 2, 0] and column(out, "n") == [3, 4, 5, 3] and n == 6


def test_category_codes_are_sorted(spark):
    assert column(encode.category_codes(table(spark), ["s", "t"]), "s") == [1, -1, 0, 1]


def test_encodings_agree_on_the_shuffle_way(spark, monkeypatch):
    from riskloom import session

    small = [tuple(r) for r in encode.factorize(table(spark), ["s", "t"], ["id"]).orderBy("id").collect()]
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    assert [tuple(r) for r in encode.factorize(table(spark), ["s", "t"], ["id"]).orderBy("id").collect()] == small


def test_one_hot(spark):
    out = encode.one_hot_drop_first(table(spark).drop("n"), ["s", "t"])
    assert set(out.columns) == {"id", "s_b", "t_b", "t_x"}
    assert column(out, "s_b") == [1, 0, 0, 1]
    wide = encode.one_hot_wide(table(spark), ["s"])
    assert column(wide, "s_a") == [0, 0, 1, 0] and column(wide, "s") == ["b", None, "a", "b"]


def test_more_than_200_levels(spark):
    df = spark.range(900).select("id", F.format_string("v%03d", F.col("id") % 300).alias("s"), F.lit(None).cast("string").alias("none"))
    df = df.withColumn("s", F.when(F.col("id") >= 890, None).otherwise(F.col("s")))
    named = encode.one_hot_drop_first(df, ["s"])
    assert len(named.columns) == 2 + 299 and named.agg(F.sum("s_v123")).first()[0] == 3
    for drop_first in (False, True):
        rows, names = encode.one_hot_vectors(df, ["s", "none"], drop_first)
        assert names == ["s_levels"] and rows.columns == ["id", "s", "none", "s_levels"]
        for r in rows.collect():
            at = None if r["s"] is None else int(r["s"][1:]) - drop_first
            want = [] if at is None or at < 0 else [at]
            assert r["s_levels"].size == 300 - drop_first and list(r["s_levels"].indices) == want


def test_few_and_many_levels_are_coded_alike(spark, monkeypatch):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"v'{i % 5}\\", (i % 3) / 2) for i in range(60)], "id int, s string, x double")
    found = []
    for limit in (0, 64):
        monkeypatch.setattr(encode, "CASE_LEVELS", limit)
        coded, n = encode.bag_encode(df, ["s", "x"], ["id"])
        found.append((n, sorted(map(tuple, coded.collect())), sorted(map(tuple, encode.category_codes(df, ["s", "x"]).collect()))))
    assert found[0] == found[1]


@pytest.mark.parametrize("limit", [350, 351])
def test_distinct_up_to_on_both_sides_of_the_sketch(spark, limit):
    df = spark.range(3000).select((F.col("id") % 350).alias("a"), (F.col("id") % 351).alias("b"), F.when(F.col("id") % 9 > 0, F.col("id") % 350).alias("c"))
    want = {"a": 350} | ({"b": 351, "c": 351} if limit == 351 else {})
    assert profile.distinct_up_to(df, limit) == want


def test_distinct_counts_include_missing(spark):
    got = {r["column"]: r["n_distinct"] for r in profile.distinct_counts(table(spark)).collect()}
    assert got == {"id": 4, "s": 3, "t": 3, "n": 3}


@pytest.mark.parametrize("limit", [10, 350, 400])
def test_prescreen_never_loses_a_column(spark, limit):
    df = spark.range(20000).repartition(6)
    df = df.selectExpr("id % 10 AS few", f"id % {limit} AS edge", f"id % {limit + 1} AS over", "id AS many", "CAST(NULL AS INT) AS none")
    got = profile.distinct_up_to(df, limit)
    assert got["edge"] == limit and got["few"] == 10 and got["none"] == 1
    assert "over" not in got and "many" not in got


def test_sparse_or_absent_columns_are_named(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 1)], "a int, b int")
    profile.require_dense(df, ["a"])
    with pytest.raises(KeyError, match="b"):
        profile.require_dense(df, ["a", "b"])
    with pytest.raises(KeyError, match="zz"):
        profile.require_dense(df, ["zz"])


def test_scaling_rules(spark):
    rows = [(1, 0.0, 5.0, 1.0, None), (2, 10.0, 5.0, math.inf, 4.0), (3, None, 5.0, 3.0, 8.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")
    out = scale.min_max_scale(df, ["a", "b", "c", "d"])
    assert column(out, "a") == [0.0, 1.0, 0.0] and column(out, "b") == [0.0] * 3
    assert column(out, "c") == [0.0, 0.0, 0.0] and column(out, "d") == [0.0, 0.0, 1.0]
    first = scale.fill_then_min_max(df, ["d"])
    assert column(first, "d") == [0.0, 0.5, 1.0]


def test_scaling_can_be_fitted_on_train_rows(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, 20.0)], "id int, a double")
    assert column(scale.min_max_scale(df, ["a"], fit_on=df.filter("id < 3")), "a") == [0.0, 1.0, 2.0]


def test_roles(spark):
    df = spark.range(300).selectExpr("id", "id % 7 AS small", "id AS big", "id % 3 AS AMT_MEAN", "id % 5 AS AMT_CREDIT")
    assert encode.roles_by_name(df, ["id"]) == (["AMT_CREDIT", "big", "AMT_MEAN"], ["small"])
    assert encode.roles_by_count(df, ["id"]) == (["big"], ["small", "AMT_MEAN", "AMT_CREDIT"])


def test_named_indicators_of_too_many_values_are_refused(spark, monkeypatch):
    df = spark.createDataFrame([(str(i % 7), str(i % 3)) for i in range(40)], "s string, t string")
    monkeypatch.setattr(encode, "MAX_NAMED", 9)
    with pytest.raises(ValueError, match="one_hot_vectors"):
        encode.one_hot_drop_first(df, ["s", "t"])
    monkeypatch.setattr(encode, "MAX_NAMED", 10)
    assert len(encode.one_hot_wide(df, ["s", "t"]).columns) == 12
