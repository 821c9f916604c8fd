import datetime as dt

from pyspark.sql import functions as F

from riskloom.operators import balance, split


def test_modulo_split(spark):
    train, valid = split.modulo_split(spark.range(21).withColumnRenamed("id", "k"), 0.1, ["k"])
    assert sorted(r["k"] for r in valid.collect()) == [0, 10, 20] and train.count() == 18


def test_time_split_puts_ties_in_the_test_part(spark):
    days = [dt.datetime(2020, 1, 1) + dt.timedelta(days=min(i, 8)) for i in range(10)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "id int, d timestamp_ntz")
    train, test = split.time_split(df, "d", 0.9)
    assert sorted(r["id"] for r in test.collect()) == [8, 9] and train.count() == 8


def test_fractional_cutoff(spark):
    df = spark.createDataFrame([(0, dt.datetime(2020, 1, 1)), (1, dt.datetime(2020, 1, 1, 0, 0, 0, 1))], "id int, d timestamp_ntz")
    train, test = split.time_split(df, "d", 0.5)
    assert [r["id"] for r in train.collect()] == [0] and [r["id"] for r in test.collect()] == [1]


def labelled(spark, n=3000):
    return spark.range(n).selectExpr("id", "CAST(id % 5 = 0 AS INT) AS y", "id * 2 AS x")


def test_exact_number_of_negatives(spark):
    df = labelled(spark)
    for share in (0.0, 0.001, 0.37, 0.999, 1.0):
        got = balance.sample_negatives(df, "y", share, ["id"])
        assert got.filter("y = 0").count() == int(share * 2400) and got.filter("y = 1").count() == 600
        assert got.select("id").distinct().count() == got.count()


def test_negatives_follow_the_rank_even_with_ties(spark):
    df = labelled(spark, 1000)
    got = balance.sample_negatives(df, "y", 0.25, ["id"], rank=F.lit(3))
    assert sorted(r["id"] for r in got.filter("y = 0").collect()) == [i for i in range(1000) if i % 5][:200]


def test_repeated_positives(spark):
    got = balance.repeat_positives(labelled(spark, 100), "y", 4)
    assert got.filter("y = 1").count() == 80 and got.filter("y = 0").count() == 80
    assert got.filter("y = 1").select("id", "copy").distinct().count() == 80


def test_class_weights(spark):
    w = {r["y"]: r["weight"] for r in balance.with_class_weights(labelled(spark, 100), "y").collect()}
    assert w == {0: 1.0, 1: 4.0}
