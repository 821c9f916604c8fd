import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riskloom.operators.running import running_totals, weighted_quantile, with_row_ids


def test_row_ids_are_dense_and_ordered(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(7)
    got = {r["k"]: r["row_id"] for r in with_row_ids(df, ["k"]).collect()}
    assert got == {i: i for i in range(5000)}


def test_row_ids_of_an_empty_table(spark):
    assert with_row_ids(spark.range(0), ["id"]).count() == 0


def test_running_totals_with_one_dominant_group(spark):
    rnd = random.Random(3)
    rows = [(0 if i % 3 else rnd.randrange(1, 40), i, rnd.randrange(5)) for i in range(6000)]
    df = spark.createDataFrame(rows, "g int, o int, x int")
    got = running_totals(df, ["o"], {"before": "x"}, within=["g"]).toPandas().sort_values(["g", "o"])
    want = pd.DataFrame(rows, columns=["g", "o", "x"]).sort_values(["g", "o"])
    want["before"] = want.groupby("g").x.cumsum() - want.x
    assert got.before.tolist() == want.before.tolist()
    total = running_totals(df, [F.desc("o")], {"later": "x"}).toPandas().sort_values("o")
    x = np.array([r[2] for r in rows])
    assert total.later.tolist() == (x[::-1].cumsum()[::-1] - x).tolist()


def test_quantile_interpolates_and_skips_missing(spark):
    values = [1.0, 2.0, 2.0, 7.0, 11.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for q in (0.0, 0.3, 0.5, 0.9, 1.0):
        assert abs(weighted_quantile(df, "v", q) - float(np.quantile([v for v in values if v is not None], q))) < 1e-12


def test_running_totals_of_negative_and_mixed_amounts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for amount in (-1, 0, "mixed"):
            rows = [(i % 2, i, (-1) ** i * (i % 5) if amount == "mixed" else amount, 1) for i in range(100)]
            df = spark.createDataFrame(rows, "g int, o int, x int, one int").repartition(4)
            got = running_totals(df, ["o"], {"before": "x", "n": "one"}).orderBy("o").collect()
            assert [r["before"] for r in got] == [sum(r[2] for r in rows[:i]) for i in range(100)]
            assert [r["n"] for r in got] == list(range(100))
            inside = running_totals(df, ["o"], {"before": "x"}, within=["g"]).collect()
            assert all(r["before"] == sum(q[2] for q in rows if q[0] == r["g"] and q[1] < r["o"]) for r in inside)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
