import random

from pyspark.sql import functions as F

from riskloom.llm import groups as G
from riskloom.session import materialise


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 14), (14, 1), (20, 21), (30, 30)]
    found = {r.node: r.label for r in G.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {n: 1 for n in (1, 2, 3, 10, 11, 12, 13, 14)} | {20: 20, 21: 20, 30: 30}
    assert G.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_hub_links_connect_all_similar_members(spark):
    """Points on a line; 1 - similarity is their distance. Components must be those of all pairs within the limit."""
    rng = random.Random(8)
    points = {i: rng.random() * 6 for i in range(150)}
    members = [(b, i) for b in range(4) for i in points if rng.random() < 0.6]
    df = materialise(spark.createDataFrame(members, "bucket bigint, node bigint"), "members")
    at = spark.createDataFrame(list(points.items()), "node bigint, x double")
    asked = []

    def verify(pairs):
        one, two = at.toDF("a", "x"), at.toDF("b", "y")
        found = pairs.join(one, "a").join(two, "b").withColumn("similarity", F.greatest(F.lit(0.0), 1 - F.abs(F.col("x") - F.col("y"))))
        asked.append(found.count())
        return found.select("a", "b", F.when(F.col("similarity") >= 0.6, F.col("similarity")).otherwise(0.0).alias("similarity"))

    links = G.hub_links(df, verify, 0.8)
    got = {r.node: r.label for r in G.components(links).collect()}
    label = {i: i for i in points}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for b in range(4):
        inside = [i for c, i in members if c == b]
        for i in inside:
            for j in inside:
                if i < j and abs(points[i] - points[j]) <= 0.2:
                    label[max(root(i), root(j))] = min(root(i), root(j))
    assert {i: root(i) for i in points} == {i: got.get(i, i) for i in points}
    assert sum(asked) < 150 * 149 / 2


def test_perhaps_named_loses_nothing(spark):
    rows = spark.range(2000).select(F.col("id").alias("x"))
    names = spark.createDataFrame([(i * 37,) for i in range(50)], "n bigint")
    kept = {r.x for r in G.perhaps_named(rows, F.col("x"), names, "n").collect()}
    assert {i * 37 for i in range(50)} <= kept and len(kept) < 70


def test_fixed_array(spark):
    rows = spark.createDataFrame([(0, 5), (3, -2)], "p int, v int")
    assert spark.range(1).select(G.fixed_array(rows, "p", "v", 5, "bigint").alias("a")).first().a == [5, 0, 0, -2, 0]


def test_a_large_group_around_one_member_takes_few_comparisons(spark):
    """Copies of one member, each 0.19 from it and 0.38 from each other, that meet it in five of six buckets."""
    members = [(b, i) for b in range(6) for i in range(400) if i == 7 or i % 6 != b]
    df = materialise(spark.createDataFrame(members, "bucket bigint, node bigint"), "members")
    asked = []

    def verify(pairs):
        found = pairs.select("a", "b", F.when((F.col("a") == 7) | (F.col("b") == 7), F.lit(0.81)).otherwise(F.lit(0.62)).alias("similarity"))
        asked.append(found.count())
        return found

    links = G.hub_links(df, verify, 0.8)
    assert {(r.a, r.b) for r in links.collect()} == {(min(i, 7), max(i, 7)) for _, i in members if i != 7}
    assert sum(asked) < 4 * 400
