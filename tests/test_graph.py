import numpy as np
from pyspark.sql import functions as F

from riskloom.operators import graph

ROWS = [(0, 1, 1, 3.0), (1, 1, 1, 5.0), (2, 1, 1, 10.0), (3, 2, 1, 4.0), (4, 2, 1, 8.0), (5, None, 1, 7.0)]


def linked(spark):
    return graph.assign_clusters(spark.createDataFrame(ROWS, "id int, a int, b int, x double").repartition(3), ["a", "b"])


def by_id(df, c):
    return [r[c] for r in sorted(df.collect(), key=lambda r: r["id"])]


def matrix():
    keys = [(a or 0, b) for _, a, b, _ in ROWS]
    adjacency = np.array([[float(p == q) for q in keys] for p in keys])
    d = np.diag(1 / np.sqrt(adjacency.sum(axis=1)))
    return d @ adjacency @ d


def test_clusters_are_ordinal_and_missing_is_zero(spark):
    rows = linked(spark)
    assert by_id(rows, "cluster_id") == [1, 1, 1, 2, 2, 0] and by_id(rows, "degree") == [3, 3, 3, 2, 2, 1]
    links = {r["cluster_id"]: r["links"] for r in graph.cluster_links(rows).collect()}
    assert links == {0: 1, 1: 9, 2: 4}


def test_propagation_equals_the_matrix_form(spark):
    got = by_id(graph.propagate(linked(spark), ["x"]), "prop_x")
    np.testing.assert_allclose(got, matrix() @ np.array([r[3] for r in ROWS]))


def test_two_layers_with_a_map_between(spark):
    s, x = matrix(), np.array([r[3] for r in ROWS])
    got = by_id(graph.propagate(linked(spark), ["x"], between=lambda c: {"x": F.greatest(c["x"] * 2 - 11, F.lit(0.0))}), "prop_x")
    np.testing.assert_allclose(got, s @ np.maximum(2 * (s @ x) - 11, 0), atol=1e-12)


def test_totals_are_kept_and_a_second_pass_changes_nothing(spark):
    once = graph.propagate(linked(spark), ["x"])
    assert abs(sum(by_id(once, "prop_x")) - sum(r[3] for r in ROWS)) < 1e-9
    twice = graph.propagate(once.drop("x").withColumnRenamed("prop_x", "x"), ["x"])
    np.testing.assert_allclose(by_id(twice, "prop_x"), by_id(twice, "x"))


def test_vectors_and_shuffle_way(spark, monkeypatch):
    from riskloom import session

    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    rows = linked(spark).withColumn("v", F.array("x", F.col("x") * 2))
    got = by_id(graph.propagate_vector(rows, "v", 2), "propagated")
    want = matrix() @ np.array([[r[3], 2 * r[3]] for r in ROWS])
    np.testing.assert_allclose(got, want)


def test_batches_cut_the_graph(spark):
    rows = linked(spark).withColumn("batch", F.col("id") % 2)
    got = by_id(graph.propagate(rows, ["x"], by=["batch", "cluster_id"]), "prop_x")
    assert got == [6.5, 5.0, 6.5, 4.0, 8.0, 7.0]


def test_attribute_rules(spark):
    df = spark.range(100).selectExpr("id % 3 + 1 AS a", "id % 2 AS half_zero", "id AS many", "CAST(id % 4 = 0 AS INT) AS label")
    assert graph.attributes_by_count(df, 10, ["label"]) == ["a", "half_zero"]
    assert graph.attributes_by_count(df, 10) == ["a", "half_zero", "label"]
    assert graph.attributes_by_zero_share(df, 0.3, 20, ["label"]) == ["a"]


def gated(spark, share):
    """A label that follows the mix at this share, up to some wrong rows."""
    rows = spark.range(1500).select(
        F.col("id"), (F.col("id") % 23).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1000)) + 40 * (F.col("id") % 23)).cast("double").alias("x")
    )
    rows = graph.propagate(rows, ["x"], by=["g"])
    mixed = graph.gate(F.col("x"), F.col("prop_x"), share)
    return rows.withColumn("y", ((mixed > 940) != (F.col("id") % 50 == 7)).cast("int")).cache()


def test_learned_share_is_the_planted_one(spark):
    from riskloom.operators import metrics

    for share in (0.3, 0.8):
        rows = gated(spark, share)
        assert graph.learned_share(rows, "y", "x", "prop_x")[0] == share
        areas = {r["share"]: r["auc"] for r in graph.share_areas(rows, "y", "x", "prop_x", (0.0, 0.25, 1.0)).collect()}
        for s, area in areas.items():
            alone = rows.withColumn("p", graph.gate(F.col("x"), F.col("prop_x"), s))
            assert metrics.auc(alone, "y").first()["auc"] == area
    fine, area = graph.learned_share(gated(spark, 0.33), "y", "x", "prop_x", rounds=3)
    assert abs(fine - 0.33) < 0.02 and area >= graph.learned_share(gated(spark, 0.33), "y", "x", "prop_x")[1]


def test_share_without_rows_or_with_one_class(spark):
    rows = gated(spark, 0.3)
    assert graph.learned_share(rows.filter("id < 0"), "y", "x", "prop_x") == (1.0, None)
    assert graph.learned_share(rows.filter("y = 1"), "y", "x", "prop_x") == (1.0, None)
    flat = rows.withColumn("x", F.lit(1.0)).withColumn("prop_x", F.lit(1.0))
    assert graph.learned_share(flat, "y", "x", "prop_x") == (1.0, 0.5)
