import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import forest as T
from riskloom.operators import metrics, models


def gini(w, w1):
    return 1 - (w1 / w) ** 2 - (1 - w1 / w) ** 2


def best_cut(bins, label, weight):
    """Best gain over all columns and bins, one by one."""
    best, n = 0.0, weight.sum()
    for c in range(bins.shape[1]):
        for b in range(int(bins[:, c].max())):
            left = bins[:, c] <= b
            w = [weight[m].sum() for m in (left, ~left)]
            if min(w) > 0:
                parts = sum(x / n * gini(x, weight[m & (label == 1)].sum()) for x, m in zip(w, (left, ~left)))
                best = max(best, gini(n, weight[label == 1].sum()) - parts)
    return best


def told(tree, bins, label, weight, columns):
    """Gain of the root's cut."""
    left = bins[:, tree.column[0]] <= tree.bin[0]
    n = weight.sum()
    parts = sum(weight[m].sum() / n * gini(weight[m].sum(), weight[m & (label == 1)].sum()) for m in (left, ~left))
    return gini(n, weight[label == 1].sum()) - parts


@pytest.mark.parametrize("rows", [30, 400])  # few rows take the sorted path, many the counted one
def test_the_root_takes_the_best_cut(rows):
    rng = np.random.default_rng(rows)
    for _ in range(20):
        bins = rng.integers(0, 9, (rows, 4)).astype(np.uint8)
        label, weight = rng.integers(0, 2, rows).astype(np.uint8), rng.poisson(1, rows)
        label[:2], weight[:2] = (0, 1), 1
        tree = T.grown(bins, label, weight, 1, 4, rng)
        if tree.column[0] >= 0:
            assert told(tree, bins, label, weight, 4) == pytest.approx(best_cut(bins, label, weight))


def test_both_ways_to_find_cuts_agree():
    rng = np.random.default_rng(1)
    slot = np.sort(np.r_[np.arange(20), rng.integers(0, 20, 2000)])
    bin_, w = rng.integers(0, T.BINS, len(slot)).astype(np.uint8), rng.poisson(1, len(slot)) + 1.0
    w1 = w * rng.integers(0, 2, len(slot))
    sums = [np.bincount(slot, v, 20) for v in (w, w1)]
    counted = T._best_cuts(slot, bin_, w, w1, *sums)
    T.BINS, kept = 1 << 12, T.BINS
    try:
        ordered = T._best_cuts(slot, bin_, w, w1, *sums)
    finally:
        T.BINS = kept
    assert np.allclose(counted[0], ordered[0]) and np.array_equal(counted[1], ordered[1])


def test_a_full_tree_tells_every_row_and_depth_is_kept():
    rng = np.random.default_rng(2)
    bins = np.unique(rng.integers(0, 30, (500, 3)).astype(np.uint8), axis=0)
    label = rng.integers(0, 2, len(bins)).astype(np.uint8)
    weight = np.ones(len(bins), np.int64)
    whole = T.grown(bins, label, weight, 30, 3, rng)
    # Siblings that predict alike are merged, so every prediction is right.
    assert np.array_equal(whole.score(bins) > 0.5, label == 1)
    for depth in (0, 1, 3):
        tree = T.grown(bins, label, weight, depth, 3, rng)
        assert len(tree.share) <= 2**depth and (tree.column < 0).sum() == len(tree.share)
    assert T.grown(bins, label, weight, 0, 3, rng).share[0] == pytest.approx(label.mean())


def test_leaf_shares_are_those_of_their_rows():
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 6, (3000, 3)).astype(np.uint8)
    label, weight = (rng.random(3000) < 0.2 + 0.1 * bins[:, 0]).astype(np.uint8), rng.poisson(1, 3000)
    tree = T.grown(bins, label, weight, 4, 2, rng)
    p = tree.score(bins)
    for share in np.unique(p):
        here = p == share
        if weight[here].sum():
            assert share == pytest.approx((weight * label)[here].sum() / weight[here].sum())


def table(spark, many):
    df = spark.range(many).select("id", *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(20 if i else 1000)) / 10).alias(c) for i, c in enumerate("abc")])
    return df.withColumn("y", ((F.col("a") > 40) != (F.pmod("id", F.lit(10)) == 0)).cast("int"))


def test_every_row_counts_once_and_few_values_have_bins_of_their_own(spark):
    df = table(spark, 4000).unionByName(table(spark, 1000)).repartition(3)
    found = T.binned(df, ["a", "b", "c"], "y", 5000)
    assert found.rows.agg(F.sum("n")).first()[0] == 5000 and found.many < 5000
    assert len(found.edges[0]) == T.BINS - 1 and [len(e) for e in found.edges[1:]] == [19, 19]
    assert np.allclose(found.edges[1], np.arange(19) / 10 + 0.05)


def test_bins_of_many_values_hold_equal_shares(spark):
    rng = np.random.default_rng(4)
    columns = [rng.normal(size=5000), np.exp(rng.normal(size=5000) * 9), 1e9 + rng.random(5000), np.where(rng.random(5000) < 0.5, 0.0, rng.normal(size=5000))]
    df = spark.createDataFrame([([float(x) for x in row],) for row in zip(*columns)], "__x array<double>").repartition(4)
    for values, edges in zip(columns, T.bin_edges(df, 4)):
        assert len(edges) > 10 and (np.diff(edges) > 0).all() and edges[-1] < values.max()
        held = np.bincount(np.searchsorted(edges, values, "left"), minlength=len(edges) + 1)
        assert held.min() > 0 and np.sort(held)[-2] <= 5000 / T.BINS + 15 and (held.max() <= 5000 / T.BINS + 15 or (values == 0).sum() <= held.max())


def test_a_fit_does_not_depend_on_partitions_nor_on_groups_of_trees(spark, monkeypatch):
    df = table(spark, 3000)
    scores = []
    for parts in (1, 5):
        model = models.fit("rf", df.repartition(parts), ["a", "b", "c"], "y", trees=7, depth=6)
        scores.append(models.score(model, df).orderBy("id").select("p").toPandas()["p"].to_numpy())
    monkeypatch.setattr(T, "FOREST_BYTES", 1)
    assert len(model._groups()) == 7
    scores.append(models.score(model, df).orderBy("id").select("p").toPandas()["p"].to_numpy())
    assert np.array_equal(scores[0], scores[1]) and np.allclose(scores[0], scores[2])
    assert metrics.auc(models.score(model, df), "y").first()["auc"] > 0.85


def test_rows_that_do_not_fit_a_task_are_left_to_the_library(spark, monkeypatch):
    monkeypatch.setattr(T, "MOST_CELLS", 10)
    model = models.fit("rf", table(spark, 500), ["a", "b", "c"], "y", trees=3, depth=3)
    assert not isinstance(model, T.Forest)


def test_unfit_rows_are_refused(spark):
    df = table(spark, 50)
    for bad in (df.withColumn("y", F.lit(None).cast("int")), df.withColumn("y", F.lit(2)), df.withColumn("a", F.lit(None).cast("double")), df.limit(0)):
        with pytest.raises(Exception):
            models.fit("rf", bad, ["a", "b", "c"], "y", trees=2)
