import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskloom import session
from riskloom.operators import models
from riskloom.operators import perceptron as P

LAYERS = [3, 6, 4, 2]


def rows(spark, many):
    df = spark.range(many).select(*[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000).alias(c) for i, c in enumerate("abc")], "id")
    return df.withColumn("y", (F.col("a") + F.col("b") > 1).cast("int"))


def test_gradient_against_differences():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(50, 3)), rng.integers(0, 2, 50)
    weights = rng.normal(size=sum((a + 1) * b for a, b in zip(LAYERS, LAYERS[1:])))
    found = np.zeros(len(weights))
    P.add_loss(weights, LAYERS, x, y, found)
    for i in range(len(weights)):
        step = np.zeros(len(weights))
        step[i] = 1e-6
        up, down = (P.add_loss(w, LAYERS, x, y, np.zeros(len(weights))) for w in (weights + step, weights - step))
        assert (up - down) / 2e-6 == pytest.approx(found[i], abs=1e-4)


def test_steps_are_those_of_the_library(spark):
    """128 rows are one block of its learner, whose loss is the plain mean then."""
    df = rows(spark, 128).coalesce(1).cache()
    data = VectorAssembler(inputCols=list("abc"), outputCol="features").transform(df)
    for most in (0, 1, 4, 10):
        learner = MultilayerPerceptronClassifier(labelCol="y", layers=LAYERS, maxIter=most, seed=7)
        theirs, ours = np.array(learner.fit(data).weights), np.array(P.fit(learner, df, list("abc"), 128).weights)
        assert np.allclose(theirs, ours, rtol=1e-6, atol=1e-8)


def test_rows_over_many_tasks_give_the_same_fit(spark, monkeypatch):
    df = rows(spark, 2000)
    learner = MultilayerPerceptronClassifier(labelCol="y", layers=LAYERS, maxIter=8, seed=7)
    one = np.array(P.fit(learner, df, list("abc"), 2000).weights)
    monkeypatch.setattr(session, "ROWS_A_TASK", 300)
    seen = []
    real = P._asked
    monkeypatch.setattr(P, "_asked", lambda held, layers: seen.append(held.rdd.getNumPartitions()) or real(held, layers))
    assert np.allclose(np.array(P.fit(learner, df, list("abc"), 2000).weights), one, rtol=1e-6, atol=1e-8)
    assert seen and seen[0] > 1


def test_values_travel_exactly():
    import pyarrow as pa

    columns = [[0, 1, 1], [-3, 300, 7], [0.5, 1e30, -2], [0.1, 1 / 3, 1e-300], [0.0, -0.0, 5.0]]
    batch = pa.RecordBatch.from_arrays([pa.array(map(float, c)) for c in (*columns, [0, 1, 1])], list("abcdey"))
    (x, y), = P._unpacked(P._packing(5, 2)(iter([batch])))
    assert np.array_equal(x.T, np.array(columns)) and y.tolist() == [0, 1, 1]


def test_unfit_rows_are_refused_and_none_give_the_first_weights(spark, monkeypatch):
    df = spark.createDataFrame([(1.0, 0.0, 1), (None, 1.0, 0), (2.0, 1.0, None), (2.0, 2.0, 2)], "a double, b double, y int")
    monkeypatch.setattr(session, "ROWS_A_TASK", 1)
    for bad in ("a IS NULL", "y IS NULL", "y = 2"):
        with pytest.raises(Exception, match="whole numbers below 2|must be complete"):
            models.fit("mlp", df.filter(f"{bad} OR (a = 1 AND y = 1)"), ["a", "b"], "y", hidden=[3], max_iter=3)
    learner = MultilayerPerceptronClassifier(labelCol="y", layers=[2, 3, 2], maxIter=3, seed=7)
    assert len(P.fit(learner, df.filter("a > 5"), ["a", "b"], 0).weights) == 17


def test_many_rows_are_fitted_here_and_few_by_the_library(spark, monkeypatch):
    seen, real = [], P.fit
    monkeypatch.setattr(P, "fit", lambda *a: seen.append(a[-1]) or real(*a))
    df = rows(spark, 600)
    for rows_a_task in (600, 100):
        monkeypatch.setattr(session, "ROWS_A_TASK", rows_a_task)
        out = models.score(models.fit("mlp", df, list("abc"), "y", hidden=[4], max_iter=30), df)
        assert out.filter("p BETWEEN 0 AND 1").count() == 600
    assert seen == [600]
