import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import metrics, multitask
from riskloom.operators.vectors import class_cosine, reconstruction_error

SIZE = 6


@pytest.fixture(scope="module")
def rows(spark):
    def value(i):
        return F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 500 - 1

    df = spark.range(600).select("id", F.array(*[value(i) for i in range(SIZE)]).alias("x"))
    return df.withColumn("y", (F.col("x")[0] + F.col("x")[1] > F.col("x")[2]).cast("int")).repartition(3).cache()


@pytest.mark.parametrize("weights", [(1.0, 0.0, 0.0), (0.0, 400.0, 0.0), (0.0, 0.0, 1.0), (0.5, 0.5, 0.3)])
def test_gradients_agree_with_differences(rows, weights):
    shape = multitask.Shape(SIZE, 3)
    theta = shape.start(4) + np.random.default_rng(1).normal(0, 0.2, shape.length())
    ready = rows.select("x", F.col("y").cast("double").alias("y"))
    _, _, grad = multitask.losses_and_gradients(ready, [theta], shape, weights)[0]
    x = np.array([r["x"] for r in rows.collect()])
    y = np.array([float(r["y"]) for r in rows.collect()])

    def loss(t):
        A, a, u, c, B, b = shape.split(t)
        z = np.tanh(x @ A.T + a)
        m = z @ u + c
        s1, s0 = y @ z, (1 - y) @ z
        cosine = abs(s1 @ s0 / np.linalg.norm(s1) / np.linalg.norm(s0))
        gap = z @ B.T + b - x
        return weights[0] * np.mean(np.log1p(np.exp(m)) - y * m) + weights[1] * np.mean(gap**2) / 500 + weights[2] * cosine

    for i in range(shape.length()):
        e = np.zeros(shape.length())
        e[i] = 1e-6
        assert grad[i] == pytest.approx((loss(theta + e) - loss(theta - e)) / 2e-6, abs=1e-7)


def test_loss_falls_every_step_with_one_aggregate_each(rows):
    model = multitask.fit(rows, "x", "y", SIZE, code=4, weights=(0.5, 50.0, 0.0), steps=25)
    assert len(model.losses) > 15 and all(a > b for a, b in zip(model.losses, model.losses[1:]))
    assert model.aggregates <= len(model.losses) + 1
    assert metrics.auc(model.score(rows), "y").first()["auc"] > 0.95


def test_loss_falls_past_the_cosine_s_kink(rows):
    model = multitask.fit(rows, "x", "y", SIZE, code=4, weights=(0.5, 50.0, 0.1), steps=25)
    assert all(a > b for a, b in zip(model.losses, model.losses[1:])) and model.losses[-1] < 0.8 * model.losses[0]
    assert model.aggregates <= 3 * len(model.losses)


def test_loss_is_the_multitask_score_of_the_scored_rows(rows):
    model = multitask.fit(rows, "x", "y", SIZE, code=4, weights=(0.5, 50.0, 0.1), steps=5)
    out = model.score(rows)
    loss = metrics.log_loss(out, "y").first()["log_loss"]
    mse = reconstruction_error(out, "x", "rebuilt").first()["mse"]
    cosine = class_cosine(out, "code", "y", 4).first()["cosine"]
    assert model.losses[-1] == pytest.approx(0.5 * loss + 50 * mse / 500 + 0.1 * cosine, abs=1e-9)


def test_odd_rows(spark, rows):
    more = spark.createDataFrame([(1, None, 1), (2, [1.0], 0), (3, [0.0] * SIZE, None)], "id bigint, x array<double>, y int")
    a = multitask.fit(rows, "x", "y", SIZE, code=2, steps=2)
    b = multitask.fit(rows.unionByName(more), "x", "y", SIZE, code=2, steps=2)
    assert a.losses == pytest.approx(b.losses)
    assert a.score(rows.filter("id < 0")).collect() == []
    with pytest.raises(ValueError, match="no rows"):
        multitask.fit(more, "x", "y", SIZE)
    one = multitask.fit(rows.filter("y = 1"), "x", "y", SIZE, code=2, weights=(0.5, 0.5, 0.3), steps=3)
    assert all(x > y for x, y in zip(one.losses, one.losses[1:]))
