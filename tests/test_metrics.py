import math
import random

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskloom.operators import metrics, vectors


def scored(spark, n=4000, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rnd.random() < 0.3)
        rows.append((i, 0 if i % 3 else 1 + i % 4, y, round(min(1.0, max(0.0, rnd.gauss(0.4 + 0.2 * y, 0.2))), 2)))
    return spark.createDataFrame(rows, "id int, batch int, label int, p double"), rows


def pair_auc(rows):
    pos, neg = [r[3] for r in rows if r[2] == 1], [r[3] for r in rows if r[2] == 0]
    if not pos or not neg:
        return None
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def test_auc_counts_pairs(spark):
    df, rows = scored(spark)
    got = metrics.auc(df).first()["auc"]
    assert math.isclose(got, pair_auc(rows), abs_tol=1e-12)
    ev = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="label", numBins=0)
    raw = df.withColumn("raw", array_to_vector(F.array(1 - F.col("p"), F.col("p"))))
    assert math.isclose(got, ev.evaluate(raw), abs_tol=1e-9)
    flipped = metrics.auc(df.withColumn("p", 1 - F.col("p"))).first()["auc"]
    assert math.isclose(got + flipped, 1.0, abs_tol=1e-9)


def test_auc_per_batch_with_a_dominant_batch(spark):
    df, rows = scored(spark)
    got = {r["batch"]: r["auc"] for r in metrics.auc_by(df, ["batch"]).collect()}
    for b, a in got.items():
        assert math.isclose(a, pair_auc([r for r in rows if r[1] == b]), abs_tol=1e-12)


def test_one_class_batches_are_left_out(spark):
    rows = [(0, 1, 0.2), (0, 0, 0.1), (1, 1, 0.3), (1, 1, 0.4)]
    df = spark.createDataFrame(rows, "batch int, label int, p double")
    assert {r["batch"]: r["auc"] for r in metrics.auc_by(df, ["batch"]).collect()} == {0: 1.0, 1: None}
    assert metrics.mean_auc_by(df, ["batch"]).first()["mean_auc"] == 1.0


def test_half_predicts_zero_and_empty_class_scores_zero(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.2)], "label int, p double")
    r = metrics.macro_scores(df).first()
    assert math.isclose(r["precision"], (0 + 2 / 3) / 2) and r["recall"] == 0.5 and math.isclose(r["f1"], 0.4)
    assert tuple(metrics.error_counts(df).first()) == (0, 1)


def test_roc_ends_at_one(spark):
    df, _ = scored(spark, 500)
    points = sorted((r["fpr"], r["tpr"]) for r in metrics.roc_curve(df).collect())
    assert points[-1] == (1.0, 1.0)
    area, last = 0.0, (0.0, 0.0)
    for x, y in points:
        area += (x - last[0]) * (y + last[1]) / 2
        last = (x, y)
    assert math.isclose(area, metrics.auc(df).first()["auc"], abs_tol=1e-9)


def test_loss_is_finite_at_the_ends(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (1, 0.0)], "label int, p double")
    assert math.isfinite(metrics.log_loss(df).first()["log_loss"])


def test_vector_terms(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 1.0]), (0, [0.0, 2.0], [0.0, 2.0])], "y int, x array<double>, r array<double>")
    assert vectors.reconstruction_error(df, "x", "r").first()["mse"] == 0.25
    assert vectors.class_cosine(df, "x", "y", 2).first()["cosine"] == 0.0
    same = spark.createDataFrame([(1, [1.0, 1.0]), (0, [2.0, 2.0])], "y int, x array<double>")
    assert math.isclose(vectors.class_cosine(same, "x", "y", 2).first()["cosine"], 1.0)


def test_macro_scores_leave_out_absent_classes(spark):
    only = spark.createDataFrame([(0, 0.1), (0, 0.2)], "label int, p double")
    assert tuple(metrics.macro_scores(only).first()) == (1.0, 1.0, 1.0)
    both = spark.createDataFrame([(0, 0.1), (0, 0.9)], "label int, p double")  # class 1 is predicted only
    assert tuple(metrics.macro_scores(both).first()) == (0.5, 0.25, (0 + 2 / 3) / 2)
    assert tuple(metrics.macro_scores(only.limit(0)).first()) == (None, None, None)
