"""Exact evaluation of scored rows (label 0/1, probability p)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import nan_to_null
from riskloom.operators.running import running_totals
from riskloom.operators.vectors import class_cosine, reconstruction_error

_BIG = "decimal(38,0)"


def _by_score(df: DataFrame, label: str, p: str, within: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score: equal scores are combined before any ordering."""
    return (
        df.filter(F.col(p).isNotNull())
        .groupBy(*within, F.col(p).alias("score"))
        .agg(
            F.count(F.when(F.col(label) == 1, 1)).alias("pos"),
            F.count(F.when(F.col(label) == 0, 1)).alias("neg"),
        )
    )


def roc_curve(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """(threshold, tpr, fpr) at every distinct score, counting scores at or above it."""
    scores = _by_score(df, label, p, [])
    run = running_totals(scores, [F.desc("score")], {"tp": "pos", "fp": "neg"})
    all_ = run.agg(F.max(F.col("tp") + F.col("pos")).alias("pos"), F.max(F.col("fp") + F.col("neg")).alias("neg")).first()
    n_pos, n_neg = all_["pos"] or 0, all_["neg"] or 0

    def share(seen: Column, of: int) -> Column:
        return seen.cast("double") / F.lit(float(of)) if of else F.lit(None).cast("double")

    return run.select(
        F.col("score").alias("threshold"),
        share(F.col("tp") + F.col("pos"), n_pos).alias("tpr"),
        share(F.col("fp") + F.col("neg"), n_neg).alias("fpr"),
    )


def auc_by(df: DataFrame, groups: Sequence[str], label: str = "label", p: str = "p") -> DataFrame:
    """Area under the ROC curve per group, ties counting half; NULL where a class is absent.

    Counts pairs ordered right: every positive with the negatives scored below it.
    """
    return auc_of_counts(_by_score(df, label, p, list(groups)), groups)


def auc_of_counts(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The same from positives (pos) and negatives (neg) per group and distinct score."""
    groups = list(groups)
    run = running_totals(counts, ["score"], {"below": "neg"}, within=groups)
    pairs = F.col("pos").cast(_BIG) * (2 * F.col("below") + F.col("neg")).cast("decimal(20,0)")
    sums = run.groupBy(*groups).agg(
        F.sum(pairs.cast(_BIG)).alias("twice"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    both = F.col("pos").cast("double") * F.col("neg").cast("double")
    return sums.select(*groups, F.when(both > 0, F.col("twice").cast("double") / 2 / both).alias("auc"))


def auc(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    return auc_by(df, [], label, p)


def mean_auc_by(df: DataFrame, groups: Sequence[str], label: str = "label", p: str = "p") -> DataFrame:
    """One row: mean of the group areas, groups with one class left out."""
    return auc_by(df, groups, label, p).agg(F.avg("auc").alias("mean_auc"))


def predicted(p: str = "p", threshold: float = 0.5) -> Column:
    """1 strictly above the threshold."""
    return F.when(F.col(p) > threshold, 1).otherwise(0)


def confusion(df: DataFrame, label: str = "label", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """One row of four counts."""
    y, yhat = F.col(label), predicted(p, threshold)

    def n(truth: int, guess: int) -> Column:
        return F.count(F.when((y == truth) & (yhat == guess), 1))

    return df.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))


def macro_scores(df: DataFrame, label: str = "label", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """One row: precision, recall and F1, each the plain mean over the classes in truth or prediction (0/0 is 0).

    Without rows there is no class, and the scores are missing.
    """
    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = confusion(df, label, p, threshold).select(
        ratio(tp, tp + fp).alias("p1"),
        ratio(tn, tn + fn).alias("p0"),
        ratio(tp, tp + fn).alias("r1"),
        ratio(tn, tn + fp).alias("r0"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(2 * tn, 2 * tn + fn + fp).alias("f0"),
        (tp + fp + fn > 0).cast("int").alias("has_1"),
        (tn + fn + fp > 0).cast("int").alias("has_0"),
    )

    def mean(one: str, zero: str) -> Column:
        present = F.col("has_1") + F.col("has_0")
        return F.when(present > 0, (F.col(one) * F.col("has_1") + F.col(zero) * F.col("has_0")) / present)

    return out.select(mean("p1", "p0").alias("precision"), mean("r1", "r0").alias("recall"), mean("f1", "f0").alias("f1"))


def error_counts(df: DataFrame, label: str = "label", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """One row: false positives and false negatives."""
    return confusion(df, label, p, threshold).select(
        F.col("fp").alias("truth_0_predicted_1"), F.col("fn").alias("truth_1_predicted_0")
    )


def log_loss(df: DataFrame, label: str = "label", p: str = "p", clip: float = 1e-15) -> DataFrame:
    """One row: mean negative log-probability of the true class."""
    true = F.when(F.col(label) == 1, F.col(p)).otherwise(1 - F.col(p))
    bounded = F.least(F.greatest(true, F.lit(clip)), F.lit(1.0 - clip))
    return df.filter(F.col(p).isNotNull()).agg(nan_to_null(F.avg(-F.log(bounded))).alias("log_loss"))


def multitask_score(
    scored: DataFrame,
    vectors: DataFrame,
    size: int,
    label: str = "label",
    p: str = "p",
    original: str = "x",
    rebuilt: str = "rebuilt",
    weights: tuple[float, float, float] = (0.5, 0.5, 0.0),
    batch_rows: int = 500,
) -> DataFrame:
    """One row: class loss, reconstruction error, class cosine and their weighted sum.

    The reconstruction error enters divided by the rows of a batch.
    """
    mse = reconstruction_error(vectors, original, rebuilt).scalar()
    cosine = class_cosine(vectors, original, label, size).scalar()
    out = log_loss(scored, label, p).select("log_loss", mse.alias("mse"), cosine.alias("cosine"))
    a, b, c = (F.lit(float(w)) for w in weights)
    return out.withColumn(
        "score", a * F.col("log_loss") + b * F.col("mse") / F.lit(float(batch_rows)) + c * F.col("cosine")
    )
