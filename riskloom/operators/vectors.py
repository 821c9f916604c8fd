"""Row-wise feature vectors held as fixed-length arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine(df: DataFrame, vectors: DataFrame, column: str, size: int, on: Sequence[str] = ("row_id",), prefix: str = "feature_nn") -> DataFrame:
    """Add a vector's elements as columns ``prefix0..``, matched by row key.

    Both sides have one row per key. Rows without a vector get 0.
    """
    flat = vectors.select(*on, *[F.get(F.col(column), F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in range(size)])
    names = [f"{prefix}{i}" for i in range(size)]
    return df.join(flat, list(on), "left").fillna(0.0, subset=names)


def reconstruction_error(df: DataFrame, original: str, rebuilt: str) -> DataFrame:
    """One row: mean squared difference over all elements of all vectors."""
    gaps = F.zip_with(
        F.col(original), F.col(rebuilt), lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))
    )
    row = F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v)
    return df.agg((F.sum(row) / F.sum(F.size(F.col(original)))).alias("mse"))


def class_cosine(df: DataFrame, column: str, label: str, size: int) -> DataFrame:
    """One row: absolute cosine between the mean vectors of the two classes."""
    def mean(cls: int, i: int):
        x = F.get(F.col(column), F.lit(i)).cast("double")
        return (F.sum(F.when(F.col(label) == cls, x).otherwise(0.0)) / F.count(F.lit(1))).alias(f"m{cls}_{i}")

    sums = df.agg(*[mean(cls, i) for cls in (1, 0) for i in range(size)])
    row = sums.select(*[F.array(*[F.col(f"m{cls}_{i}") for i in range(size)]).alias(f"m{cls}") for cls in (1, 0)])

    def dot(a: str, b: str):
        return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)

    norms = F.sqrt(dot("m1", "m1")) * F.sqrt(dot("m0", "m0"))
    return row.select(F.abs(F.when(norms > 0, dot("m1", "m0") / norms).otherwise(F.lit(0.0))).alias("cosine"))
