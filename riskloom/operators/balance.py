"""Changing the class mix of a labelled table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.profile import class_counts
from riskloom.operators.running import with_row_ids

CELLS = 4096  # cells the rank is counted in
RANKS = 1 << 31


def repeat_positives(df: DataFrame, label: str, times: int) -> DataFrame:
    """Each positive ``times`` times (numbered by ``copy``), negatives once. One pass, no shuffle."""
    copies = F.sequence(F.lit(1), F.when(F.col(label) == 1, F.lit(int(times))).otherwise(F.lit(1)))
    if times < 1:
        df = df.filter(F.coalesce(F.col(label) != 1, F.lit(True)))
    return df.withColumn("copy", F.explode(copies))


def sample_negatives(
    df: DataFrame,
    label: str,
    share: float,
    key: Sequence[str],
    rank: Column | None = None,
    ranks: int = RANKS,
    seed: int = 0,
) -> DataFrame:
    """All positives and exactly ``int(share * negatives)`` negatives.

    Negatives are taken in the order of ``rank``, a whole number from 0 to ``ranks`` - 1 spread
    over the rows (by default a hash of the key), then ``key``, which must tell rows apart. The
    counts per cell of ranks give the cell the sample ends in; only that cell is ordered.
    """
    if rank is None:
        rank = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in key]), F.lit(ranks))
    rows = df.withColumn("__rank", rank.cast("bigint"))
    rows = rows.withColumn("__cell", F.floor(F.col("__rank") / F.lit((ranks - 1) // CELLS + 1)))
    negative = F.coalesce(F.col(label) != 1, F.lit(True))

    cells = rows.filter(negative).groupBy("__cell").agg(F.count(F.lit(1)).alias("n"))
    counts = sorted((r["__cell"], r["n"]) for r in cells.collect())  # at most CELLS rows
    total = sum(n for _, n in counts)
    take = int(share * total)
    if take >= total:
        return df
    if take <= 0:
        return df.filter(~negative)
    before = 0
    for last, n in counts:
        if before + n >= take:
            break
        before += n
    whole = rows.filter(~negative | (F.col("__cell") < last))
    edge = with_row_ids(rows.filter(negative & (F.col("__cell") == last)), ["__rank", *key], "__pos")
    edge = edge.filter(F.col("__pos") < take - before)
    return whole.select(*df.columns).unionByName(edge.select(*df.columns))


def with_class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weight positives by negatives / positives, negatives by 1."""
    c = class_counts(df, label).first()
    ratio = c["n_neg"] / c["n_pos"] if c["n_pos"] else 1.0
    return df.withColumn(name, F.when(F.col(label) == 1, F.lit(float(ratio))).otherwise(F.lit(1.0)))
