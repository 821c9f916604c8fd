"""Running totals and row numbers over a declared order, without one-task windows.

The rows are range-partitioned on (group, order) and written once together with
their partition number. A window then runs inside each (partition, group), and
each partition's start is added back from the per-partition totals. A group
that holds most of the rows is spread over many partitions like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialise

_PART, _TOTAL, _START = "__part", "__total_", "__start_"


def _order_columns(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def running_totals(
    df: DataFrame,
    order: Sequence[Column | str],
    totals: Mapping[str, Column | str],
    within: Sequence[str] = (),
) -> DataFrame:
    """Add, per name in ``totals``, the sum of that column over all *earlier* rows.

    ``order`` must tell rows of one group apart. With ``within`` the totals
    restart for every group.
    """
    order = _order_columns(order)
    within = list(within)
    amounts = {name: (F.col(c) if isinstance(c, str) else c) for name, c in totals.items()}

    placed = df.select("*", *[c.alias(_TOTAL + name) for name, c in amounts.items()])
    placed = placed.repartitionByRange(*[F.col(w) for w in within], *order)
    placed = materialise(placed.withColumn(_PART, F.spark_partition_id()), "running")

    here = Window.partitionBy(_PART, *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select(
        *df.columns,
        _PART,
        *[F.coalesce(F.sum(_TOTAL + name).over(here), F.lit(0)).alias(name) for name in amounts],
    )

    # One row per (partition, group). Only groups that began in an earlier partition
    # have a start other than zero, at most one per partition, so `starts` has no more
    # rows than there are partitions.
    sums = placed.groupBy(_PART, *within).agg(*[F.sum(_TOTAL + name).alias(name) for name in amounts])
    if within:
        # A group reaching beyond one partition fills its last one from the front
        # and its first one to the end; all others need no start.
        spread = Window.partitionBy(*within).orderBy(_PART)
    else:
        spread = Window.orderBy(_PART)  # as many rows as partitions
    before = spread.rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col(_PART),
        *within,
        *[F.sum(name).over(before).alias(_START + name) for name in amounts],
    )
    begun = F.lit(False)
    for name in amounts:
        begun = begun | (F.coalesce(F.col(_START + name), F.lit(0)) != 0)
    starts = starts.filter(begun)

    on = F.col("l." + _PART) == F.col("s." + _PART)
    for w in within:
        on = on & F.col("l." + w).eqNullSafe(F.col("s." + w))
    joined = local.alias("l").join(F.broadcast(starts.alias("s")), on, "left")
    return joined.select(
        *[F.col("l." + c) for c in df.columns],
        *[(F.col("l." + n) + F.coalesce(F.col("s." + _START + n), F.lit(0))).alias(n) for n in amounts],
    )


def with_row_ids(df: DataFrame, order: Sequence[Column | str], name: str = "row_id") -> DataFrame:
    """Dense ids 0..n-1 in the declared order, which must tell rows apart.

    One range shuffle with a sort inside each partition; positions are recorded
    while writing, so ids never depend on a second evaluation.
    """
    order = _order_columns(order)
    pos = "__pos"
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(
        placed.withColumn(_PART, F.spark_partition_id()).withColumn(
            pos, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        ),
        "row-ids",
    )
    sizes = placed.groupBy(_PART).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select(_PART, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(_START))
    return placed.join(F.broadcast(starts), _PART).select(
        *df.columns, (F.col(_START) + F.col(pos)).cast("bigint").alias(name)
    )


def weighted_quantile(df: DataFrame, column: str, q: float):
    """Exact quantile with linear interpolation between neighbouring ranks.

    Equal values are counted first, so what is ordered grows with the number of
    distinct values only. ``column`` must be numeric; returns a Python float.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, ["v"], {"before": "n"})
    n = ranked.agg(F.max(F.col("before") + F.col("n"))).first()[0]
    if n is None:
        return None
    position = q * (n - 1)
    low = int(position)
    high = min(low + 1, n - 1)
    found = ranked.filter(
        ((F.col("before") <= low) & (F.col("before") + F.col("n") > low))
        | ((F.col("before") <= high) & (F.col("before") + F.col("n") > high))
    )
    rows = sorted((r["v"], r["before"], r["n"]) for r in found.collect())  # one or two rows
    a = next(v for v, b, m in rows if b <= low < b + m)
    z = next(v for v, b, m in rows if b <= high < b + m)
    return a + (z - a) * (position - low)
