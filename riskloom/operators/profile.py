"""Column profiles: missing share, zero share, distinct values. One pass each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.scalars import ieee_div, literal, quoted

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
_REAL = (T.FloatType, T.DoubleType)
SKETCH_EXACT = 350  # a sketch of size 2**12 holds single hashes up to 2**12 / 8 * 3 / 4


def _spread(row: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Turn a one-row table of per-column figures c0, c1, .. into (column, figure) rows."""
    pairs = ", ".join(f"struct({literal(c)} AS `column`, c{i} AS {name})" for i, c in enumerate(columns))
    return row.selectExpr(f"inline(array({pairs}))")


def _per_column(df: DataFrame, cells: Sequence[str]) -> DataFrame:
    """One aggregate per column, all in one pass."""
    return df.agg(*[F.expr(f"{sql} AS c{i}") for i, sql in enumerate(cells)])


def missing_shares(df: DataFrame) -> DataFrame:
    """(column, missing_share), largest share first."""
    row = _per_column(df, [f"avg(CAST({quoted(c)} IS NULL AS DOUBLE))" for c in df.columns])
    return _spread(row, df.columns, "missing_share").orderBy(F.desc("missing_share"), "column")


def zero_shares(df: DataFrame) -> DataFrame:
    """(column, zero_share); a missing value is not a zero, text never equals zero."""
    cells = [
        f"avg(CASE WHEN {quoted(f.name)} = 0 THEN 1D ELSE 0D END)"
        if isinstance(f.dataType, T.NumericType)
        else "CASE WHEN count(1) > 0 THEN 0D END"
        for f in df.schema.fields
    ]
    return _spread(_per_column(df, cells), df.columns, "zero_share")


def slot_of(kind: T.DataType) -> str:
    """Which slot of ``column_values`` holds a type."""
    if isinstance(kind, _WHOLE):
        return "w"
    return "r" if isinstance(kind, _REAL) else "t"


def slot_value(name: str, kind: T.DataType) -> str:
    """SQL of a column as its slot's type; -0.0 becomes 0.0."""
    slot = slot_of(kind)
    if slot == "w":
        return f"CAST({quoted(name)} AS BIGINT)"
    return f"CAST({quoted(name)} AS DOUBLE) + 0D" if slot == "r" else f"CAST({quoted(name)} AS STRING)"


def column_values(df: DataFrame, columns: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """One row per (row, column) with the value in a slot of its own kind.

    ``i`` is the column's position in ``columns``; of the slots ``w`` (whole
    numbers), ``r`` (reals) and ``t`` (text and times) at most one is filled, none for
    a missing value. Keeping kinds apart compares numbers as numbers. ``extra`` is SQL.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    empty = {"w": "CAST(NULL AS BIGINT)", "r": "CAST(NULL AS DOUBLE)", "t": "CAST(NULL AS STRING)"}

    def cell(i: int, c: str) -> str:
        filled = {**empty, slot_of(types[c]): slot_value(c, types[c])}
        return f"struct({i} AS i, {', '.join(f'{sql} AS {slot}' for slot, sql in filled.items())})"

    return df.selectExpr(*extra, f"inline(array({', '.join(cell(i, c) for i, c in enumerate(columns))}))")


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_distinct) exactly, a missing value counting as one more value.

    Values are combined per (column, value) before the shuffle, in one pass over the table.
    """
    columns = list(columns or df.columns)
    values = column_values(df, columns).groupBy("i", "w", "r", "t").agg(F.lit(1).alias("one"))
    counts = values.groupBy("i").agg(F.count("one").alias("n_distinct"))
    names = f"element_at(array({', '.join(literal(c) for c in columns)}), i + 1)"
    return counts.selectExpr(f"{names} AS `column`", "n_distinct")


def distinct_up_to(df: DataFrame, limit: int, columns: Sequence[str] | None = None) -> dict[str, int]:
    """Exact distinct counts (missing included) of the columns having at most ``limit`` values.

    A sketch pass sets aside columns that certainly have more: up to SKETCH_EXACT
    values a sketch keeps every hash it saw and counts those, so its figure never exceeds
    the number of values. Only the other columns, whose values are few, are counted exactly.
    """
    columns = list(columns or df.columns)
    if limit > SKETCH_EXACT:
        exact = {r["column"]: r["n_distinct"] for r in distinct_counts(df, columns).collect()}
        return {c: n for c, n in exact.items() if n <= limit}
    row = _per_column(df, [f"hll_sketch_estimate(hll_sketch_agg(xxhash64({quoted(c)}), 12))" for c in columns]).collect()[0]
    sketch = {c: row[f"c{i}"] or 0 for i, c in enumerate(columns)}
    few = [c for c in columns if sketch[c] <= 2 * limit]
    if not few:
        return {}
    exact = {r["column"]: r["n_distinct"] for r in distinct_counts(df, few).collect()}
    return {c: exact[c] for c in few if exact[c] <= limit}


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """(value, share of non-missing rows)."""
    n = df.agg(F.count(column)).scalar()
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(column, (F.col("n").cast("double") / n).alias("share"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """One row: negatives, positives and their ratio."""
    row = df.agg(
        F.count(F.when(F.col(label) == 0, 1)).alias("n_neg"),
        F.count(F.when(F.col(label) == 1, 1)).alias("n_pos"),
    )
    return row.withColumn("ratio", ieee_div("n_neg", "n_pos"))


def require_dense(df: DataFrame, columns: Sequence[str], max_share: float = 0.3) -> None:
    """Raise if a needed column is absent or misses more than the allowed share."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise KeyError("columns not in the table: " + ", ".join(absent))
    shares = {r["column"]: r["missing_share"] for r in missing_shares(df.select(*columns)).collect()}
    sparse = [c for c in columns if (shares[c] or 0.0) > max_share]
    if sparse:
        raise KeyError(f"columns missing in more than {max_share:.0%} of rows: " + ", ".join(sparse))
