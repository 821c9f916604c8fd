"""Row-wise column expressions. SQL NULL is the only missing value.

Everything here is a built-in expression, so it stays inside whole-stage
codegen and can be pushed through projections by the optimizer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(name: str) -> str:
    """A column name for use inside a SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def literal(value: object) -> str:
    """A value for use inside a SQL expression."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"{value}L" if value >= 0 else f"({value}L)"
    if isinstance(value, float):
        return f"double('{value!r}')" if value in (INF, -INF) or value != value else f"({value!r}D)"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def total(parts: Sequence[Column]) -> Column:
    """Plain sum of a non-empty list of columns."""
    return reduce(lambda a, b: a + b, parts)


def nan_to_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(~F.isnan(c), c)


def scrub_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating-point column (once, at the scan)."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    names = {c: quoted(c) for c in df.columns}
    return df.selectExpr(*[f"nanvl({q}, NULL) AS {q}" if c in floats else q for c, q in names.items()])


def ieee_div(a: Column | str, b: Column | str) -> Column:
    """Floating division where x/0 is a signed infinity and 0/0 is missing."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    return (
        F.when(b != 0, a / b)
        .when((b == 0) & (a > 0), F.lit(INF))
        .when((b == 0) & (a < 0), F.lit(-INF))
    )


def row_mean(cols: Sequence[str]) -> Column:
    """Mean over the columns of one row, missing skipped; NULL if all are missing."""
    n = total([F.col(c).isNotNull().cast("int") for c in cols])
    s = total([F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    return F.when(n > 0, s / n)


def row_std(cols: Sequence[str]) -> Column:
    """Sample standard deviation over the columns of one row; NULL below two values."""
    n = total([F.col(c).isNotNull().cast("int") for c in cols])
    mean = row_mean(cols)
    squares = total(
        [F.coalesce((F.col(c).cast("double") - mean) * (F.col(c).cast("double") - mean), F.lit(0.0)) for c in cols]
    )
    return F.when(n > 1, F.sqrt(squares / (n - 1)))


def fill_with_mean(df: DataFrame, column: str) -> DataFrame:
    """Replace missing values of one column by its global mean (a scalar subquery)."""
    mean = df.agg(F.avg(column).alias("m")).scalar()
    return df.withColumn(column, F.coalesce(F.col(column), mean))


def sentinel_to_null(c: Column | str, sentinel: int) -> Column:
    return F.nullif(_col(c), F.lit(sentinel))


def remap(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Replace listed values, keep all others (including missing)."""
    c = _col(c)
    if not mapping:
        return c
    items = list(mapping.items())
    out = F.when(c == items[0][0], F.lit(items[0][1]))
    for old, new in items[1:]:
        out = out.when(c == old, F.lit(new))
    return out.otherwise(c)


def flag(cond: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def overdue_bands(days: str, prefix: str, limit: int = 120) -> dict[str, Column]:
    """Three 0/1 columns: overdue at all, below the limit, at or above it."""
    d = F.col(days)
    return {
        f"{prefix}_IS_DPD": flag(d > 0),
        f"{prefix}_IS_DPD_UNDER_{limit}": flag((d > 0) & (d < limit)),
        f"{prefix}_IS_DPD_OVER_{limit}": flag(d >= limit),
    }


def leading_int(c: Column | str) -> Column:
    """Integer at the start of a string such as ``36 months``; NULL if there is none."""
    return F.regexp_extract(F.trim(_col(c)), r"^(\d+)", 1).try_cast("int")


def trailing_year(c: Column | str) -> Column:
    """Integer in the last four characters of a string such as ``Jan-1999``."""
    return F.right(_col(c), F.lit(4)).try_cast("int")


def log10_plus1(c: Column | str) -> Column:
    """log10(x + 1); missing where the argument is not positive."""
    c = _col(c).cast("double")
    return F.when(c > -1, F.log10(c + 1))


def midpoint(low: Column | str, high: Column | str) -> Column:
    return F.lit(0.5) * _col(low).cast("double") + F.lit(0.5) * _col(high).cast("double")


def to_date_time(c: Column | str, fmt: str) -> Column:
    """Parse text to a timestamp with a stated pattern; text that does not fit is missing."""
    return F.try_to_timestamp(_col(c), F.lit(fmt))


def fill_missing(df: DataFrame, value=0, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill missing values by a constant, in all columns the constant fits or in a subset."""
    return df.fillna(value, subset=list(columns) if columns is not None else None)
