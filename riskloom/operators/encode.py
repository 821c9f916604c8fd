"""Turning categories into codes and indicator columns.

Order-dependent codes follow a declared row order (``order``), since a table has
none of its own: a value's first appearance is the smallest order key it has.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.scalars import literal, quoted
from riskloom.operators.joins import MappingSize, lookup_join, measure
from riskloom.operators.profile import column_values, distinct_up_to, slot_of, slot_value
from riskloom.operators.running import with_row_ids
from riskloom.session import materialise

# ---- Fixed values of the column-role rules ----

FORCED_VALUE_COLUMNS = [
    "AMT_CREDIT",
    "AMT_ANNUITY",
    "AMT_GOODS_PRICE",
    "REGION_POPULATION_RELATIVE",
    "DAYS_EMPLOYED",
    "DAYS_REGISTRATION",
    "DAYS_ID_PUBLISH",
    "EXT_SOURCE_1",
    "EXT_SOURCE_2",
    "EXT_SOURCE_3",
    "DAYS_LAST_PHONE_CHANGE",
]
VALUE_NAME_PARTS = ["MEAN", "SUM", "MIN", "MAX", "COUNT", "RATIO", "STD", "AVG", "TOTAL", "MODE", "MEDI"]
MAX_CODES_BY_NAME_RULE = 50  # more distinct values make a column numeric
MIN_VALUES_BY_COUNT_RULE = 200  # at least this many distinct values make a column numeric
MAX_NAMED = 4096  # values of all columns together that named indicators may have
MAX_WIDE_LEVELS = 20

# ---- End of fixed values ----


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def roles_by_name(df: DataFrame, exclude: Sequence[str]) -> tuple[list[str], list[str]]:
    """(value columns, code columns) by forced names, name parts, then distinct count."""
    columns = [c for c in df.columns if c not in set(exclude)]
    forced = [c for c in FORCED_VALUE_COLUMNS if c in columns]
    named = [c for c in columns if any(p in c for p in VALUE_NAME_PARTS)]
    undecided = [c for c in columns if c not in set(named)]
    few = distinct_up_to(df, MAX_CODES_BY_NAME_RULE, undecided) if undecided else {}
    values = list(dict.fromkeys(forced + [c for c in columns if c in set(named) or c not in few]))
    return values, [c for c in undecided if c in few and c not in set(forced)]


def roles_by_count(df: DataFrame, exclude: Sequence[str]) -> tuple[list[str], list[str]]:
    """(value columns, code columns): a column with fewer than 200 values is coded."""
    columns = [c for c in df.columns if c not in set(exclude)]
    few = distinct_up_to(df, MIN_VALUES_BY_COUNT_RULE - 1, columns)
    return [c for c in columns if c not in few], [c for c in columns if c in few]


# -- codes ---------------------------------------------------------------------


def _first_seen(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(i, w, r, t, first, n): each column's values, where each first appears, how often."""
    # A single order column keeps the minimum a plain value, which hash aggregation can update in place.
    first = f"{quoted(order[0])} AS o" if len(order) == 1 else f"struct({', '.join(quoted(o) for o in order)}) AS o"
    return (
        column_values(df, columns, [first])
        .groupBy("i", "w", "r", "t")
        .agg(F.min("o").alias("first"), F.count(F.lit(1)).alias("n"))
    )


# A column with at most this many values is coded by a CASE in the projection, not by a join.
CASE_LEVELS = 64


def _case(column: str, kind: T.DataType, rows: Sequence, default: int | None) -> str:
    slot, value = slot_of(kind), slot_value(column, kind)
    known = " ".join(f"WHEN {value} = {literal(r[slot])} THEN {r['code']}" for r in rows if r[slot] is not None)
    missing = next((str(r["code"]) for r in rows if r[slot] is None), "NULL" if default is None else str(default))
    other = "NULL" if default is None else str(default)
    return f"CAST(CASE WHEN {value} IS NULL THEN {missing} {known} ELSE {other} END AS INT) AS {quoted(column)}"


def _apply_codes(df: DataFrame, codes: DataFrame, columns: Sequence[str], default: int | None) -> DataFrame:
    """Replace each column by its code; ``codes`` (materialised) has i, w, r, t, n and code.

    All columns with few values are replaced in one projection, the others by one lookup each.
    """
    sizes = {m["i"]: MappingSize(m["keys"], m["rows"], m["bytes"]) for m in measure(codes, "n", ["i"])}
    few = {i: [] for i in range(len(columns)) if i in sizes and sizes[i].keys <= CASE_LEVELS}
    for r in codes.filter(F.col("i").isin(list(few))).select("i", "w", "r", "t", "code").collect() if few else []:
        few[r["i"]].append(r)  # at most CASE_LEVELS per column
    few = {i: rows for i, rows in few.items() if all(r["r"] is None or math.isfinite(r["r"]) for r in rows)}
    cases = {columns[i]: _case(columns[i], df.schema[columns[i]].dataType, rows, default) for i, rows in few.items()}
    out = df.selectExpr(*[cases.get(c, quoted(c)) for c in df.columns])
    for i, c in enumerate(columns):
        if i in few:
            continue
        key, kind = "__key", df.schema[c].dataType
        mapping = codes.filter(F.col("i") == i).select(
            F.col(slot_of(kind)).alias(key), F.col("n").alias("__n"), F.col("code").alias("__code")
        )
        keyed = out.withColumn(key, F.expr(slot_value(c, kind)))
        out = lookup_join(keyed, mapping, [key], "__n", sizes.get(i, MappingSize(0, 0, 0)))
        code = F.col("__code") if default is None else F.coalesce(F.col("__code"), F.lit(default))
        out = out.withColumn(c, code.cast("int")).drop(key, "__n", "__code")
    return out


def _ordinal_within_column(values: DataFrame, order: Sequence[Column]) -> DataFrame:
    """0-based position of each value within its column.

    The ids run over (column, order), so subtracting each column's smallest id gives the
    position inside it; no single task sees all the values of one column.
    """
    ids = with_row_ids(values, ["i", *order], "__id")
    starts = ids.groupBy("i").agg(F.min("__id").alias("__from"))  # one row per column
    return (
        ids.join(F.broadcast(starts), "i")
        .withColumn("code", F.col("__id") - F.col("__from"))
        .drop("__id", "__from")
    )


def factorize(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Codes by first appearance within each column; missing becomes -1."""
    seen = _first_seen(df, columns, order).filter("w is not null or r is not null or t is not null")
    codes = materialise(_ordinal_within_column(seen, [F.col("first")]), "codes")
    return _apply_codes(df, codes, columns, default=-1)


def _sorted_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    values = (
        column_values(df, columns)
        .filter("w is not null or r is not null or t is not null")
        .groupBy("i", "w", "r", "t")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return materialise(_ordinal_within_column(values, [F.col("w"), F.col("r"), F.col("t")]), "codes")


def category_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Codes by sorted value within each column; missing becomes -1."""
    return _apply_codes(df, _sorted_codes(df, columns), columns, default=-1)


def bag_dictionary(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One running code over all columns, each by first appearance; missing has a code too."""
    return with_row_ids(_first_seen(df, columns, order), ["i", "first"], "code")


def bag_encode(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, int]:
    """Replace the columns by their shared-dictionary codes; also the dictionary size."""
    codes = materialise(bag_dictionary(df, columns, order), "codes")
    return _apply_codes(df, codes, columns, default=None), codes.count()


# -- indicator columns -----------------------------------------------------------


def column_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """Sorted non-missing values per column, for named indicator columns.

    Names mean as many columns and driver rows, so more than MAX_NAMED values are an error; ``one_hot_vectors`` takes any number.
    """
    rows = column_values(df, columns).distinct().limit(MAX_NAMED + 1).collect()
    if len(rows) > MAX_NAMED:
        raise ValueError(f"more than {MAX_NAMED} different values in {', '.join(columns)}: use one_hot_vectors")
    slots = [slot_of(df.schema[c].dataType) for c in columns]
    return {c: sorted(r[slots[i]] for r in rows if r["i"] == i and r[slots[i]] is not None) for i, c in enumerate(columns)}


def level_name(column: str, level) -> str:
    return f"{column}_{level}"


def one_hot(df: DataFrame, levels: dict[str, list], drop_first: bool = False, keep: bool = False) -> DataFrame:
    """0/1 columns ``column_level``; a missing value is 0 everywhere."""
    added = [
        f"CASE WHEN {slot_value(c, df.schema[c].dataType)} = {literal(v)} THEN 1 ELSE 0 END AS {quoted(level_name(c, v))}"
        for c, vs in levels.items()
        for v in (vs[1:] if drop_first else vs)
    ]
    return df.selectExpr(*[quoted(c) for c in df.columns if keep or c not in levels], *added)


def one_hot_drop_first(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Named indicators for every level but the first sorted one; text columns by default."""
    columns = list(columns if columns is not None else text_columns(df))
    return one_hot(df, column_levels(df, columns), drop_first=True)


def one_hot_wide(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Named indicators for all levels next to the original columns; text columns by default."""
    columns = list(columns if columns is not None else text_columns(df))
    return one_hot(df, column_levels(df, columns), keep=True)


def one_hot_few(df: DataFrame, columns: Sequence[str], max_levels: int = MAX_WIDE_LEVELS) -> DataFrame:
    """Indicators for the columns that have few values once missing ones are 0."""
    filled = df.fillna(0, subset=list(columns))
    few = distinct_up_to(filled, max_levels, columns)
    return one_hot(filled, column_levels(filled, [c for c in columns if c in few]), keep=True)


def one_hot_vectors(df: DataFrame, columns: Sequence[str] | None = None, drop_first: bool = False) -> tuple[DataFrame, list[str]]:
    """Add a sparse 0/1 vector ``column_levels`` per column over its sorted values, however many; also the names added.

    A missing value, and with ``drop_first`` the first level, is all zeros. A column without a level to tell apart gets no
    vector. Text columns by default.
    """
    columns = list(columns if columns is not None else text_columns(df))
    codes = _sorted_codes(df, columns)
    levels = {r["i"]: r["k"] for r in codes.groupBy("i").agg(F.count(F.lit(1)).alias("k")).collect()}  # one row per column
    skip = 1 if drop_first else 0
    sizes = {c: levels.get(i, 0) - skip for i, c in enumerate(columns)}
    used = [c for c in columns if sizes[c] > 0]
    if not used:
        return df, []
    copies = [f"__code_{c}" for c in columns]
    coded = df.withColumns({k: F.col(quoted(c)) for k, c in zip(copies, columns, strict=True)})
    coded = _apply_codes(coded, codes, copies, default=-1)
    # An index past the last level stands for no level: the encoder keeps it and then drops the last place.
    index = {f"__code_{c}": F.col(quoted(f"__code_{c}")) - skip for c in used}
    coded = coded.withColumns({k: F.when(v >= 0, v).otherwise(sizes[k[len("__code_") :]]).cast("double") for k, v in index.items()})
    names = [f"{c}_levels" for c in used]
    encoder = OneHotEncoder(inputCols=[f"__code_{c}" for c in used], outputCols=names, dropLast=True, handleInvalid="keep")
    last = df.sparkSession.createDataFrame([tuple(float(sizes[c] - 1) for c in used)], [f"__code_{c}" for c in used])
    return encoder.fit(last).transform(coded).drop(*copies), names
