"""Per-key summaries of a history table, for several row windows in one pass.

A window is a condition on rows ("the last year", "active credits"). All windows
of a source come from one scan. Rows are first combined per (key, which windows
they are in): every row updates one set of partial figures, however many windows there
are, and what travels is as narrow as one window. A second, much smaller step
adds the few partial rows of a key up to its windows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.scalars import quoted

_FLOATS = (T.DoubleType, T.FloatType)


@dataclass(frozen=True)
class RowWindow:
    """Output names are ``prefix + COLUMN_FUNCTION + suffix``; ``condition`` is SQL, none means all rows."""

    prefix: str
    condition: str | None = None
    suffix: str = ""


@dataclass(frozen=True)
class HistorySpec:
    """``metrics`` maps a column to its functions: count, mean, max, min, sum, nunique (of one column at most)."""

    key: str
    metrics: Mapping[str, Sequence[str]]
    windows: Sequence[RowWindow]
    extra: Mapping[str, str] = field(default_factory=dict)  # further sums: output name to SQL


def output_names(spec: HistorySpec) -> list[str]:
    return [
        f"{w.prefix}{c.upper()}_{f.upper()}{w.suffix}"
        for w in spec.windows
        for c, funcs in spec.metrics.items()
        for f in funcs
    ]


_MERGE = {"n": "sum", "s": "sum", "c": "sum", "x": "max", "m": "min"}


def _parts(spec: HistorySpec, condition: str | None = None) -> dict[str, str]:
    """Smallest set of mergeable aggregates as name to SQL, of all rows or those of a condition.

    A mean shares the sum (s) and the count (c) of its column; n counts rows.
    """

    def seen(c: str) -> str:
        return c if condition is None else f"CASE WHEN {condition} THEN {c} END"

    parts = {"n": f"count({seen('1')})"}
    for c, funcs in spec.metrics.items():
        if "mean" in funcs or "sum" in funcs:
            parts[f"s_{c}"] = f"sum({seen(c)})"
        if ("mean" in funcs or "count" in funcs) and c != spec.key:
            parts[f"c_{c}"] = f"count({seen(c)})"
        if "max" in funcs:
            parts[f"x_{c}"] = f"max({seen(c)})"
        if "min" in funcs:
            parts[f"m_{c}"] = f"min({seen(c)})"
    return parts


def _aggregates(sql_by_name) -> list:
    return [F.expr(sql).alias(n) for n, sql in sql_by_name.items()]


def _output(spec: HistorySpec, i: int, c: str, func: str, is_float: bool) -> str:
    """SQL of one metric from the parts of its window."""
    w = spec.windows[i]
    count = f"n__{i}" if c == spec.key else f"c_{c}__{i}"
    if func == "max":
        return f"x_{c}__{i}"
    if func == "min":
        return f"m_{c}__{i}"
    if func == "mean":
        value = f"CASE WHEN {count} > 0 THEN CAST(s_{c}__{i} AS DOUBLE) / {count} END"
    elif func == "sum":
        value = f"coalesce(s_{c}__{i}, 0)"
    elif func == "count":
        value = count
    elif func == "nunique":
        value = f"u__{i}"
    else:
        raise ValueError(f"unknown function {func} for {c}")
    if is_float and func in ("mean", "sum"):
        value = f"nanvl({value}, NULL)"  # opposite infinities add up to no number
    if w.condition is not None and func != "mean":
        value = f"CASE WHEN n__{i} > 0 THEN {value} END"
    return value


def gathered(df: DataFrame, key: str) -> DataFrame:
    """The rows that have a key, those of one key in one partition, so that summaries of them and joins on the key need no exchange.

    For keys with few rows each that lie far apart: a source row is much narrower than the partial figures of its key, of which
    there would be nearly as many as rows. A task adds up its rows one after another, so a key with many of them takes it longer, but no
    more memory. Keys with very many rows in every task are better summed up as they are, and so are tables laid out by key.
    """
    return df.filter(f"{quoted(key)} IS NOT NULL").repartition(F.col(quoted(key)))


def summarise(df: DataFrame, spec: HistorySpec) -> DataFrame:
    """One row per key with every metric of every window.

    Missing values are skipped; a sum over none is 0. A key without rows in a
    window has all of that window's metrics missing. Rows without key are dropped.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    # Columns go by short names here, so their own may hold any character.
    own = {"__key" if c == spec.key else f"v{j}": c for j, c in enumerate(spec.metrics)}
    given, spec = spec, replace(spec, key="__key", metrics={s: spec.metrics[c] for s, c in own.items()})
    is_float = {s: isinstance(types[c], _FLOATS) for s, c in own.items()}
    distinct = [s for s, funcs in spec.metrics.items() if "nunique" in funcs]
    if len(distinct) > 1:
        raise ValueError("at most one column can be counted distinct: " + ", ".join(own[s] for s in distinct))

    conditions = [
        f"coalesce({w.condition}, false) AS __w{i}" for i, w in enumerate(spec.windows) if w.condition is not None
    ]
    needed = {"__key": given.key, **own}
    rows = df.filter(f"{quoted(given.key)} IS NOT NULL").selectExpr(
        *[f"{quoted(c)} AS {s}" for s, c in needed.items()], *conditions, *[f"{sql} AS __x_{n}" for n, sql in spec.extra.items()]
    )

    flags = [f"__w{i}" if w.condition is not None else None for i, w in enumerate(spec.windows)]
    extra = {f"__x_{n}": f"sum(__x_{n})" for n in spec.extra}

    def merged(part: str, flag: str | None) -> str:
        value = part if flag is None else f"CASE WHEN {flag} THEN {part} END"
        sql = f"{_MERGE[part.split('_')[0]]}({value})"
        return sql if part[0] not in "nc" else f"coalesce({sql}, 0)"

    if distinct:
        # Combine per (key, value), each window apart, so that a value counts once per
        # window. A hot key is spread over its values and no row is copied.
        windowed = {f"{n}__{i}": sql for i, f in enumerate(flags) for n, sql in _parts(spec, f).items()}
        inner = rows.groupBy(spec.key, F.col(distinct[0]).alias("__value")).agg(*_aggregates({**windowed, **extra}))
        outer = {n: f"{_MERGE[n.split('_')[0]]}({n})" for n in windowed}
        outer.update(
            {f"u__{i}": f"count(CASE WHEN __value IS NOT NULL AND n__{i} > 0 THEN 1 END)" for i in range(len(flags))}
        )
        grouped = inner.groupBy(spec.key).agg(*_aggregates({**outer, **extra}))
    elif any(flags):
        inner = rows.groupBy(spec.key, *[f for f in flags if f]).agg(*_aggregates({**_parts(spec), **extra}))
        windowed = {f"{n}__{i}": merged(n, f) for i, f in enumerate(flags) for n in _parts(spec)}
        grouped = inner.groupBy(spec.key).agg(*_aggregates({**windowed, **extra}))
    else:
        plain = {f"{n}__{i}": sql for i in range(len(flags)) for n, sql in _parts(spec).items()}
        grouped = rows.groupBy(spec.key).agg(*_aggregates({**plain, **extra}))

    return grouped.selectExpr(
        f"__key AS {quoted(given.key)}",
        *[
            f"{_output(spec, i, c, f, is_float[c])} AS {quoted(f'{w.prefix}{own[c].upper()}_{f.upper()}{w.suffix}')}"
            for i, w in enumerate(spec.windows)
            for c, funcs in spec.metrics.items()
            for f in funcs
        ],
        *[f"__x_{n} AS {n}" for n in spec.extra],
    )
