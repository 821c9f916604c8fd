"""Joining a keyed mapping (one row per key) back to many rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import session
from riskloom.functions.scalars import quoted

# A key is hot when it holds at least this share of all rows; at most
# 1 / HOT_SHARE keys can be hot, which bounds what is broadcast for them.
HOT_SHARE = 0.001


@dataclass(frozen=True)
class MappingSize:
    keys: int  # rows of the mapping
    rows: int  # rows of the table it describes
    bytes: int  # estimate from the actual lengths of its values


def _bytes_of(df: DataFrame) -> str:
    """SQL estimate of one row's size in memory. An element of an array has 8 bytes, or if it is a record 16 and 8 for each of its fields."""
    sizes = []
    for f in df.schema.fields:
        q = quoted(f.name)
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            sizes.append(f"coalesce(octet_length({q}), 0)")
        elif isinstance(f.dataType, T.ArrayType):
            of = f.dataType.elementType
            sizes.append(f"{16 + 8 * len(of.fields) if isinstance(of, T.StructType) else 8} * greatest(coalesce(size({q}), 0), 0)")
    return " + ".join([str(16 + 8 * len(df.columns)), *sizes])


def measure(mapping: DataFrame, weight: str, by: Sequence[str] = ()) -> list:
    """Size of a mapping, or of each of several stacked mappings told apart by ``by``."""
    sized = mapping.groupBy(*by).agg(
        F.count(F.lit(1)).alias("keys"),
        F.coalesce(F.sum(weight), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.expr(_bytes_of(mapping))), F.lit(0)).alias("bytes"),
    )
    return sized.collect()


def measured_hot(mapping: DataFrame, weight: str, hot_rows: int) -> int:
    """Bytes of the keys that describe at least so many rows."""
    found = mapping.filter(F.col(weight) >= hot_rows).agg(F.sum(F.expr(_bytes_of(mapping))))
    return found.first()[0] or 0


def lookup_join(
    rows: DataFrame,
    mapping: DataFrame,
    on: Sequence[str],
    weight: str,
    size: MappingSize | None = None,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Left join rows to a mapping with one row per key; missing keys match each other.

    ``weight`` is the mapping column holding the number of rows of each key (it is
    kept in the result). ``mapping`` should be materialised. A mapping measured to be
    small is broadcast. Otherwise only its hot keys are (their number is bounded
    by the hot share) and the remaining rows are joined by a shuffle: a row that was
    served already gets a salt from its own values, so no partition collects a hot key.
    Rows should carry their row key, as equal rows get equal salts.
    """
    limit = session.BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    on = list(on)
    payload = [c for c in mapping.columns if c not in on]
    if size is None:
        m = measure(mapping, weight)[0]
        size = MappingSize(m["keys"], m["rows"], m["bytes"])

    def null_safe(left: str, right: str):
        cond = F.lit(True)
        for k in on:
            cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
        return cond

    if size.bytes <= limit:
        return (
            rows.alias("r")
            .join(F.broadcast(mapping.alias("m")), null_safe("r", "m"), "left")
            .select(*[F.col(f"r.{quoted(c)}") for c in rows.columns], *[F.col("m." + p) for p in payload])
        )

    hot_rows = max(1, int(size.rows * HOT_SHARE))
    # The number of hot keys is bounded but not their bytes, so the bar rises until those fit as well.
    while measured_hot(mapping, weight, hot_rows) > max(limit, 1 << 20):
        hot_rows *= 2
    hot = mapping.filter(F.col(weight) >= hot_rows).withColumn("__hot", F.lit(True))
    # Always 0 here, but not a constant: a constant would be folded out of the join keys.
    cold_salt = F.when(F.col(weight) >= hot_rows, 1).otherwise(0).cast("bigint")
    cold = mapping.filter(F.col(weight) < hot_rows).withColumn("__salt", cold_salt)
    served = (
        rows.alias("r")
        .join(F.broadcast(hot.alias("m")), null_safe("r", "m"), "left")
        .select(
            *[F.col(f"r.{quoted(c)}") for c in rows.columns],
            *[F.col("m." + p).alias("__hot_" + p) for p in payload],
            F.when(F.col("m.__hot"), 1 + F.pmod(F.xxhash64(*[F.col(f"r.{quoted(c)}") for c in rows.columns]), F.lit(1 << 20)))
            .otherwise(F.lit(0).cast("bigint"))
            .alias("__salt"),
        )
    )
    return (
        served.alias("r")
        .join(cold.alias("m"), null_safe("r", "m") & (F.col("r.__salt") == F.col("m.__salt")), "left")
        .select(
            *[F.col(f"r.{quoted(c)}") for c in rows.columns],
            *[F.coalesce(F.col("r.__hot_" + p), F.col("m." + p)).alias(p) for p in payload],
        )
    )
