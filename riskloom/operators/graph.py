"""The applicant graph: rows sharing all chosen attributes are connected.

Connected rows form complete groups, each row linked to itself too. The graph is
therefore held as its group membership (row, cluster), which has one record per
row, and a per-cluster size. Listing row pairs would square the largest group and
is never done: a row's degree is its cluster's size, a cluster of s rows
has s * s links, and normalised propagation over a complete group is its mean.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators import metrics
from riskloom.operators.joins import lookup_join
from riskloom.operators.profile import distinct_up_to, zero_shares
from riskloom.operators.running import with_row_ids
from riskloom.session import materialise


def attributes_by_count(df: DataFrame, below: int = 10, exclude: Sequence[str] = ()) -> list[str]:
    """Columns with fewer than ``below`` distinct values (missing counts as one).

    Exclude the label and the date: clusters built on the label would leak it.
    """
    columns = [c for c in df.columns if c not in set(exclude)]
    few = distinct_up_to(df, below - 1, columns)
    return [c for c in columns if c in few]


def attributes_by_zero_share(
    df: DataFrame, zero_share: float = 0.3, below: int = 20, exclude: Sequence[str] = ()
) -> list[str]:
    """Columns with few distinct values that are rarely zero."""
    columns = [c for c in df.columns if c not in set(exclude)]
    few = distinct_up_to(df, below - 1, columns)
    if not few:
        return []
    candidates = [c for c in columns if c in few]
    zeros = {r["column"]: r["zero_share"] for r in zero_shares(df.select(*candidates)).collect()}
    return [c for c in candidates if zeros[c] is not None and zeros[c] < zero_share]


def clusters(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """One row per attribute combination: its ordinal ``cluster_id`` and number of rows ``degree``.

    Only distinct combinations are ordered, never the rows. Attributes must be
    numeric codes; missing counts as 0.
    """
    filled = df.select(*[F.coalesce(F.col(a), F.lit(0).cast(df.schema[a].dataType)).alias(a) for a in attributes])
    sizes = filled.groupBy(*attributes).agg(F.count(F.lit(1)).alias("degree"))
    return with_row_ids(sizes, attributes, "cluster_id")


def assign_clusters(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Add ``cluster_id`` and ``degree``; missing attributes become 0."""
    mapping = materialise(clusters(df, attributes), "clusters")
    filled = df.fillna(0, subset=list(attributes))
    return lookup_join(filled, mapping, attributes, "degree")


def membership(df: DataFrame, key: str, cluster: str = "cluster_id") -> DataFrame:
    """The graph as (row, cluster) records."""
    return df.select(key, cluster)


def cluster_links(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Per cluster: rows, links (self-links included), total degree of the graph's block."""
    size = F.count(F.lit(1))
    return df.groupBy(cluster).agg(size.alias("degree"), (size * size).alias("links"))


def propagate(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = ("cluster_id",),
    prefix: str = "prop_",
    between: Callable[[Mapping[str, Column]], Mapping[str, Column]] | None = None,
) -> DataFrame:
    """Add each column's mean over the row's cluster (degree-normalised propagation).

    Add a batch column to ``by`` for a graph local to batches. ``between`` is a
    row-wise map for a second layer. After one layer all rows of a cluster are
    equal, so the map and the second mean happen on the table of clusters.
    """
    by = list(by)
    means = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"), *[F.avg(F.col(c).cast("double")).alias(prefix + c) for c in columns]
    )
    if between is not None:
        mapped = between({c: F.col(prefix + c) for c in columns})
        means = means.select(*by, "__n", *[v.alias(prefix + c) for c, v in mapped.items()])
    return lookup_join(df, materialise(means, "means"), by, "__n").drop("__n")


def propagate_vector(
    df: DataFrame, column: str, size: int, by: Sequence[str] = ("cluster_id",), name: str = "propagated"
) -> DataFrame:
    """``propagate`` for a fixed-length array column."""
    by = list(by)
    x = F.col(column)
    sums = [F.sum(F.get(x, F.lit(i)).cast("double")).alias(f"__s{i}") for i in range(size)]
    means = (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("__n"), *sums)
        .select(*by, "__n", F.array(*[F.col(f"__s{i}") / F.col("__n") for i in range(size)]).alias(name))
    )
    return lookup_join(df, materialise(means, "means"), by, "__n").drop("__n")


def gate(x: Column, propagated: Column, share: float) -> Column:
    """share * x + (1 - share) * propagated."""
    return F.lit(float(share)) * x + F.lit(1.0 - float(share)) * propagated


def gate_vector(x: Column, propagated: Column, share: float) -> Column:
    return F.zip_with(x, propagated, lambda a, b: gate(a.cast("double"), b, share))


SHARES = tuple(i / 20 for i in range(21))


def share_areas(df: DataFrame, label: str, own: str, propagated: str, shares: Sequence[float] = SHARES) -> DataFrame:
    """(share, auc): exact area of ``gate(own, propagated, share)`` for every share, all of them in one pass over the rows.

    NULL where a class is absent; rows without one of the two scores take no part.
    """
    each = F.array(*[F.struct(F.lit(float(s)).alias("share"), gate(F.col(own), F.col(propagated), s).alias("p")) for s in shares])
    rows = df.select(F.col(label).alias("label"), F.explode(each).alias("e")).select("label", "e.share", "e.p")
    return metrics.auc_by(rows, ["share"], "label", "p")


def learned_share(
    df: DataFrame, label: str, own: str, propagated: str, shares: Sequence[float] = SHARES, rounds: int = 1
) -> tuple[float, float | None]:
    """The share of largest area and that area; of equal ones the largest share, which leans on the row itself.

    Further rounds ask for as many shares between the neighbours of the best one. Where no area is defined the share is 1.
    """
    best, asked = (1.0, None), sorted(set(float(s) for s in shares))
    for _ in range(rounds):
        found = share_areas(df, label, own, propagated, asked).collect()  # a row a share
        known = [(r["auc"], r["share"]) for r in found if r["auc"] is not None]
        if not known:
            break
        area, share = max(known)
        if best[1] is None or (area, share) > (best[1], best[0]):
            best = (share, area)
        at = asked.index(share)
        low, high = asked[max(0, at - 1)], asked[min(len(asked) - 1, at + 1)]
        steps = len(asked) - 1
        if steps < 1 or low == high:
            break
        asked = sorted({low + (high - low) * i / steps for i in range(steps + 1)})
    return best
