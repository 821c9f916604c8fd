"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors are assigned to the nearest of a bounded number of pivots. Each cell is summed up by its size and radius. A query first
searches the cells most in its direction until they hold enough candidates, which gives it a score to beat;
a cell can only beat it if <query, pivot> + |query| * radius does, and only to such cells is the query replicated. Cells and their queries
are dealt out in blocks, so no task holds a whole cell, and each block is solved by one matrix product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import small_batches
from riskloom.session import materialise

PIVOTS = 64
SAMPLE = 4096  # vectors the pivots are fitted on; the search itself is exact whatever they are
BLOCK = 4096  # rows of a cell, or queries for it, that meet in one task
_ROWS = "id long, uid long, v array<bigint>, cell int, away double, norm double"
_EXACT = float(1 << 53)


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & whole, F.lit(False))


def scaled(vector: Column, factor: int = 64) -> Column:
    """floor(factor * x) of every component, worked out in doubles."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("bigint"))


def stack(vectors, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def fit_pivots(sample: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """k-means on the sample, started at distinct rows spread over it."""
    distinct = np.unique(sample, axis=0).astype(float)
    pivots = distinct[np.linspace(0, len(distinct) - 1, min(count, len(distinct))).astype(int)]
    for _ in range(rounds):
        nearest = _nearest(sample.astype(float), pivots)[0]
        for j in np.unique(nearest):
            pivots[j] = sample[nearest == j].mean(axis=0)
    return pivots


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T
    cell = d.argmin(axis=1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows: by doubles where those are exact, else by whole numbers of any length."""
    if len(a) and len(b) and float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1] < _EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    limit = np.iinfo(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, limit.min, limit.max).astype(np.int64)


def _solve(width: int, k: int):
    def solve(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(data) and len(asked):
            ids = data["id"].to_numpy(dtype=float, na_value=np.inf)
            data = data.iloc[np.argsort(ids, kind="stable")]
            x, uid = stack(data["v"], width), data["uid"].to_numpy()
            for low in range(0, len(asked), 256):
                part = asked.iloc[low : low + 256]
                scores = products(stack(part["v"], width), x)
                own = part["uid"].to_numpy()[:, None] == uid[None, :]
                beat = part["beat"].fillna(np.iinfo(np.int64).min).to_numpy(dtype=np.int64)
                open_ = (scores >= beat[:, None]) & ~own
                for row in np.flatnonzero(open_.any(axis=1)):
                    place = np.flatnonzero(open_[row])
                    if len(place) > k:
                        s = scores[row, place]
                        place = place[s >= np.partition(s, len(s) - k)[len(s) - k]]
                        place = place[np.argsort(-scores[row, place], kind="stable")[:k]]
                    found.append((part["id"].iloc[row], own_uid(part, row), data["id"].iloc[place], scores[row, place]))
        rows = [(q, u, i, int(s)) for q, u, many, score in found for i, s in zip(many, score, strict=True)]
        out = pd.DataFrame(rows, columns=["query_id", "query_uid", "vec_id", "score"])
        return out.astype({"query_id": "Int64", "query_uid": "int64", "vec_id": "Int64", "score": "int64"})

    def own_uid(part: pd.DataFrame, row: int) -> int:
        return int(part["uid"].iloc[row])

    return solve


def _search(data: DataFrame, asked: DataFrame, sizes: dict[int, int], asked_sizes: dict[int, int], width: int, k: int) -> DataFrame:
    """Scores of queries against the cells they name (``cells``), dealt out in blocks of both sides."""
    blocks = {c: -(-n // BLOCK) for c, n in sizes.items()}
    asked_blocks = {c: max(1, -(-asked_sizes.get(c, 0) // BLOCK)) for c in sizes}

    def per_cell(values: dict[int, int], cell: Column) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[cell]  # one entry per pivot

    left = data.withColumn("block", F.pmod(F.xxhash64("uid"), per_cell(blocks, F.col("cell"))).cast("int"))
    left = left.withColumn("asked_block", F.explode(F.sequence(F.lit(0), per_cell(asked_blocks, F.col("cell")) - 1)))
    right = asked.withColumn("cell", F.explode("cells")).drop("cells")
    right = right.withColumn("asked_block", F.pmod(F.xxhash64("uid"), per_cell(asked_blocks, F.col("cell"))).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), per_cell(blocks, F.col("cell")) - 1)))
    key = ["cell", "block", "asked_block"]
    met = left.select(*key, "id", "uid", "v").groupBy(*key).cogroup(right.select(*key, "id", "uid", "v", "beat").groupBy(*key))
    return met.applyInPandas(_solve(width, k), "query_id bigint, query_uid bigint, vec_id bigint, score bigint")


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(df: DataFrame, asked: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", factor: int = 64) -> DataFrame:
    """For every row where ``asked`` holds, its k highest-scoring other rows: query_id, rank from 1, vec_id, score.

    Unusable vectors take no part, not even as queries. Shorter vectors count as filled up with zeros, an empty one as all
    zeros. Ties go to the smaller key, null keys last; equal rows are rows of their own. Scores beyond 64 bits are cut to
    that range. With fewer than k others all are given; an empty table, or no query, gives no rows.
    """
    spark = df.sparkSession
    small_batches(spark, 2000)
    columns = [F.col(f"`{key}`").cast("bigint").alias("id"), F.monotonically_increasing_id().alias("uid")]
    rows = df.filter(usable(F.col(f"`{vector}`"))).select(
        *columns, scaled(F.col(f"`{vector}`"), factor).alias("v"), F.coalesce(asked, F.lit(False)).alias("asked")
    )
    rows = materialise(rows, "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    sample = [r["v"] for r in rows.select("v", F.xxhash64("uid").alias("h")).orderBy("h").limit(SAMPLE).collect()]
    pivots = fit_pivots(stack(sample, width), PIVOTS)

    @F.pandas_udf("cell int, away double, norm double")
    def assign(vectors: pd.Series) -> pd.DataFrame:
        x = stack(vectors, width).astype(float)
        cell, away = _nearest(x, pivots)
        return pd.DataFrame({"cell": cell.astype(np.int32), "away": away, "norm": np.sqrt((x**2).sum(axis=1))})

    placed = materialise(rows.withColumn("at", assign("v")).select("id", "uid", "v", "asked", "at.*"), "cells")
    per_cell = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()  # one per pivot
    sizes = {r["cell"]: r["n"] for r in per_cell}
    cells = np.array(sorted(sizes))
    size = np.array([sizes[c] for c in cells])
    radius = np.array([{r["cell"]: r["radius"] for r in per_cell}[c] for c in cells])
    centre = pivots[cells]

    @F.pandas_udf("array<int>")
    def first_cells(vectors: pd.Series) -> pd.Series:
        toward = -(stack(vectors, width).astype(float) @ centre.T)
        order = np.argsort(toward, axis=1, kind="stable")
        enough = (np.cumsum(size[order], axis=1) > k).argmax(axis=1)
        short = np.cumsum(size[order], axis=1)[:, -1] <= k
        return pd.Series([cells[o if s else o[: e + 1]] for o, e, s in zip(order, enough, short, strict=True)])

    @F.pandas_udf("array<int>")
    def open_cells(vectors: pd.Series, norm: pd.Series, beat: pd.Series, done: pd.Series) -> pd.Series:
        reach = stack(vectors, width).astype(float) @ centre.T + norm.to_numpy()[:, None] * radius[None, :]
        reach += 1e-9 * np.abs(reach) + 1e-3  # rounding must not shut a cell
        floor = beat.fillna(-np.inf).to_numpy(dtype=float)
        return pd.Series([cells[(r >= f) & ~np.isin(cells, d)] for r, f, d in zip(reach, floor, done, strict=True)])

    def asked_sizes(q: DataFrame) -> dict[int, int]:
        return {r["cell"]: r["n"] for r in q.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}

    q = placed.filter("asked").select("id", "uid", "v", "norm", first_cells("v").alias("cells"), F.lit(None).cast("bigint").alias("beat"))
    q = materialise(q, "queries")
    near = materialise(_best(_search(placed, q, sizes, asked_sizes(q), width, k), k), "near")
    bar = near.groupBy(F.col("query_uid").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    bar = bar.select("of", F.when(F.col("n") >= k, F.col("least")).alias("least"))
    wider = q.join(bar, F.col("uid") == F.col("of"), "left").select("id", "uid", "v", "norm", "cells", F.col("least").alias("beat"))
    wider = wider.withColumn("cells", open_cells("v", "norm", "beat", "cells")).filter(F.size("cells") > 0)
    wider = materialise(wider, "wider")
    far = _search(placed, wider, sizes, asked_sizes(wider), width, k)
    both = near.drop("rank").unionByName(far)
    return _best(both, k).select("query_id", "rank", "vec_id", "score")
