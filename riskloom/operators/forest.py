"""Random forests for a 0/1 label, a tree a task, over rows cut into bins.

Columns are cut into at most BINS bins once. Rows alike in all bins and label become one with a count, combined before the shuffle; a bootstrap draws
a Poisson number with that count as its mean, which is what drawing every row by itself adds up to. Where the rows that are left
fit a task (``fits``), they are sent to all executors once and every tree is grown by one task, level by level, with array operations over all nodes of a level.

Settings mean what they mean to Spark's learner: Gini impurity, columns drawn anew for each node, leaves whose siblings predict the same class merged with them,
scores the mean of the leaves' shares. Trees are kept in the shared folder, packed; scoring takes as many trees at a time as FOREST_BYTES hold. Fits don't depend on how rows are dealt out.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.boosting import _assembled, _cut, _matrix
from riskloom.session import dealt_out, discard, materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
MOST_ROWS = 1 << 22  # different rows that a task grows a tree from
MOST_CELLS = 1 << 27  # and their bins
FOREST_BYTES = 1 << 26  # of trees that score rows at a time
_COMBINED = 1 << 18  # rows combined at once before the shuffle
_BITS = 8  # of a value, looked at by one pass for its column's bins
_CLOSE = 0.001  # share of the rows by which a bin may miss its size
_KINDS = {"column": np.int16, "bin": np.uint8, "child": np.int32, "share": np.float64}
_NODES = "tree int, bytes bigint, column binary, bin binary, child binary, share binary"


@dataclass(frozen=True)
class Tree:
    """Nodes as parallel arrays, the root first. ``column`` is -1 at leaves; rows whose bin is at most ``bin`` go to ``child``, others to the one after it."""

    column: np.ndarray  # int16
    bin: np.ndarray  # uint8
    child: np.ndarray  # int32; at leaves the place of their share
    share: np.ndarray  # float64, of the positive class

    def score(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int32)
        open_ = np.arange(len(bins))
        while len(open_):
            node = at[open_]
            column = self.column[node]
            inner = column >= 0
            open_, node, column = open_[inner], node[inner], column[inner]
            at[open_] = self.child[node] + (bins[open_, column] > self.bin[node])
        return self.share[self.child[at]]


# -- growing ------------------------------------------------------------------------------


def _drawn_columns(rng: np.random.Generator, nodes: int, width: int, many: int) -> np.ndarray:
    """For each node so many different columns."""
    pool = np.tile(np.arange(width, dtype=np.int16), (nodes, 1))
    each = np.arange(nodes)
    for j in range(many):
        other = rng.integers(j, width, nodes)
        pool[each, j], pool[each, other] = pool[each, other], pool[each, j]
    return pool[:, :many]


def _gains(n: np.ndarray, n1: np.ndarray, all_n: np.ndarray, all_1: np.ndarray) -> np.ndarray:
    """How much the impurity falls if ``n`` of ``all_n`` weights, ``n1`` of the positive ones, go left; -1 where a side is empty."""

    def pure(w, w1):
        return (w1 * w1 + (w - w1) * (w - w1)) / w

    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (pure(n, n1) + pure(all_n - n, all_1 - n1) - pure(all_n, all_1)) / all_n
    return np.where((n > 0) & (n < all_n), gain, -1.0)


def _best_cuts(slot: np.ndarray, bin_: np.ndarray, w: np.ndarray, w1: np.ndarray, all_n: np.ndarray, all_1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gain and bin of each node's best cut of one column, the first of equals; ``slot`` is each row's node."""
    slots = len(all_n)
    place = slot.astype(np.int64) * BINS + bin_
    if slots * BINS <= 2 * len(slot):
        n, n1 = (np.cumsum(np.bincount(place, v, slots * BINS).reshape(slots, BINS), axis=1) for v in (w, w1))
        gain = _gains(n, n1, all_n[:, None], all_1[:, None])
        best = np.argmax(gain, axis=1)
        return gain[np.arange(slots), best], best
    # Many small nodes: only the bins that occur.
    order = np.argsort(place, kind="stable")
    place = place[order]
    last = np.flatnonzero(np.r_[place[1:] != place[:-1], True])
    n, n1 = (np.cumsum(v[order])[last] for v in (w, w1))
    place = place[last]
    node = place // BINS
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])  # every node has rows
    before, before_1 = (np.r_[0.0, v[first[1:] - 1]] for v in (n, n1))
    gain = _gains(n - before[node], n1 - before_1[node], all_n[node], all_1[node])
    top = np.maximum.reduceat(gain, first)
    hit = np.flatnonzero(gain == top[node])
    best = hit[np.searchsorted(node[hit], np.arange(slots))]
    return top, place[best] % BINS


def grown(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, depth: int, many: int, rng: np.random.Generator) -> Tree:
    """A tree from weighted rows; every node tries ``many`` columns."""
    rows = np.flatnonzero(weight > 0)
    slot = np.zeros(len(rows), np.int32)
    levels = []  # (column, bin, first child within the next level, weight, positive weight) of a level's nodes
    nodes = 1
    while True:
        w = weight[rows].astype(np.float64)
        w1 = w * label[rows]
        all_n, all_1 = (np.bincount(slot, v, nodes) for v in (w, w1))
        column, cut, child = np.full(nodes, -1, np.int16), np.zeros(nodes, np.uint8), np.zeros(nodes, np.int32)
        levels.append((column, cut, child, all_n, all_1))
        mixed = (all_1 > 0) & (all_1 < all_n)
        if len(levels) > depth or not mixed.any():
            break
        number = np.cumsum(mixed, dtype=np.int32) - 1
        keep = mixed[slot]
        rows, slot, w, w1 = rows[keep], number[slot[keep]], w[keep], w1[keep]
        open_ = np.flatnonzero(mixed)
        tried = _drawn_columns(rng, len(open_), bins.shape[1], many)
        gain = np.full(len(open_), 1e-14)
        for j in range(many):
            found, at = _best_cuts(slot, bins[rows, tried[slot, j]], w, w1, all_n[open_], all_1[open_])
            better = found > gain
            gain[better] = found[better]
            column[open_[better]], cut[open_[better]] = tried[better, j], at[better]
        split = np.flatnonzero(column >= 0)
        if not len(split):
            break
        child[split] = 2 * np.arange(len(split), dtype=np.int32)
        node = open_[slot]
        keep = column[node] >= 0
        rows, node = rows[keep], node[keep]
        slot = child[node] + (bins[rows, column[node]] > cut[node])
        nodes = 2 * len(split)
    return _packed_tree(levels)


def _packed_tree(levels: list[tuple[np.ndarray, ...]]) -> Tree:
    """The nodes that are left once leaves that predict as their siblings are merged, numbered level by level."""
    for (column, _, child, *_), (below, _, _, n, n1) in zip(reversed(levels[:-1]), reversed(levels[1:])):
        inner = np.flatnonzero(column >= 0)
        left = child[inner]
        says = n1 > n - n1
        same = (below[left] < 0) & (below[left + 1] < 0) & (says[left] == says[left + 1])
        column[inner[same]] = -1
    parts, kept, at, leaves = [], np.zeros(1, np.int32), 1, 0
    for column, cut, child, n, n1 in levels:
        column, cut, child, n, n1 = (v[kept] for v in (column, cut, child, n, n1))
        inner = column >= 0
        kept = np.stack((child[inner], child[inner] + 1), axis=1).ravel()
        child = np.empty(len(column), np.int32)
        child[inner] = at + 2 * np.arange(inner.sum(), dtype=np.int32)
        child[~inner] = leaves + np.arange((~inner).sum(), dtype=np.int32)
        share = n1[~inner] / np.maximum(n[~inner], 1)
        parts.append((column, cut, child, share))
        at, leaves = at + len(kept), leaves + len(share)
        if not len(kept):
            break
    return Tree(*map(np.concatenate, zip(*parts)))


def _growing(shared, width: int, depth: int, many: int, seed: int):
    """Grows the trees whose numbers come in, from the rows all tasks share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, label, count = shared.value
        bins = np.frombuffer(bins, np.uint8).reshape(-1, width)
        label, count = np.frombuffer(label, np.uint8), np.frombuffer(count, np.int64)
        for batch in batches:
            for number in batch.column(0).to_pylist():
                rng = np.random.Generator(np.random.Philox(key=[seed & 0xFFFFFFFF, number]))
                tree = grown(bins, label, rng.poisson(count), depth, many, rng)
                data = [getattr(tree, c).astype(k).tobytes() for c, k in _KINDS.items()]
                columns = [pa.array([number], pa.int32()), pa.array([sum(map(len, data))], pa.int64()), *[pa.array([d], pa.binary()) for d in data]]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "bytes", *_KINDS])

    return run


# -- rows ------------------------------------------------------------------------------------


def _few_values(width: int):
    """The different values of every column, of each task, up to one more than there are bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.empty(0)] * width
        for batch in batches:
            values = _matrix(batch.column(0), np.float64)
            for i in range(width):
                if len(values) and len(seen[i]) <= BINS:
                    seen[i] = np.union1d(seen[i], values[:, i])[: BINS + 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width), [len(s) for s in seen])), pa.array(np.concatenate(seen))], ["c", "v"])

    return run


def _between(values: np.ndarray) -> np.ndarray:
    """The middle between neighbouring values, or the lower one where no number lies between."""
    low, high = values[:-1], values[1:]
    middle = low / 2 + high / 2
    return np.where((low < middle) & (middle < high), middle, low)


def bin_edges(rows: DataFrame, width: int) -> list[np.ndarray]:
    """The upper ends of all bins but the last: between any two values of a column with few, else quantiles."""
    found = rows.select("__x").mapInArrow(_few_values(width), "c bigint, v double").distinct()
    ranked = found.groupBy("c").agg(F.array_sort(F.collect_set("v")).alias("v"))  # at most BINS + 1 values of each task
    values = {r["c"]: np.array(r["v"][: BINS + 1]) for r in ranked.collect()}
    edges = [_between(values.get(i, np.empty(0))) for i in range(width)]
    asked = [i for i in range(width) if len(edges[i]) >= BINS]
    found = _quantiles(rows, asked) if asked else {}
    return [found.get(i, e) for i, e in enumerate(edges)]


def _order(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values."""
    bits = np.ascontiguousarray(values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _of_order(number: int) -> float:
    bits = number & ((1 << 63) - 1) if number >> 63 else ~number & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _cells(asked: dict[int, list[int]], done: int):
    """Rows per (column, cell of the next _BITS bits) inside the cells asked for, whose first ``done`` bits are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {c: np.zeros((len(cells), 1 << _BITS), np.int64) for c, cells in asked.items()}
        for batch in batches:
            values = _matrix(batch.column(0), np.float64)
            for c, cells in asked.items() if len(values) else ():
                number = _order(values[:, c])
                inside = np.zeros(len(number), np.int64)
                if done:
                    cell = number >> np.uint64(64 - done)
                    inside = np.minimum(np.searchsorted(np.array(cells, np.uint64), cell), len(cells) - 1)
                    keep = np.array(cells, np.uint64)[inside] == cell
                    number, inside = number[keep], inside[keep]
                place = (number >> np.uint64(64 - done - _BITS)).astype(np.int64) & ((1 << _BITS) - 1)
                np.add.at(sums[c], (inside, place), 1)
        for c, found in sums.items():
            cell, place = np.nonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(cell), pa.int64()), pa.array(cell), pa.array(place), pa.array(found[cell, place])], ["c", "cell", "place", "n"])

    return run


def _quantiles(rows: DataFrame, asked: list[int]) -> dict[int, np.ndarray]:
    """Distinct ends of bins that hold about a BINS-th of all rows each, exact but for _CLOSE of the rows; the columns' largest value ends none.

    Values are counted by their first bits, then, inside the cells that hold an end, by the next ones. Counts are sums, so the ends are the same however rows are dealt out.
    """
    open_, done = {c: {0: (0, list(range(1, BINS)))} for c in asked}, 0  # cell: rows before it, numbers of the ends in it
    ends: dict[int, set[int]] = {c: set() for c in asked}
    many = None
    while any(open_.values()):
        cells = {c: sorted(found) for c, found in open_.items() if found}
        table = rows.select("__x").mapInArrow(_cells(cells, done), "c bigint, cell bigint, place bigint, n bigint")
        table = table.groupBy("c", "cell", "place").agg(F.sum("n").alias("n")).toPandas()  # at most BINS * 2**_BITS a column
        done += _BITS
        new = {c: {} for c in asked}
        for (c, cell), part in table.sort_values("place").groupby(["c", "cell"]):
            many = many or int(part["n"].sum())
            first, numbers = open_[c][cells[c][cell]]
            n = part["n"].to_numpy()
            upto = first + np.cumsum(n)
            for k in numbers:
                i = min(int(np.searchsorted(upto, k * many / BINS)), len(n) - 1)
                number = (cells[c][cell] << _BITS) | int(part["place"].iloc[i])
                if done + _BITS > 64 or n[i] <= _CLOSE * many:
                    ends[c].add(((number + 1) << (64 - done)) - 1)
                else:
                    new[c].setdefault(number, (int(upto[i] - n[i]), []))[1].append(k)
        open_ = new
    most = rows.agg(*[F.max(F.get("__x", F.lit(c))).alias(f"c{c}") for c in asked]).first()
    values = {c: sorted(_of_order(e) for e in ends[c]) for c in asked}
    return {c: np.array([v for v in values[c] if v < most[f"c{c}"]]) for c in asked}


def _combined(edges: Sequence[np.ndarray]):
    """Bins and label of rows, with how many are alike."""

    def alike(parts: list[np.ndarray]) -> pa.RecordBatch:
        data = np.ascontiguousarray(np.concatenate(parts))
        rows, n = np.unique(data.view(f"V{data.shape[1]}").ravel(), return_counts=True)
        size = data.shape[1]
        ends = pa.py_buffer(np.arange(0, (len(rows) + 1) * size, size, dtype=np.int32))
        packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, ends, pa.py_buffer(rows.tobytes())])
        return pa.RecordBatch.from_arrays([packed, pa.array(n, pa.int64())], ["row", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, many = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = _cut(_matrix(batch.column(0), np.float64), edges).astype(np.uint8)
            label = batch.column(1).to_numpy(zero_copy_only=False)
            if not np.isin(label, (0, 1)).all():
                raise ValueError("labels must be 0 or 1")
            parts.append(np.concatenate((bins, label.astype(np.uint8)[:, None]), axis=1))
            many += len(bins)
            if many >= _COMBINED:
                yield alike(parts)
                parts, many = [], 0
        if parts:
            yield alike(parts)

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task as two runs of bytes."""
    for batch in batches:
        rows = b"".join(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.binary()), pa.array([batch.column(1).to_numpy().astype(np.int64).tobytes()], pa.binary())], ["rows", "n"])


@dataclass(frozen=True)
class Binned:
    """Different rows (row, n) of bins and label, how many there are, and the bins' edges."""

    rows: DataFrame
    many: int
    edges: list[np.ndarray]

    def fits(self) -> bool:
        """Whether a task can grow a tree from them."""
        return self.many <= MOST_ROWS and self.many * max(1, len(self.edges)) <= MOST_CELLS


def binned(train: DataFrame, columns: Sequence[str], label: str, many: int) -> Binned:
    """``many`` rows cut into bins, those alike combined. The columns must be complete; vector columns are allowed."""
    data = _assembled(train, columns).select("__x", F.col(label).cast("double").alias("y"))
    data = materialise(dealt_out(data, many), "forest-input")
    width = data.agg(F.max(F.size("__x"))).first()[0]
    if width is None:
        raise ValueError("no rows to learn from")
    edges = bin_edges(data, width)
    rows = materialise(data.mapInArrow(_combined(edges), "row binary, n bigint").groupBy("row").agg(F.sum("n").alias("n")), "forest-rows")
    discard(data)
    return Binned(rows, rows.count(), edges)


# -- models -----------------------------------------------------------------------------------


def _votes(trees: Sequence[Tree], edges: Sequence[np.ndarray]):
    """Adds the trees' shares to what rows have."""

    @F.pandas_udf("double")
    def votes(values: pd.Series, before: pd.Series) -> pd.Series:
        found = before.to_numpy(float).copy()
        if len(found):
            bins = _cut(np.stack(values.to_numpy()), edges)
            for t in trees:
                found += t.score(bins)
        return pd.Series(found)

    return votes


@dataclass(frozen=True)
class Forest:
    """A fitted model: the columns it reads, their bin edges, and a table of packed trees."""

    columns: list[str]
    edges: list[np.ndarray]
    trees: DataFrame

    def _groups(self) -> list[list[int]]:
        """Numbers of the trees that score rows together."""
        groups, size = [], FOREST_BYTES
        for r in self.trees.select("tree", "bytes").orderBy("tree").collect():
            if not groups or size + r["bytes"] > FOREST_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(r["tree"])
            size += r["bytes"]
        return groups

    def score(self, df: DataFrame, name: str = "p") -> DataFrame:
        """Add the probability of the positive class: the mean of the trees' shares."""
        groups = self._groups()
        total, out = "__votes", df.withColumn("__votes", F.lit(0.0))
        for i, group in enumerate(groups):
            table = self.trees.filter(F.col("tree").isin(group)).orderBy("tree").toArrow()  # at most FOREST_BYTES, or a tree
            trees = [Tree(*[np.frombuffer(table[c][j].as_py(), k) for c, k in _KINDS.items()]) for j in range(len(table))]
            made = _assembled(out, self.columns)
            out = made.select(*df.columns, _votes(trees, self.edges)("__x", F.col(total)).alias(total))
            if i < len(groups) - 1:  # a worker holds one group at a time
                out = materialise(out, "votes")
        many = sum(map(len, groups))
        return out.select(*df.columns, (F.col(total) / many).alias(name))

    def save(self, spark: SparkSession, path: str) -> None:
        """As two tables: the packed trees, and the columns with their edges."""
        self.trees.write.mode("overwrite").parquet(f"{path}/trees")
        about = [(self.columns, [[float(x) for x in e] for e in self.edges])]
        spark.createDataFrame(about, "columns array<string>, edges array<array<double>>").write.mode("overwrite").parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        about = spark.read.parquet(f"{path}/about").first()
        return Forest(list(about["columns"]), [np.array(e, float) for e in about["edges"]], spark.read.parquet(f"{path}/trees"))


def fit(given: Binned, columns: Sequence[str], trees: int, depth: int, seed: int) -> Forest:
    """A forest from rows that fit a task; every node tries the square root of the number of columns, rounded up."""
    spark, width = given.rows.sparkSession, len(given.edges)
    found = given.rows.mapInArrow(_joined, "rows binary, n binary").toArrow()
    data = np.frombuffer(b"".join(x.as_py() for x in found["rows"]), np.uint8).reshape(-1, width + 1)
    count = np.frombuffer(b"".join(x.as_py() for x in found["n"]), np.int64)
    order = np.argsort(np.ascontiguousarray(data).view(f"V{width + 1}").ravel())  # whatever order tasks gave them
    data, count = data[order], count[order]
    shared = spark.sparkContext.broadcast((data[:, :-1].tobytes(), data[:, -1].tobytes(), count.tobytes()))
    many = int(np.ceil(np.sqrt(width)))
    grown_ = spark.range(0, trees, 1, trees).mapInArrow(_growing(shared, width, depth, many, seed), _NODES)
    kept = materialise(grown_, "forest-trees")
    shared.unpersist()
    return Forest(list(columns), given.edges, kept)
