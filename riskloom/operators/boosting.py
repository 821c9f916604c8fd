"""Gradient boosting for a 0/1 label: trees grown from histograms that Spark sums, stopped by the exact area on held-out rows.

Columns are cut into bins once. A level of a tree takes one job: tasks add the gradients of their rows per (node, column, bin), Spark
sums what the tasks found, and only these sums, whose number follows from the settings and never from the rows, reach the driver. Of two
children only the one with fewer rows is summed; its sibling is the parent less that. A child's own totals follow from its parent's sums, so children that are not split further,
or not by the driver, take no job. Nodes with few enough rows for a task are not taken level by level: one more job deals
their rows out by node and each task grows what is left below its nodes. Gradients are whole numbers (fractions of 2**-24), so sums are
exact, and a fit depends neither on how rows are dealt out nor on where a node was grown.

Trees grow level by level, and which splits stay is decided afterwards, since a node's gain does not depend on other nodes: leaf by leaf the split of most
gain, up to a number of leaves, or all of them, less those that a walk from the leaves up finds to gain too little.

Rows travel in chunks, the rows of a chunk packed as the bytes of their matrices, and are kept by Spark between jobs. Every row carries its margin, the sum of the
trees so far; the first job of a tree adds the tree before. After a block of trees the rows are written anew, and the held-out rows' margins after each tree are
counted; their areas tell the best prefix, and the model is cut there. No tree is fitted twice.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import metrics
from riskloom.session import dealt_out, discard, materialise, task_count

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 16  # trees between two writings of the margins
MOST_SUMS = 1 << 23  # sums of one level that the driver takes at most
FEW_SUMS = 1 << 20  # sums of all tasks that the driver adds up itself
CHUNK_ROWS = 1 << 16  # rows packed together at most
CHUNK_CELLS = 1 << 22  # and bins
TASK_ROWS = 1 << 16  # a node of so many rows at most is grown in one task
_UNIT = float(1 << 24)


@dataclass(frozen=True)
class Settings:
    rounds: int
    step: float
    depth: int
    leaves: int | None = None  # most leaves, grown best first; None: every split of enough gain
    min_gain: float = 0.0  # splits that gain less are cut, from the leaves up
    penalty: float = 0.0  # added to a node's second derivatives
    min_hessian: float = 1.0  # least sum of second derivatives of a child
    min_rows: int = 1  # least rows of a child
    subsample: float = 1.0  # share of the rows that a tree learns from
    patience: int | None = None  # rounds without a better area before it ends
    from_average: bool = False  # start from the log-odds of all rows
    bins: int = 255
    seed: int = 0


@dataclass(frozen=True)
class Tree:
    """Nodes as parallel lists, the root first. ``column`` is -1 at leaves; rows whose bin is at most ``bin`` go left."""

    column: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    rows: np.ndarray

    def walk(self, bins: np.ndarray) -> np.ndarray:
        """The node each row ends in."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            column = self.column[at]
            inner = column >= 0
            if not inner.any():
                return at
            goes_left = bins[rows, np.maximum(column, 0)] <= self.bin[at]
            at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)

    def leaves(self) -> int:
        return int((self.column < 0).sum())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _bin_kind(starts: np.ndarray) -> np.dtype:
    """The smallest type that holds every bin."""
    return np.dtype(np.uint8 if np.diff(starts).max() <= 256 else np.int16)


def _unpacked(batch: pa.RecordBatch, starts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Bins (rows, columns), labels, weights, tickets and margins of every chunk."""
    kinds = (_bin_kind(starts), np.float64, np.float64, np.int64, np.float64)
    for i in range(batch.num_rows):
        bins, *rest = (np.frombuffer(batch.column(j)[i].as_buffer(), kind) for j, kind in enumerate(kinds))
        yield bins.reshape(len(rest[0]), -1), *rest


def _cut(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of each value: how many edges lie below it."""
    out = np.empty(values.shape, np.int16)
    for i, e in enumerate(edges):
        out[:, i] = np.searchsorted(e, values[:, i], "left")
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def drawn(ticket: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
    """Whether a tree learns from the row with this ticket."""
    if share >= 1:
        return np.ones(len(ticket), bool)
    salt = _mixed(np.uint64([(seed * 1_000_003 + tree) & 0xFFFFFFFF]) + np.uint64(1))
    return _mixed(ticket.view(np.uint64) ^ salt) < np.uint64(int(share * 2**64))


def gradients(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log-loss, in whole units."""
    p = _sigmoid(margin)
    return np.rint(weight * (p - label) * _UNIT), np.rint(weight * p * (1 - p) * _UNIT)


# -- one level of a tree ----------------------------------------------------------------


def _derivatives(chunk: Sequence[np.ndarray], tree: Tree, slot_of: np.ndarray, number: int, settings: Settings):
    """Slot, bins, first and second derivatives of the drawn rows whose node has a slot."""
    bins, label, weight, ticket, margin = chunk
    if settings.subsample < 1:
        keep = drawn(ticket, number, settings.subsample, settings.seed)
        bins, label, weight, margin = (v[keep] for v in (bins, label, weight, margin))
    at = slot_of[tree.walk(bins)]
    keep = at >= 0
    if not keep.all():
        at, bins, label, weight, margin = (v[keep] for v in (at, bins, label, weight, margin))
    return at, bins, *gradients(margin, label, weight)


def _add_up(total: np.ndarray, at: np.ndarray, bins: np.ndarray, g: np.ndarray, h: np.ndarray, starts: np.ndarray) -> None:
    """Add rows to sums (3, slots, bins of all columns)."""
    slots = total.shape[1]
    for j, (a, b) in enumerate(zip(starts, starts[1:])):
        place = at * int(b - a) + bins[:, j]
        for k, v in enumerate((g, h, None)):
            total[k, :, a:b] += np.bincount(place, v, slots * int(b - a)).reshape(slots, -1)


def _summed(tree: Tree, slot_of: np.ndarray, starts: np.ndarray, number: int, settings: Settings):
    """A task's sums per (slot of a node, column, bin): place, first and second derivatives, rows."""
    shape = (3, int(slot_of.max() + 1), int(starts[-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for chunk in _unpacked(batch, starts):
                at, bins, g, h = _derivatives(chunk, tree, slot_of, number, settings)
                if len(at):
                    _add_up(total, at, bins, g, h, starts)
        flat = total.reshape(3, -1)
        some = np.flatnonzero(flat[2])
        columns = [pa.array(some)] + [pa.array(t[some].astype(np.int64)) for t in flat]
        yield pa.RecordBatch.from_arrays(columns, ["place", "g", "h", "n"])

    return run


def _gathered(tree: Tree, slot_of: np.ndarray, starts: np.ndarray, number: int, settings: Settings):
    """The drawn rows whose node has a slot, packed per chunk and slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _unpacked(batch, starts):
                at, *values = _derivatives(chunk, tree, slot_of, number, settings)
                order = np.argsort(at, kind="stable")
                slots, first = np.unique(at[order], return_index=True)
                if len(slots):
                    parts = [[v[rows].tobytes() for rows in np.split(order, first[1:])] for v in values]
                    yield pa.RecordBatch.from_arrays([pa.array(slots), *[pa.array(p, pa.binary()) for p in parts]], ["slot", "bins", "g", "h"])

    return run


def _level_sums(rows: DataFrame, tasks: int, tree, slot_of, starts, number, settings) -> np.ndarray:
    """(3, slots, bins of all columns): sums of one level's nodes that have a slot."""
    slots = int(slot_of.max() + 1)
    if slots * int(starts[-1]) > MOST_SUMS:
        raise ValueError(f"{slots} nodes with {int(starts[-1])} bins are more than {MOST_SUMS} sums: take fewer bins or leaves")
    found = rows.mapInArrow(_summed(tree, slot_of, starts, number, settings), "place bigint, g bigint, h bigint, n bigint")
    if tasks * slots * int(starts[-1]) > FEW_SUMS:
        found = found.groupBy("place").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    table = found.toArrow()  # at most MOST_SUMS, or FEW_SUMS of all tasks
    out = np.zeros((3, slots * int(starts[-1])))
    for k, name in enumerate(("g", "h", "n")):
        np.add.at(out[k], table["place"].to_numpy(), table[name].to_numpy())
    return out.reshape(3, slots, -1)


def best_split(sums: np.ndarray, starts: np.ndarray, settings: Settings) -> tuple[float, int, int] | None:
    """Gain, column and bin of a node's best split; of equal gains the first column and bin. None where no child may be so small."""

    def worth(g, h):
        return g * g / (h + settings.penalty)

    # Whole numbers, so that a column's running sums are exact as differences of those over all columns.
    run = np.cumsum(sums.astype(np.int64), axis=1)
    column = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    before = np.concatenate((np.zeros((3, 1), np.int64), run), axis=1)[:, starts]
    left, whole = run - before[:, column], (before[:, 1:] - before[:, :-1])[:, column]
    (g, h, n), (all_g, all_h, all_n) = ((x[0] / _UNIT, x[1] / _UNIT, x[2].astype(float)) for x in (left, whole))
    right_h, right_n = all_h - h, all_n - n
    fits = (np.minimum(h, right_h) >= settings.min_hessian) & (np.minimum(n, right_n) >= settings.min_rows)
    fits &= np.minimum(h, right_h) + settings.penalty > 0
    fits[starts[1:] - 1] = False  # nothing is right of a column's last bin
    if not fits.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, worth(g, h) + worth(all_g - g, right_h) - worth(all_g, all_h), -np.inf)
    k = int(np.argmax(gain))
    if not gain[k] > 1e-6:
        return None
    return float(gain[k]), int(column[k]), int(k - starts[column[k]])


class _Growing:
    """A tree while it grows: lists of its nodes."""

    def __init__(self):
        self.column, self.bin, self.left, self.right = [], [], [], []
        self.g, self.h, self.rows, self.gain = [], [], [], []

    def add(self, sums: np.ndarray, width: int) -> int:
        g, h, n = sums[:, :width].sum(axis=1)  # every row has one bin in the first column
        for name, v in (("column", -1), ("bin", -1), ("left", -1), ("right", -1), ("g", g / _UNIT), ("h", h / _UNIT), ("rows", int(n)), ("gain", 0.0)):
            getattr(self, name).append(v)
        return len(self.column) - 1

    def cut(self, node: int) -> None:
        self.column[node] = self.bin[node] = self.left[node] = self.right[node] = -1
        self.gain[node] = 0.0

    def numbers(self) -> dict[int, int]:
        """A new number for each node still reached from the root."""
        order = [0]
        for node in order:
            if self.column[node] >= 0:
                order += [self.left[node], self.right[node]]
        return {node: i for i, node in enumerate(order)}

    def done(self, settings: Settings) -> Tree:
        """The nodes still reached from the root, numbered anew."""
        number = self.numbers()
        order = list(number)

        def value(node):
            low = self.h[node] + settings.penalty
            return -settings.step * self.g[node] / low if self.column[node] < 0 and low > 0 else 0.0

        kept = [[getattr(self, name)[node] for node in order] for name in ("column", "bin")]
        ends = [[number.get(getattr(self, name)[node], -1) for node in order] for name in ("left", "right")]
        return Tree(*map(np.array, (*kept, *ends, [value(n) for n in order], [self.gain[n] for n in order], [self.rows[n] for n in order])))


def keep_best_first(tree: _Growing, leaves: int) -> None:
    """Keep the splits that growing leaf by leaf would make: always the one of most gain among the leaves there are, until there are so many."""
    open_, kept = [0], set()
    while len(kept) < leaves - 1:
        ready = [n for n in open_ if tree.column[n] >= 0]
        if not ready:
            break
        node = max(ready, key=lambda n: (tree.gain[n], -n))
        kept.add(node)
        open_.remove(node)
        open_ += [tree.left[node], tree.right[node]]
    for node in range(len(tree.column)):
        if tree.column[node] >= 0 and node not in kept:
            tree.cut(node)


def cut_small_gains(tree: _Growing, least: float) -> None:
    """From the leaves up, cut splits that gain less than ``least``. A split above one that stays is kept, however small its gain."""

    def walk(node: int) -> bool:
        """Whether the node is a leaf afterwards."""
        if tree.column[node] < 0:
            return True
        both = [walk(tree.left[node]), walk(tree.right[node])]
        if all(both) and tree.gain[node] < least:
            tree.cut(node)
            return True
        return False

    walk(0)


def _expand(tree: _Growing, sums: dict, level: list[int], depth: int, starts: np.ndarray, settings: Settings, ask, aside=lambda node: False) -> list[tuple[int, int]]:
    """Split the nodes of a level and what comes below, up to ``depth`` levels. ``ask(nodes)`` gives the sums of nodes just made.

    ``aside(node)`` tells whether someone else takes care of a node; these are returned with the levels left below them.
    """
    handed = []
    for left in range(depth, 0, -1):
        handed += [(node, left) for node in level if aside(node)]
        asked, level = [], [node for node in level if not aside(node)]
        for node in level:
            found = best_split(sums[node], starts, settings)
            if found is None:
                continue
            tree.gain[node], tree.column[node], tree.bin[node] = found
            a, b, k = starts[found[1]], starts[found[1] + 1], found[2]
            ends = (sums[node][:, a : a + k + 1], sums[node][:, a + k + 1 : b])
            children = [tree.add(s, s.shape[1]) for s in ends]
            tree.left[node], tree.right[node] = children
            asked.append((node, sorted(children, key=lambda c: tree.rows[c])))
        if not asked:
            break
        level = [child for node, _ in asked for child in (tree.left[node], tree.right[node])]
        wanted = [(node, both) for node, both in asked if left > 1 and not all(map(aside, both))]
        if wanted:
            found = ask([small for _, (small, _) in wanted])
            for slot, (node, (small, large)) in enumerate(wanted):
                sums[small], sums[large] = found[:, slot], sums[node] - found[:, slot]
        for node, _ in asked:
            del sums[node]
    return handed


_SUBTREE = "slot bigint, node int, column int, bin int, left int, right int, g double, h double, rows bigint, gain double"


def _grown_here(starts: np.ndarray, levels: Sequence[int], settings: Settings):
    """Grows everything below a node from its rows."""

    def run(table: pa.Table) -> pa.Table:
        slot = table["slot"][0].as_py()
        kinds = {"bins": _bin_kind(starts), "g": np.dtype(np.float64), "h": np.dtype(np.float64)}
        bins, g, h = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in kinds.items())
        bins = bins.reshape(len(g), -1)
        tree, where, wide = _Growing(), np.zeros(len(bins), np.int64), int(starts[-1])

        def ask(nodes):
            column, bin_, left, right = (np.array(getattr(tree, name)) for name in ("column", "bin", "left", "right"))
            here = np.flatnonzero(column[where] >= 0)
            node = where[here]
            where[here] = np.where(bins[here, column[node]] <= bin_[node], left[node], right[node])
            slot_of = np.full(len(tree.column), -1, np.int64)
            slot_of[nodes] = np.arange(len(nodes))
            keep = slot_of[where] >= 0
            total = np.zeros((3, len(nodes), wide))
            _add_up(total, slot_of[where][keep], bins[keep], g[keep], h[keep], starts)
            return total

        tree.add(np.zeros((3, 1)), 1)
        first = ask([0])[:, 0]
        tree.g[0], tree.h[0], tree.rows[0] = (v / u for v, u in zip(first[:, : starts[1]].sum(axis=1), (_UNIT, _UNIT, 1)))
        _expand(tree, {0: first}, [0], levels[slot], starts, settings, ask)
        names = ["column", "bin", "left", "right", "g", "h", "rows", "gain"]
        kinds = [pa.int32()] * 4 + [pa.float64()] * 2 + [pa.int64(), pa.float64()]
        columns = [pa.array(np.array(getattr(tree, n)), k) if n != "rows" else pa.array([int(x) for x in tree.rows], k) for n, k in zip(names, kinds)]
        count = len(tree.column)
        return pa.Table.from_arrays([pa.array([slot] * count, pa.int64()), pa.array(range(count), pa.int32()), *columns], ["slot", "node", *names])

    return run


def _attach(tree: _Growing, node: int, nodes: pa.Table) -> None:
    """Put a subtree in place of a leaf."""
    order = nodes.sort_by("node").to_pydict()
    place = [node] + [tree.add(np.zeros((3, 1)), 1) for _ in order["node"][1:]]
    for i, at in enumerate(place):
        for name in ("column", "bin", "g", "h", "rows", "gain"):
            getattr(tree, name)[at] = order[name][i]
        for name in ("left", "right"):
            getattr(tree, name)[at] = place[order[name][i]] if order[name][i] >= 0 else -1


def grow(rows: DataFrame, many: int, tasks: int, starts: np.ndarray, number: int, settings: Settings) -> Tree:
    """One tree from ``many`` rows: a job a level, for the children with fewer rows only, and one for all nodes that a task can finish."""
    tree, sums = _Growing(), {}
    width = int(starts[1])

    def shape(nodes: list[int]) -> tuple[Tree, np.ndarray]:
        """The tree as it is, and the slots of these nodes."""
        numbers = tree.numbers()
        slot_of = np.full(len(numbers), -1, np.int64)
        slot_of[[numbers[n] for n in nodes]] = np.arange(len(nodes))
        return tree.done(replace(settings, step=0.0)), slot_of

    def ask(nodes: list[int]) -> np.ndarray:
        return _level_sums(rows, tasks, *shape(nodes), starts, number, settings)

    tree.add(np.zeros((3, width)), width)
    if many <= TASK_ROWS:
        handed = [(0, settings.depth)]
    else:
        first = ask([0])[:, 0]
        tree.g[0], tree.h[0], tree.rows[0] = first[0, :width].sum() / _UNIT, first[1, :width].sum() / _UNIT, int(first[2, :width].sum())
        sums[0] = first
        handed = _expand(tree, sums, [0], settings.depth, starts, settings, ask, lambda node: tree.rows[node] <= TASK_ROWS)
    if handed:
        now, slot_of = shape([node for node, _ in handed])
        gathered = rows.mapInArrow(_gathered(now, slot_of, starts, number, settings), "slot bigint, bins binary, g binary, h binary")
        grown = gathered.groupBy("slot").applyInArrow(_grown_here(starts, [left for _, left in handed], settings), _SUBTREE).toArrow()
        for slot in set(grown["slot"].to_pylist()):
            _attach(tree, handed[slot][0], grown.filter(pc.equal(grown["slot"], slot)))
    if settings.leaves is not None:
        keep_best_first(tree, settings.leaves)
    cut_small_gains(tree, settings.min_gain)
    return tree.done(settings)


# -- models ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Boosted:
    """A fitted model: the columns it reads, their bin edges, the starting margin and the trees; areas after each tree on held-out rows."""

    columns: list[str]
    edges: list[np.ndarray]
    start: float
    trees: list[Tree]
    areas: list[float | None]

    def prefix(self, trees: int) -> Boosted:
        return replace(self, trees=self.trees[:trees])

    def score(self, df: DataFrame, name: str = "p") -> DataFrame:
        """Add the probability of the positive class."""
        edges, start, trees = self.edges, self.start, self.trees

        @F.pandas_udf("double")
        def probability(values: pd.Series) -> pd.Series:
            margin = np.full(len(values), start)
            if trees and len(values):
                bins = _cut(np.stack(values.to_numpy()), edges)
                for t in trees:
                    margin += t.value[t.walk(bins)]
            return pd.Series(_sigmoid(margin))

        out = _assembled(df, self.columns)
        return out.select(*df.columns, probability("__x").alias(name))

    def save(self, spark: SparkSession, path: str) -> None:
        """As two tables: a node per row, and an edge per row."""
        nodes = [
            (i, j, int(t.column[j]), int(t.bin[j]), int(t.left[j]), int(t.right[j]), float(t.value[j]), float(t.gain[j]), int(t.rows[j]))
            for i, t in enumerate(self.trees)
            for j in range(len(t.column))
        ]
        schema = "tree int, node int, column int, bin int, left int, right int, value double, gain double, rows bigint"
        spark.createDataFrame(nodes, schema).write.mode("overwrite").parquet(f"{path}/nodes")
        edges = [(i, [float(x) for x in e]) for i, e in enumerate(self.edges)]
        about = [(self.start, self.columns, self.areas)]
        spark.createDataFrame(edges, "place int, edges array<double>").write.mode("overwrite").parquet(f"{path}/edges")
        spark.createDataFrame(about, "start double, columns array<string>, areas array<double>").write.mode("overwrite").parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Boosted:
        about = spark.read.parquet(f"{path}/about").first()
        edges = [np.array(r["edges"]) for r in spark.read.parquet(f"{path}/edges").orderBy("place").collect()]
        trees = []
        for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect():
            if r["node"] == 0:
                trees.append([])
            trees[-1].append([r[c] for c in ("column", "bin", "left", "right", "value", "gain", "rows")])
        return Boosted(list(about["columns"]), edges, about["start"], [Tree(*map(np.array, zip(*t))) for t in trees], list(about["areas"]))


def _assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    made = VectorAssembler(inputCols=list(columns), outputCol="__v", handleInvalid="error").transform(df)
    return made.withColumn("__x", vector_to_array("__v")).drop("__v")


def bin_edges(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Distinct quantiles of every column, at most ``bins`` - 1: the upper ends of all bins but the last. Their number follows from the settings.

    Columns of one or two values, such as indicators, are told by counting: the lower value ends a bin if the first quantile must lie there.
    Quantiles are asked only of the others, and of those whose first quantile may be either value.
    """
    error = 0.1 / bins
    names = [f"c{i}" for i in range(width)]
    columns = rows.select(*[F.get("__x", F.lit(i)).alias(n) for i, n in enumerate(names)])
    ends = columns.agg(F.count(F.lit(1)).alias("n"), *[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)]).first()
    low, most = ({n: ends[f"{which}_{n}"] for n in names} for which in ("min", "max"))
    at_ends = [F.count_if(F.col(n) == F.lit(v[n])).alias(f"{which}_{n}") for n in names for which, v in (("low", low), ("most", most))]
    counts = columns.agg(*at_ends).first()
    found = {}
    for n in names:
        beyond = counts[f"low_{n}"] - ends["n"] / bins  # rows by which the lower value reaches beyond the first quantile
        if low[n] == most[n]:
            found[n] = []
        elif counts[f"low_{n}"] + counts[f"most_{n}"] == ends["n"] and abs(beyond) > 2 * error * ends["n"] + 2:
            found[n] = [low[n]] if beyond > 0 else []
    asked = [n for n in names if n not in found]
    if asked:
        shares = [(i + 1) / bins for i in range(bins - 1)]
        found |= {n: sorted({x for x in q if x < most[n]}) for n, q in zip(asked, columns.approxQuantile(asked, shares, error))}
    return [np.array(found[n]) for n in names]


_PACKED = ["bins", "y", "w", "ticket", "margin"]
_ROWS = ", ".join(f"{name} binary" for name in _PACKED)


def _binned(edges: Sequence[np.ndarray], starts: np.ndarray, start: float):
    """Rows with their values cut into bins, packed."""
    most = max(1, min(CHUNK_ROWS, CHUNK_CELLS // len(edges)))
    kind = _bin_kind(starts)

    def packed(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        values = [np.concatenate(v) for v in zip(*parts)]
        values.append(np.full(len(values[0]), start))
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values], _PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                some = batch.slice(i, most)
                bins = _cut(_matrix(some.column(0), np.float64), edges).astype(kind)
                kinds = (np.float64, np.float64, np.int64)
                parts.append((bins, *(some.column(1 + j).to_numpy(zero_copy_only=False).astype(k) for j, k in enumerate(kinds))))
                rows += len(bins)
                if rows >= most:
                    yield packed(parts)
                    parts, rows = [], 0
        if parts:
            yield packed(parts)

    return run


def _added(block: Sequence[Tree], starts: np.ndarray):
    """Rows with the trees added to their margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = []
            for bins, *_, margin in _unpacked(batch, starts):
                margin = margin.copy()
                for t in block:
                    margin += t.value[t.walk(bins)]
                margins.append(margin.tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(margins, pa.binary())], _PACKED)

    return run


def _with_trees(rows: DataFrame, block: Sequence[Tree], starts: np.ndarray) -> DataFrame:
    return rows.mapInArrow(_added(block, starts), _ROWS)


def _rewritten(new: DataFrame, old: DataFrame) -> DataFrame:
    """Written anew; the table it came from goes."""
    written = materialise(new, "margins")
    discard(old)
    return written


def _margin_counts(block: Sequence[Tree], starts: np.ndarray):
    """Positives and negatives of a chunk per tree of the block and margin after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bins, label, _, _, margin in _unpacked(batch, starts):
                margin = margin.copy()
                for i, t in enumerate(block):
                    margin += t.value[t.walk(bins)]
                    scores, at = np.unique(margin, return_inverse=True)
                    pos, neg = (pa.array(np.bincount(at[label == y], minlength=len(scores))) for y in (1, 0))
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(scores), pa.int32()), pa.array(scores), pos, neg], ["tree", "score", "pos", "neg"])

    return run


def areas_of(rows: DataFrame, block: Sequence[Tree], starts: np.ndarray) -> list[float | None]:
    """Exact area after every tree of the block, in order; None where a class is missing."""
    counts = rows.mapInArrow(_margin_counts(block, starts), "tree int, score double, pos bigint, neg bigint")
    counts = counts.groupBy("tree", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    found = {r["tree"]: r["auc"] for r in metrics.auc_of_counts(counts, ["tree"]).collect()}  # a row a tree of the block
    return [found.get(i) for i in range(len(found))]


def best_prefix(areas: Sequence[float | None]) -> int:
    """Number of trees up to the first of the largest areas."""
    known = [(-(a if a is not None else 0.0), i + 1) for i, a in enumerate(areas)]
    return min(known)[1]


def stop_after(areas: Sequence[float | None], patience: int) -> int | None:
    """Number of trees after which no area was better for ``patience`` rounds in a row, None if that is not reached."""
    best = 0
    for i, a in enumerate(areas):
        if i == 0 or (a or 0.0) > (areas[best] or 0.0):
            best = i
        elif i - best >= patience:
            return i + 1
    return None


def fit(
    train: DataFrame, columns: Sequence[str], label: str, settings: Settings, weight: str | None = None, valid: DataFrame | None = None
) -> Boosted:
    """Boost up to ``settings.rounds`` trees; with ``valid`` and a patience, stop by the area there and keep the best prefix.

    The columns must be complete; vector columns are allowed. Without training rows there are no trees, and every score is one half.
    """

    def taken(df: DataFrame, weighted: bool) -> DataFrame:
        w = F.col(weight).cast("double") if weighted and weight else F.lit(1.0)
        ready = _assembled(df, columns).select("__x", F.col(label).cast("double").alias("y"), w.alias("w"))
        return ready.filter(F.col("y").isNotNull())

    data = materialise(taken(train, True).withColumn("ticket", F.xxhash64(F.monotonically_increasing_id())), "boost-rows")
    facts = data.agg(F.max(F.size("__x")).alias("width"), F.sum(F.col("w") * F.col("y")).alias("pos"), F.sum(F.col("w")).alias("all"), F.count(F.lit(1)).alias("rows")).first()
    if facts["width"] is None:
        return Boosted(list(columns), [], 0.0, [], [])
    edges = bin_edges(data, facts["width"], settings.bins)
    starts = np.concatenate(([0], np.cumsum([len(e) + 1 for e in edges])))
    share = facts["pos"] / facts["all"] if facts["all"] else 0.5
    start = float(np.log(share / (1 - share))) if settings.from_average and 0 < share < 1 else 0.0

    # Every level reads all rows, so they are dealt out to all cores; wide rows count as several.
    weighed = max(facts["rows"], facts["rows"] * facts["width"] // 64)
    tasks = task_count(data.sparkSession, weighed)
    base = materialise(dealt_out(data, weighed).mapInArrow(_binned(edges, starts, start), _ROWS), "boost-bins")
    discard(data)
    held = None
    if valid is not None and settings.patience is not None:
        values = taken(valid, False).withColumn("ticket", F.lit(0).cast("bigint"))
        held = materialise(values.mapInArrow(_binned(edges, starts, start), _ROWS), "boost-held")

    trees, block, areas = [], [], []
    rows, former = base.persist(), None
    while len(trees) < settings.rounds:
        tree = grow(rows, facts["rows"], tasks, starts, len(trees), settings)
        if former is not None:  # its rows with one more tree are kept by now
            former.unpersist()
            former = None
        trees.append(tree)
        block.append(tree)
        if len(block) < BLOCK and len(trees) < settings.rounds:
            former, rows = rows, _with_trees(rows, [tree], starts).persist()
            continue
        if held is not None:
            areas += areas_of(held, block, starts) or [None] * len(block)
            end = stop_after(areas, settings.patience)
            if end is not None:
                areas = areas[:end]
                break
            held = _rewritten(_with_trees(held, block, starts), held)
        if len(trees) < settings.rounds:
            new = _rewritten(_with_trees(rows, [tree], starts), base)
            rows.unpersist()
            base, block = new, []
            rows = base.persist()
    rows.unpersist()
    keep = best_prefix(areas) if areas else len(trees)
    return Boosted(list(columns), edges, start, trees[:keep], areas)
