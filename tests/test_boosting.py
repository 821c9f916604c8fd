import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import boosting as B
from riskloom.operators import metrics, models, split

COLUMNS = ["a", "b", "c"]


def table(spark, n, values, noise):
    def number(salt, below):
        return F.pmod(F.xxhash64("row_id", F.lit(salt)), F.lit(below))

    df = spark.range(n).select(F.col("id").alias("row_id"))
    df = df.select("row_id", *[(number(i, values) / values).alias(c) for i, c in enumerate(COLUMNS)], (number(9, 1000) / 1000).alias("u"))
    wrong = F.col("u") < noise
    return df.withColumn("y", F.when(F.col("a") + F.col("b") > 1, 1 - wrong.cast("int")).otherwise(wrong.cast("int"))).drop("u")


@pytest.fixture(scope="module")
def small(spark):
    rows = table(spark, 400, 13, 0.2)
    return rows, rows.toPandas()


@pytest.fixture(scope="module")
def parts(spark):
    return split.modulo_split(table(spark, 4000, 1000, 0.1), 0.2)


def settings(**changes):
    return B.Settings(**({"rounds": 3, "step": 0.3, "depth": 4, "min_hessian": 0.5} | changes))


class Exhaustive:
    """The same trees by trying every column and value on rows held in memory, one leaf after the other."""

    def __init__(self, pandas, s, start=0.0):
        self.x, self.y, self.s = pandas[COLUMNS].to_numpy(), pandas["y"].to_numpy(float), s
        self.margin = np.full(len(self.y), start)

    def split(self, rows, g, h):
        best = None
        worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + self.s.penalty)
        for j in range(self.x.shape[1]):
            for v in np.unique(self.x[:, j])[:-1]:
                left, right = rows & (self.x[:, j] <= v), rows & (self.x[:, j] > v)
                if min(left.sum(), right.sum()) < self.s.min_rows or min(h[left].sum(), h[right].sum()) < self.s.min_hessian:
                    continue
                gain = worth(left) + worth(right) - worth(rows)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, j, v, left, right)
        return best

    def tree(self):
        """Leaves as sets of rows, having changed the margins."""
        p = 1 / (1 + np.exp(-self.margin))
        g, h = np.rint((p - self.y) * 2**24) / 2**24, np.rint(p * (1 - p) * 2**24) / 2**24
        everything = np.ones(len(self.y), bool)
        leaves = [(0, everything, self.split(everything, g, h))]
        while self.s.leaves is None or len(leaves) < self.s.leaves:
            ready = [(i, leaf) for i, leaf in enumerate(leaves) if leaf[2] is not None and leaf[0] < self.s.depth]
            if not ready:
                break
            i, (depth, _, (_, _, _, left, right)) = max(ready, key=lambda x: x[1][2][0])
            leaves[i : i + 1] = [(depth + 1, r, self.split(r, g, h)) for r in (left, right)]
        for _, rows, _ in leaves:
            self.margin[rows] -= self.s.step * g[rows].sum() / (h[rows].sum() + self.s.penalty)
        return {frozenset(np.flatnonzero(rows).tolist()) for _, rows, _ in leaves}


@pytest.mark.parametrize("leaves, penalty, task_rows", [(None, 1.0, 0), (5, 0.0, 0), (7, 1.0, 0), (7, 1.0, 1000), (None, 0.0, 90)])
def test_splits_equal_an_exhaustive_search(small, monkeypatch, leaves, penalty, task_rows):
    """Level by level, in one task, and with the lower nodes finished in tasks."""
    monkeypatch.setattr(B, "TASK_ROWS", task_rows)
    rows, pandas = small
    s = settings(leaves=leaves, penalty=penalty, min_rows=5)
    model = B.fit(rows.repartition(3), COLUMNS, "y", s)
    brute = Exhaustive(pandas, s)
    bins = B._cut(pandas[COLUMNS].to_numpy(), model.edges)
    assert len(model.trees) == 3
    for tree in model.trees:
        ends = tree.walk(bins.astype(np.int64))
        assert {frozenset(np.flatnonzero(ends == e).tolist()) for e in np.unique(ends)} == brute.tree()
        assert leaves is None or tree.leaves() <= leaves
    scored = {r["row_id"]: r["p"] for r in model.score(rows).collect()}
    assert np.allclose([scored[i] for i in pandas["row_id"]], 1 / (1 + np.exp(-brute.margin)), atol=1e-9)


def test_a_fit_does_not_depend_on_partitions(small):
    rows, _ = small
    one, other = (B.fit(rows.coalesce(1) if n == 1 else rows.repartition(n, "c"), COLUMNS, "y", settings(leaves=6)) for n in (1, 5))
    for a, b in zip(one.trees, other.trees):
        assert (a.column == b.column).all() and (a.bin == b.bin).all() and (a.value == b.value).all()


def grown(gains, columns):
    """A full tree of these nodes in level order; column -1 is a leaf."""
    tree = B._Growing()
    for i, (gain, column) in enumerate(zip(gains, columns)):
        tree.add(np.array([[0.0], [1.0], [1.0]]), 1)
        tree.gain[i], tree.column[i] = gain, column
        if column >= 0:
            tree.left[i], tree.right[i] = 2 * i + 1, 2 * i + 2
    return tree


def test_small_gains_are_cut_from_the_leaves_up():
    """Random trees against cutting, again and again, any split of small gain with two leaves below."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        gains = rng.random(31) * 0.2
        columns = np.where(rng.random(31) < 0.8, 0, -1)
        columns[15:] = -1
        for i in range(1, 31):
            if columns[(i - 1) // 2] < 0:
                columns[i] = -1
        tree = grown(gains, columns.tolist())
        B.cut_small_gains(tree, 0.098)
        left = columns.copy()
        while True:
            ends = [i for i in range(15) if left[i] >= 0 and left[2 * i + 1] < 0 and left[2 * i + 2] < 0 and gains[i] < 0.098]
            if not ends:
                break
            left[ends[0]] = -1
        assert [c >= 0 for c in tree.column] == [c >= 0 for c in left]


def test_threshold_cuts_splits_and_keeps_the_signal(parts):
    train, valid = parts
    free, cut = (B.fit(train, COLUMNS, "y", settings(min_gain=g, depth=6, penalty=1.0)) for g in (0.0, 8.0))
    assert sum(t.leaves() for t in cut.trees) < sum(t.leaves() for t in free.trees)
    for t in cut.trees:
        ends = t.column < 0
        inner = np.flatnonzero(~ends)
        assert all(t.gain[i] >= 8.0 for i in inner if ends[t.left[i]] and ends[t.right[i]])
    assert metrics.auc(cut.score(valid), "y").first()["auc"] > 0.85


def test_best_first_takes_the_most_gain_there_is():
    gains = [1.0, 5.0, 4.0, 0.5, 9.0, 0.1, 3.0] + [0.0] * 8
    tree = grown(gains, [0] * 7 + [-1] * 8)
    B.keep_best_first(tree, 5)
    assert [i for i in range(7) if tree.column[i] >= 0] == [0, 1, 2, 4]


def test_prefix_is_that_of_scoring_every_prefix_anew(parts):
    """Areas from margins block by block equal those of scoring each prefix from the start, and the best one is kept."""
    train, valid = parts
    s = settings(rounds=200, step=0.5, patience=7, subsample=0.5, penalty=1.0)
    model = B.fit(train, COLUMNS, "y", s, valid=valid)
    areas = model.areas
    full = B.fit(train, COLUMNS, "y", B.replace(s, rounds=len(areas), patience=None))
    anew = [metrics.auc(full.prefix(i + 1).score(valid), "y").first()["auc"] for i in range(len(areas))]
    assert np.allclose(areas, anew, atol=1e-9)
    best = max(range(len(anew)), key=lambda i: (anew[i], -i)) + 1
    assert len(model.trees) == best and len(areas) == best + 7 < 200
    assert all((a.column == b.column).all() for a, b in zip(model.trees, full.trees))


def test_stop_and_prefix_of_given_areas():
    areas = [0.5, 0.7, 0.6, 0.7, 0.65, 0.8, 0.8, 0.79, 0.8]
    assert B.stop_after(areas, 3) == 5 and B.stop_after(areas, 4) is None and B.best_prefix(areas) == 6
    assert B.stop_after([None, 0.5, None], 1) == 3 and B.best_prefix([None, 0.5, None]) == 2


def test_slow_boosting_keeps_to_its_limits(parts):
    train, valid = parts
    model = models.fit("gbt_slow", train, COLUMNS, "y", rounds=20, valid=valid)
    assert all(t.leaves() <= 32 for t in model.trees) and max(t.leaves() for t in model.trees) > 8
    assert metrics.auc(models.score(model, valid), "y").first()["auc"] > 0.85


def test_subsample_draws_rows_anew_for_every_tree():
    tickets = np.arange(20_000)
    draws = [B.drawn(tickets, t, 0.5, 3) for t in range(3)]
    assert all(abs(d.mean() - 0.5) < 0.02 for d in draws) and all(abs((draws[0] == d).mean() - 0.5) < 0.02 for d in draws[1:])
    assert B.drawn(tickets, 0, 1.0, 3).all()


def test_saved_model_scores_the_same(parts, tmp_path):
    train, valid = parts
    model = models.fit("gbt", train, COLUMNS, "y", rounds=3)
    models.save(model, str(tmp_path / "m"))
    loaded = models.load(str(tmp_path / "m"))
    a, b = ([r["p"] for r in models.score(m, valid).orderBy("row_id").collect()] for m in (model, loaded))
    assert a == b


def test_odd_tables(spark, small):
    rows, _ = small
    none = rows.filter("row_id < 0")
    assert {r["p"] for r in B.fit(none, COLUMNS, "y", settings()).score(rows).collect()} == {0.5}
    model = B.fit(rows.withColumn("y", F.lit(1)), ["a"], "y", settings(), valid=none)
    assert model.score(none).collect() == [] and all(r["p"] > 0.5 for r in model.score(rows).collect())
    flat = B.fit(rows.withColumn("k", F.lit(2.0)), ["k"], "y", settings())
    assert flat.score(rows.withColumn("k", F.lit(7.0))).select("p").distinct().count() == 1


def test_too_many_sums_are_refused(small, monkeypatch):
    monkeypatch.setattr(B, "TASK_ROWS", 0)
    monkeypatch.setattr(B, "MOST_SUMS", 20)
    with pytest.raises(ValueError, match="fewer bins"):
        B.fit(small[0], COLUMNS, "y", settings())


def test_children_that_need_no_sums_take_no_job(small, monkeypatch):
    """The last level's totals follow from their parents' sums, and so do those of nodes finished in tasks."""
    rows, _ = small
    asked, real = [], B._level_sums

    def counted(*args):
        asked.append(args)
        return real(*args)

    monkeypatch.setattr(B, "_level_sums", counted)
    for depth, task_rows, jobs in ((1, 0, 1), (2, 0, 2), (4, 399, 1)):
        monkeypatch.setattr(B, "TASK_ROWS", task_rows)
        asked.clear()
        B.fit(rows, COLUMNS, "y", settings(rounds=1, depth=depth))
        assert len(asked) == jobs


def test_chunks_and_where_sums_meet_change_no_tree(small, monkeypatch):
    rows, _ = small
    monkeypatch.setattr(B, "TASK_ROWS", 150)
    one = B.fit(rows, COLUMNS, "y", settings(rounds=2))
    monkeypatch.setattr(B, "CHUNK_ROWS", 30)
    monkeypatch.setattr(B, "FEW_SUMS", 0)
    other = B.fit(rows.repartition(3), COLUMNS, "y", settings(rounds=2))
    for a, b in zip(one.trees, other.trees, strict=True):
        assert (a.column == b.column).all() and (a.bin == b.bin).all() and (a.value == b.value).all() and (a.rows == b.rows).all()


def test_edges_of_two_valued_columns_are_counted(spark, monkeypatch):
    """The same edges as by quantiles, which are asked only where counts don't tell."""
    rows = spark.range(5000).select(F.array(*[F.expr(f"CAST({e} AS DOUBLE)") for e in ("id % 2", "7", "id % 1000 = 0", "id % 1000 > 0", "id % 255 > 0", "id % 9")]).alias("__x"))
    asked, real = [], type(rows).approxQuantile

    def watched(df, names, shares, error):
        asked.append(list(names))
        return real(df, names, shares, error)

    monkeypatch.setattr(type(rows), "approxQuantile", watched)
    edges = B.bin_edges(rows, 6, 255)
    assert asked == [["c4", "c5"]]
    assert [e.tolist() for e in edges[:4] + edges[5:]] == [[0.0], [], [0.0], [], [float(i) for i in range(8)]]
