import math

import pytest
from pyspark.sql import functions as F

from riskloom.llm import mixing as M
from tests.llm.data import empty, odd


def water(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        target = {s: 2 * sizes[s] if s in full else weight[s] * left / open_ for s in names}
        more = {s for s in names if target[s] > 2 * sizes[s]} - full
        if not more:
            return target
        full |= more


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(3000):
        source = ["a", "b", None, "d", "Z"][int(abs(math.sin(i)) * 5) % 5]
        rows.append((i, "w " * (1 + (i * 7919) % 211 + (2000 if i % 400 == 0 else 0)), source))
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_targets_and_sizes(docs):
    rows = M.mixed(docs).collect()
    sizes = {}
    for r in rows:
        assert r.size == len(r.text.split())
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    target = water(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source], rel=1e-9)
        assert 0 <= r.copies <= 2
    for s in sizes:
        taken = sum(r.size * r.copies for r in rows if r.source == s)
        assert abs(taken - target[s]) <= max(r.size for r in rows if r.source == s)
        assert taken == pytest.approx(target[s], rel=0.05)


def test_rates_meet_the_constraint_with_one_multiplier_per_source(spark, docs):
    sizes = docs.select("source", M.words(F.col("text")).alias("size"))
    counts = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    sources = counts.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    solved = {r.source: r for r in M.multipliers(counts, M.targets(sources)).collect()}
    for s, r in solved.items():
        mine = [c for c in counts.collect() if c.source == s]
        taken = sum(c.n * c.size * min(2.0, math.exp(min(1.0, r.multiplier * c.size / r["mean"]))) for c in mine)
        assert taken == pytest.approx(r.target, rel=1e-5)


def test_reruns_agree(docs):
    one = {r.doc_id: r.copies for r in M.mixed(docs).collect()}
    two = {r.doc_id: r.copies for r in M.mixed(docs.repartition(7)).collect()}
    assert one == two


def test_words_are_runs_of_other_than_blanks(spark):
    texts = ["a b", "  ", None, "", "a\tb\nc\rd\x0be\x0cf", "x y", "\x08a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(M.words(F.col("t")).alias("n")).collect()] == [2, 0, 0, 0, 6, 1, 1]


def test_odd_rows(spark):
    found = M.mixed(odd(spark))
    assert found.columns[-4:] == ["_size", "_source_size", "_target", "_copies"]
    rows = found.collect()
    assert len(rows) == 13 and {r["_copies"] for r in rows if not r["_size"]} == {1}
    again = M.taken(odd(spark))
    assert again.columns == odd(spark).columns
    assert again.count() == sum(r["_copies"] for r in rows)
    assert M.mixed(empty(spark)).count() == 0
