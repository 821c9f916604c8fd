import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from riskloom.llm import manifest as M
from tests.llm.data import SCHEMA, empty, odd


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def low(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def leaf(doc_id, text, lang, source, n_chars):
    values = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return sha(*values)


def climbed(leaves, fanout):
    """Root of a list of digests and, per leaf, the (before, after) of every level."""
    paths = [[] for _ in leaves]
    at, level = list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for i, p in enumerate(paths):
            run, place = runs[at[i] // fanout], at[i] % fanout
            p.append(("".join(run[:place]), "".join(run[place + 1 :])))
            at[i] //= fanout
        level = [sha(*run) for run in runs]
    return level[0], paths


def brute(rows, fanout=16):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0], leaf(*r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = climbed([x[1] for x in by[s]], fanout)
    root, tops = climbed([trees[s][0] for s in order], fanout)
    out = []
    for s, top in zip(order, tops):
        for (key, digest, r), path in zip(by[s], trees[s][1]):
            path = path + top
            now = digest
            if key is not None and zlib.crc32(str(key).encode()) % 5 == 0:
                now = leaf(r[0], low(r[1]), *r[2:])
            for before, after in path:
                now = sha(before, now, after)
            out.append((key, digest, trees[s][0], root, sha(*[b + a for b, a in path]), now, now == root))
    return collections.Counter(out)


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def documents(seed, sizes):
    rng = random.Random(seed)
    rows, key = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            key += rng.randint(1, 9)
            rows.append((key, rng.choice(["Some Text ÀB", "no capitals", "", None, "1:-"]), rng.choice(["en", None]), source, rng.choice([key, None])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{"a": 300, None: 17, "b": 1, "é": 16, "Z": 33}, {"a": 1}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_against_trees_built_in_memory(spark, sizes):
    rows = documents(1, sizes)
    found = rows_of(M.proved_documents(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert found == brute(rows)
    assert {f[-1] for f in found} == ({True, False} if len(rows) > 1 else {f[-1] for f in found})


def test_odd_rows(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in odd(spark).collect()]
    assert rows_of(M.proved_documents(odd(spark))) == brute(rows)
    assert M.proved_documents(empty(spark)).collect() == []


def test_values_do_not_run_together(spark):
    df = spark.createDataFrame([("1", "23"), ("12", "3"), (None, "-"), ("-", None)], "a string, b string")
    assert df.select(M.leaf_digest([F.col("a"), F.col("b")]).alias("h")).distinct().count() == 4


def test_intervals_nest(spark):
    leaves = spark.range(700).select(
        F.lit(0).alias("tree"), F.lit(700).cast("bigint").alias("size"), F.col("id").alias("lo"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("digest"), F.col("id").alias("payload")
    )
    nodes = M.build(leaves, 4).nodes().collect()
    by = collections.defaultdict(list)
    for n in nodes:
        by[n.level].append(n)
    assert [len(by[level]) for level in sorted(by)] == [700, 175, 44, 11, 3, 1]
    for level in range(5):
        for parent in by[level + 1]:
            inside = sorted((n for n in by[level] if parent.lo <= n.lo and n.hi <= parent.hi), key=lambda n: n.lo)
            assert inside[0].lo == parent.lo and inside[-1].hi == parent.hi and len(inside) <= 4
            assert all(a.hi == b.lo for a, b in zip(inside, inside[1:])) and sha(*[n.digest for n in inside]) == parent.digest
