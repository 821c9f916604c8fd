import math
import random

import pytest
from pyspark.sql import functions as F

from riskloom.llm import topk as K

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k):
    usable = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for place, (q, a) in enumerate(usable):
        if q is None or q % 20:
            continue
        scored = [(sum(x * y for x, y in zip(a, b)), i) for other, (i, b) in enumerate(usable) if other != place]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1]))
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def table(n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.0, 0.3, 0.5]) for _ in range(6)]) for i in range(n)]
    rows += [(n + i, [0.5] * 6) for i in range(200)]  # a third are copies
    rows += [(20000, None), (20020, [0.1, None]), (20040, [float("nan")] * 6), (20060, [float("inf")] * 6), (20080, []), (None, [0.5] * 6), (20, [0.3] * 6), (20100, [0.4, 0.4])]
    return rows


@pytest.mark.parametrize("pivots,block", [(64, 4096), (5, 16), (1, 4096)])
def test_matches_brute_force(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(K, "PIVOTS", pivots)
    monkeypatch.setattr(K, "BLOCK", block)
    rows = table()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)
    found = K.top_k(df, F.col("vec_id") % 20 == 0).collect()
    assert sorted([tuple(r) for r in found], key=str) == brute(rows, 20)


def test_fewer_than_k_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert sorted([tuple(r) for r in K.top_k(df, F.col("vec_id") % 20 == 0).collect()]) == brute(rows, 20)
    assert K.top_k(df.filter("vec_id > 5"), F.col("vec_id") % 20 == 0).count() == 0
    assert K.top_k(df, F.col("vec_id") > 5).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(0, [1e6, -1e6, 3.0]), (1, [1e6, 1e6, 0.015625]), (2, [-1e6, 2e6, 0.03125]), (3, [1e6, 1e6, 0.03125])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<double>, label int")
    assert sorted([tuple(r) for r in K.top_k(df, F.col("vec_id") % 20 == 0).collect()], key=str) == brute(rows, 20)
