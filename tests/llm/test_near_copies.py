import collections
import random

import pytest

from riskloom.llm import near_copies as N
from riskloom.llm import words as W
from tests.llm.data import empty, odd, prose


def shingle_counts(text):
    w = [m.lower() for m in __import__("re").findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")]
    if len(w) < 5:
        return collections.Counter([tuple(w)] if w else [])
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows):
    """Classes by the share of common shingles (edits here keep the order of words), and links between different texts."""
    texts = sorted({t or "" for _, t in rows})
    sets = [shingle_counts(t) for t in texts]
    label, links = list(range(len(texts))), collections.Counter()

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            common = sum((sets[a] & sets[b]).values())
            whole = sum(sets[a].values()) + sum(sets[b].values()) - common
            if whole and common / whole >= 0.8:
                label[root(a)] = root(b)
                links[a] += 1
                links[b] += 1
    smallest = {}
    place = {t: i for i, t in enumerate(texts)}
    for key, t in rows:
        r = root(place[t or ""])
        smallest[r] = min(smallest.get(r, key), key)
    return {key: smallest[root(place[t or ""])] for key, t in rows}


def edited(text, edits, rng):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = "new%d" % rng.randrange(10**6)
    return " ".join(words)


def table(seed=4):
    rng = random.Random(seed)
    rows = []
    for g in range(12):
        base = prose(100 + g, 150)
        rows.append(base)
        rows += [edited(base, rng.randint(1, 4), rng) for _ in range(rng.randint(0, 6))]
        rows += [base.upper()] * rng.randint(0, 3)
    rows += [prose(500 + i, 60) for i in range(20)] + ["short text", "Short, text!", "text short", "", None, "..."]
    big = prose(999, 120)
    rows += [edited(big, 2, rng) for _ in range(60)]  # a large group of near copies
    rng.shuffle(rows)
    return [(i * 2, t) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return table()


def test_classes_match_brute_force(spark, rows):
    found = N.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.class_id for r in found} == brute(rows)
    texts = {}
    for r in found:  # a text is linked if its class holds another one
        texts.setdefault(r.class_id, set()).add(dict(rows)[r.doc_id] or "")
    assert all((r.n_links > 0) == (len(texts[r.class_id]) > 1) for r in found)


def test_one_of_each(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, sketch string")
    kept = N.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute(rows).values()))


def test_similarity_by_alignment_of_shingles():
    a, b = prose(1, 100).encode(), prose(2, 100).encode()
    moved = b" ".join(a.split()[50:] + a.split()[:50])
    found = N.alike([a, a, a, b"", a], [a, b, moved, b"", a + b" more words"], 0.3)
    assert found[0] == 1 and found[1] == 0 and found[3] == 1
    assert found[2] == pytest.approx(46 / (96 + 96 - 46))  # order matters: only one half can be aligned
    assert found[4] == pytest.approx(96 / 98)


def test_sketch_keeps_text_order():
    a = prose(3, 40)
    (one, two), sizes = N.sketches([a.encode(), " ".join(a.split()[20:] + a.split()[:20]).encode()])
    assert (N.sketches([a.encode()])[0] == one).all() and sizes.tolist() == [36, 36]
    assert (one != two).any()


def test_occurrences_are_told_apart():
    once, many = "a b c d e " * 6, "a b c d e " * 60
    first, second = N.sketches([once.encode(), many.encode()])[0]
    assert (first != second).any()
    h, _, _, f = W.words([many.encode()])
    assert len(h) == 300 and f.tolist() == [0, 300]


def test_odd_rows(spark):
    rows = N.near_copies(odd(spark)).collect()
    assert len(rows) == 13
    by = {r.doc_id: r.class_id for r in rows}
    assert by[1] == by[2] == 1 and by[3] == 3 and by[8] == 8 and by[4] == by[5] == 4
    assert by[None] < 0
    kept = N.one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([1, None, 3, 4, 6, 6, 7, 8, 9], key=str)
    assert N.near_copies(empty(spark)).count() == 0 and N.one_of_each(empty(spark)).count() == 0
