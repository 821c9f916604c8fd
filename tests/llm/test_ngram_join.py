import random
import re

import numpy as np
import pytest

from riskloom.llm import ngram_join as J
from tests.llm.data import empty, odd, prose

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text):
    w = BLANK.findall(low(text))
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    """n_shingles and component by comparing every two documents."""
    sets = [shingle_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                top[root(a)] = root(b)
    smallest = {}
    for i, (key, _) in enumerate(rows):
        smallest[root(i)] = min(smallest.get(root(i), key), key)
    return {(key, len(sets[i]), smallest[root(i)]) for i, (key, _) in enumerate(rows)}


def edited(text, edits, rng):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = "new%d" % rng.randrange(10**6)
    return " ".join(words)


def table(seed, groups=25, copies=8):
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        base = prose(100 * seed + g, rng.choice([5, 8, 9, 10, 12, 20, 60, 200, 700]))
        texts.append(base)
        for _ in range(rng.randint(0, copies)):
            n = len(base.split())
            texts.append(edited(base, rng.randint(0, max(1, n // 25)), rng))
            if rng.random() < 0.4:
                texts.append(base + " " + prose(rng.randrange(10**6), rng.randint(1, max(1, n // 6))))
            if rng.random() < 0.3:
                texts.append(base.upper().replace(" ", "\n"))
    texts += ["a b c", "A b  c", "a b", "a", "a b c d", "", None, " \t\r\n", " "]
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)


def result(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("seed", [1])
def test_against_all_pairs(spark, seed):
    rows = table(seed)
    found = result(J.linked_documents(frame(spark, rows)))
    assert len(found) == len(rows) and set(found) == brute(rows)


def test_blocks_cut_into_tiles(spark, monkeypatch):
    """A block far larger than a tile: near copies of three lengths, chained, with tiles of eight sets."""
    monkeypatch.setattr(J, "TILE_SETS", 8)
    rng = random.Random(5)
    base = prose(77, 300)
    texts = [edited(base, rng.randint(0, 12), rng) for _ in range(60)]
    texts += [edited(base + " " + prose(78, 40), rng.randint(0, 8), rng) for _ in range(40)]
    texts += [edited(base + " " + prose(78, 40) + " " + prose(79, 45), rng.randint(0, 8), rng) for _ in range(20)]
    rows = list(enumerate(texts))
    assert set(result(J.linked_documents(frame(spark, rows)))) == brute(rows)


def test_sets_alike_always_meet():
    """Every pair alike has a key in common, at every size, also where members clump into few parts."""
    rng = np.random.default_rng(3)
    for size in [6, 7, 8, 9, 11, 12, 13, 14, 18, 19, 20, 28, 29, 41, 42, 94, 300]:
        for _ in range(300 if size < 30 else 30):
            whole = np.unique(rng.integers(0, 1 << 63, size + 12, dtype=np.uint64))
            common = rng.permutation(whole)
            extra = size * 15 // 100 + 1
            one = np.sort(common[:size])
            cut = rng.integers(0, extra + 1)
            two = np.sort(common[cut : size + min(int(rng.integers(0, extra + 1)), 12)])
            both = len(np.intersect1d(one, two))
            if 100 * both >= 85 * (len(one) + len(two) - both):
                a, b = J.meeting_keys([one, two])
                assert len(np.intersect1d(a, b)), (size, len(one), len(two), both)


def test_bitmaps_bound_overlap_from_above():
    rng = random.Random(1)
    base = prose(5, 400)
    sets = J.sets_of([edited(base, e, rng).encode() for e in (0, 5, 20, 60, 200, 400)] + [prose(6, 90).encode()])
    maps = [J.bitmap(s) for s in sets]
    assert len(maps[-1]) < len(maps[0])
    for a, m in zip(sets, maps):
        for b, n in zip(sets, maps):
            width = min(len(m), len(n))
            assert np.bitwise_count(J._folded(m, width) ^ J._folded(n, width)).sum() <= len(np.setxor1d(a, b))


def test_no_pair_alike_falls_to_bit_counts():
    rng = random.Random(9)
    base = prose(5, 300).split()
    texts = [" ".join(base[: rng.randint(200, 300)]) for _ in range(40)] + [edited(" ".join(base[:255]), 2, rng) for _ in range(20)]
    sets = sorted(J.sets_of([t.encode() for t in texts]), key=len)
    maps = [J.bitmap(s) for s in sets]
    assert len({len(m) for m in maps}) == 2
    _, i, j = J.within_bound(np.array([len(s) for s in sets]), maps, np.zeros(len(sets), int))
    open_ = set(zip(i.tolist(), j.tolist()))
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                assert (a, b) in open_


def test_links_connect_as_all_links_would():
    rng = random.Random(2)
    sets = J.sets_of([edited(prose(6 + i % 3, 100), rng.randint(0, 4), rng).encode() for i in range(30)])
    found = J.linked(sets, np.zeros(30, int))
    assert len(found) < 30 and all(i % 3 == j % 3 for i, j in found)
    for i, j in found:
        both = len(np.intersect1d(sets[i], sets[j]))
        assert 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both)
    sides = np.array([i % 2 for i in range(30)])
    assert all(sides[i] != sides[j] for i, j in J.linked(sets, sides))


def test_other_thresholds(spark):
    rows = table(3, groups=12, copies=5)
    found = {r[0]: r[2] for r in result(J.linked_documents(frame(spark, rows), least=(5, 10)))}
    sets = {k: shingle_set(t) for k, t in rows}
    for a, _ in rows:
        for b, _ in rows:
            if sets[a] and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]):
                assert found[a] == found[b]


def test_odd_rows(spark):
    found = result(J.linked_documents(odd(spark)))
    assert len(found) == 13
    by = {}
    for key, n, component in found:
        by.setdefault(key, set()).add((n, component))
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[8] == {(0, 8)}
    assert by[4] == by[5] and {c for _, c in by[4]} == {4}
    assert {c for _, c in by[None]} == {None} and by[3] == {(1, 3)} and by[9] == {(1, 9)}
    assert {c for _, c in by[6]} == {6} and len(by[6]) == 2
    assert result(J.linked_documents(empty(spark))) == []


def test_extra_columns_with_clashing_names(spark):
    names = ["node", "Body", "n", "keys", "label", "tile", "doc"]
    df = spark.createDataFrame([(1, "a b c d e", *["x"] * 7), (2, "A b c d e", *["y"] * 7)], "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    assert sorted(result(J.linked_documents(df))) == [(1, 2, 1), (2, 2, 1)]
