import collections
import random
import re
import zlib

import pytest

from riskloom.llm import spelling as S
from tests.llm.data import empty, odd, prose

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def counted(rows, every=31):
    found = collections.Counter()
    for key, text in rows:
        for run in RUN.findall(low(text)):
            h = zlib.crc32(f"{key if key is not None else ''}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def brute(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


def texts(seed):
    """Words of the accented range in several spellings, some very often, some in chains of ever rarer ones."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefghijéèßÀÿ×") for _ in range(rng.randint(6, 12))) for _ in range(25)]
    words = []
    for w in base:
        words += [w] * rng.choice([2, 30, 500])
        for _ in range(4):
            at = rng.randrange(len(w))
            other = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abéÀ") + w[at:], w[:at] + "ü" + w[at + 1 :]])
            words += [other] * rng.choice([1, 2, 3, 40])
    words += ["fffffffff"] * 2000 + ["ffffffffff"] * 150 + ["fffffffffff"] * 12 + ["ffffffffffff"] * 2
    words += ["Beginning", "bEGINNING", "beginnimg", "beginnimg"] + ["ÀÀÀÀÀÀÀ", "àÀÀÀÀÀÀ"] * 2
    rng.shuffle(words)
    seps = [" ", "\n", ", ", "-", "1", "_", "Ā"]
    rows = []
    for i in range(0, len(words), 50):
        rows.append((i, "".join(w + rng.choice(seps) for w in words[i : i + 50])))
    return rows


@pytest.mark.parametrize("seed", [1])
def test_against_all_pairs(spark, seed):
    rows = texts(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    words = S.vocabulary(df, damage_every=31)
    counts = counted(rows)
    assert {r.word: r.n for r in words.collect()} == counts
    found = [tuple(r) for r in S.variants(words).collect()]
    assert len(found) == len(counts) and set(found) == brute(counts)
    assert any(f is not None and f != root for _, f, root, *_ in found)  # chains are followed


def test_neighbourhood_holds_every_reduced_neighbour():
    """Every word an edit away is named, by one side or the other, and each value once a word."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdefghéèê") for _ in range(rng.randint(1, 5))) for _ in range(400)})
    own = S.keys(words).tolist()
    whose, values = S.neighbourhood(words)
    names = [set() for _ in words]
    for w, v in zip(whose.tolist(), values.tolist()):
        names[w].add(v)
    assert sum(map(len, names)) == len(values)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if i < j and one_edit(a, b):
                assert own[j] in names[i] or own[i] in names[j]


def test_very_long_words(spark):
    long_ = prose(1, 1) + "ab" * 40_000
    rows = [(1, f"{long_} {long_}"), (2, f"{long_}c {long_}c {long_[:700] + long_[701:]}"), (3, long_[:700] + long_[701:])]
    counts = counted(rows, every=None)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in S.variants(S.vocabulary(df)).collect()} == brute(counts)


def test_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in odd(spark).collect()]
    counts = counted(rows)
    assert {tuple(r) for r in S.variants(S.vocabulary(odd(spark), damage_every=31)).collect()} == brute(counts) and counts
    assert S.variants(S.vocabulary(empty(spark), damage_every=31)).count() == 0


def test_clashing_names_and_other_settings(spark):
    names = ["word", "N", "key", "form", "root"]
    df = spark.createDataFrame([(1, "abcd abcd abcd abce", *["x"] * 5)], "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    words = S.vocabulary(df, least_length=4, least_count=1)
    assert {tuple(r) for r in S.variants(words, ratio=3).collect()} == {("abcd", None, "abcd", 3, 1, None), ("abce", "abcd", "abcd", 1, 1, 3)}
    assert {r.form for r in S.variants(words, ratio=4).collect()} == {None}
