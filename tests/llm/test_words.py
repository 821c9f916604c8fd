import random
import re

import numpy as np
import pytest

from riskloom.llm import words as W


def split(text):
    return [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text)]


def test_words_are_runs_of_letters_and_digits():
    texts = [b"", b"One two,three", "déjà vu 12x".encode(), b"...", b"one TWO"]
    h, begin, end, first = W.words(texts)
    assert [list(zip(begin[a:b], end[a:b])) for a, b in zip(first, first[1:])] == [split(t) for t in texts]
    assert h[first[0]] == h[first[4]] and h[first[0] + 1] == h[first[4] + 1]
    assert len(set(h.tolist())) == 6


def test_long_texts_are_cut_alike_in_any_company(monkeypatch):
    monkeypatch.setattr(W, "_CHUNK", 64)
    rng = random.Random(3)
    long_ = " ".join("w%d" % rng.randint(0, 500) for _ in range(200)).encode() + b" " + b"q" * 300 + b" end"
    alone = W.words([long_])
    among = W.words([b"a b", long_, b"c"])
    assert alone[0].tolist() == among[0][2:-1].tolist()
    assert alone[1].tolist() == among[1][2:-1].tolist()
    monkeypatch.setattr(W, "_CHUNK", 1 << 22)
    assert W.words([long_])[0][:150].tolist() == alone[0][:150].tolist()


def test_shingles_of_short_texts():
    h, _, _, first = W.words([b"a b c d e f", b"a b", b"", b"a b c d e", b"b a"])
    s, start = W.shingles(h, first, 5)
    assert np.diff(start).tolist() == [2, 1, 0, 1, 1]
    assert s[0] == s[start[3]] and s[start[1]] != s[start[4]]


def longest_common(a, b, width):
    best = {}
    for i in range(len(a) + 1):
        for j in range(max(0, i - width), min(len(b), i + width) + 1):
            if not i or not j:
                best[i, j] = 0
                continue
            best[i, j] = max(best.get((i - 1, j), 0), best.get((i, j - 1), 0), best.get((i - 1, j - 1), 0) + (a[i - 1] == b[j - 1]))
    return best.get((len(a), len(b)), max(best.values(), default=0))


@pytest.mark.parametrize("seed", range(4))
def test_common_length_matches_plain_alignment(seed):
    rng = np.random.default_rng(seed)
    pairs = []
    for _ in range(60):
        a = rng.integers(0, 6, rng.integers(0, 40)).astype(np.uint64)
        b = a[rng.random(len(a)) < 0.8] if rng.random() < 0.7 else rng.integers(0, 6, rng.integers(0, 40)).astype(np.uint64)
        pairs.append((a, b, 60))
    assert W.common_length(pairs).tolist() == [longest_common(a.tolist(), b.tolist(), 60) for a, b, _ in pairs]


def test_common_length_within_a_narrow_band():
    a = np.arange(100, dtype=np.uint64)
    b = np.concatenate((a[:50], a[53:])) + np.uint64(0)
    assert W.common_length([(a, b, 5)])[0] == 97
