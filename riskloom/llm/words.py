"""Words, word shingles and their hashes as numpy arrays, and banded alignment of such sequences.

A word is a run of ASCII letters and digits or of any bytes above 127 in UTF-8; ASCII capitals count as small letters.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_CHUNK = 1 << 22  # bytes hashed at once, which bounds the arrays whatever a text's length
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_FAR = np.uint64(0x9E3779B97F4A7C15)
IS_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = is_word[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    begin, end = edges[::2], edges[1::2]
    if not len(begin):
        return np.empty(0, np.uint64), begin, end
    sizes = end - begin
    first = np.cumsum(sizes) - sizes
    place = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
    value = _BYTE[data[inside]] * (_PLACE[place & 255] + (place >> 8).astype(np.uint64) * _FAR)
    return mix(np.add.reduceat(value, first) + sizes.astype(np.uint64)), begin, end


def _cuts(data: bytes, is_word: np.ndarray) -> list[int]:
    """Where a long text is cut for hashing: after the last non-word byte of each chunk, counted from the text's start."""
    cuts, at = [0], 0
    while len(data) - at > _CHUNK:
        part = np.frombuffer(data, np.uint8, _CHUNK, at)
        gaps = np.flatnonzero(~is_word[part])
        at += int(gaps[-1]) + 1 if len(gaps) else _CHUNK
        cuts.append(at)
    return cuts + [len(data)]


def words(texts: Sequence[bytes], is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and byte after the last of every word, and the place of each text's first word (one more at the end).

    ``is_word`` tells which of the 256 bytes belong to words.
    """
    found, counts = [], []
    low = 0
    while low < len(texts):
        if len(texts[low]) > _CHUNK:
            text = texts[low].lower()
            cuts = _cuts(text, is_word)
            parts = [(a, _hashed(np.frombuffer(text, np.uint8, b - a, a), is_word)) for a, b in zip(cuts, cuts[1:]) if b > a]
            found += [(h, begin + a, end + a) for a, (h, begin, end) in parts]
            counts.append(sum(len(p[0]) for _, p in parts))
            low += 1
            continue
        high, size = low, 0
        while high < len(texts) and len(texts[high]) <= _CHUNK and (high == low or size + len(texts[high]) < _CHUNK):
            size += len(texts[high]) + 1
            high += 1
        data = np.frombuffer(b"\n".join(texts[low:high]).lower() + b"\n", np.uint8)
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[low:high]])))
        h, begin, end = _hashed(data, is_word)
        first = np.searchsorted(begin, starts)
        of = np.repeat(starts[:-1], np.diff(first))
        found.append((h, begin - of, end - of))
        counts += np.diff(first).tolist()
        low = high
    hashes, begin, end = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3))
    return hashes.astype(np.uint64), begin, end, np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int64)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive words, and the place of each text's first; a text of 1 to k-1 words is one shingle."""
    counts = np.diff(first)
    many = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    start = np.concatenate(([0], np.cumsum(many)))
    text = np.repeat(np.arange(len(counts)), many)
    at = first[text] + np.arange(start[-1]) - start[text]
    left = first[text + 1] - at
    total = np.zeros(len(at), np.uint64)
    for o in range(k):
        here = np.minimum(at + o, len(hashes) - 1)
        total += np.where(o < left, hashes[here] * _PLACE[o], 0).astype(np.uint64) if len(at) else total
    return mix(total), start


def _banded(a: list[int], b: list[int], width: int) -> int:
    """Longest common subsequence on alignments at most ``width`` off the diagonal.

    A row of the alignment is one whole number: its bits are the columns of the band, 0 where the length grows by one. A row follows from the one before by
    an addition whose carries move matches along; the band moves on by one column a row, and a zero that leaves it counts.
    """
    span = 2 * width + 1
    whole, top = (1 << span) - 1, 1 << (span - 1)
    at: dict[int, int] = {}
    for j, value in enumerate(b):
        at[value] = at.get(value, 0) | 1 << (j + width)
    row, count = whole, 0
    for i, value in enumerate(a):
        if i:
            count += not row & 1
            row = row >> 1 | top
        here = at.get(value)
        if here is not None:
            match = row & (here >> i)
            row = (row + match | row - match) & whole
    return count + span - row.bit_count()


def common_length(pairs: Sequence[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Length of the longest common subsequence of each pair (a, b, width), on alignments at most ``width`` off the diagonal.

    Common beginnings and ends are taken off first.
    """
    out = np.zeros(len(pairs), np.int64)
    for i, (a, b, width) in enumerate(pairs):
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        head = int(differ[0]) if len(differ) else n
        a, b = a[head:], b[head:]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
        tail = int(differ[0]) if len(differ) else n
        out[i] = head + tail
        if len(a) > tail and len(b) > tail:
            a, b = a[: len(a) - tail], b[: len(b) - tail]
            out[i] += _banded(a.tolist(), b.tolist(), min(width, max(len(a), len(b))))
    return out
