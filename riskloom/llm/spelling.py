"""Grouping spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to a few symbols. If two words differ by one inserted, deleted or replaced letter, so do their reduced forms, or these
are equal. Each distinct reduced word therefore names its one-edit neighbourhood, and the reduced vocabulary is joined with
that; the words behind the reduced ones are then held against each other as they are written. An edit can be undone, so
of every two neighbours only one has to name the other: a word names what it gives by a deletion or by a replacement with a
higher symbol. Neighbours travel as 64-bit values that follow from a word's prefix sums, never as text, so a word of n letters costs n * symbols / 2
values however long it is; values that agree by chance are told apart by the words.

A word's form is the most frequent word one edit away, where that is so many times as frequent. Forms are followed to
the last by jumps that double in length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import named, small_batches
from riskloom.llm.groups import perhaps_named
from riskloom.llm.words import mix
from riskloom.session import materialise

SYMBOLS = 8
LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
_ROWS = 10_000  # words per Arrow batch
_AT_ONCE = 1 << 18  # letters worked on at once
_BASE = 0x5851F42D4C957F2D
_BACK = pow(_BASE, -1, 1 << 64)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _runs(text: Column, least_length: int) -> Column:
    """The maximal runs of at least so many letters, A-Z as a-z. A shorter run is skipped by the pattern itself."""
    found = F.regexp_extract_all(text, F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_length},}}"), F.lit(0))
    return F.transform(found, lambda w: F.when(w.rlike("[A-Z]"), F.translate(w, _UPPER, _LOWER)).otherwise(w))


def damaged(run: Column, key: Column, every: int) -> Column:
    """The run without one letter, if the checksum of key and run is a multiple of ``every``; the checksum picks the letter."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run).cast("bigint")).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def vocabulary(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    damage_every: int | None = None,
) -> DataFrame:
    """(word, n) of all words of at least so many letters that occur at least so often in all texts.

    ``damage_every`` plants misspellings: see ``damaged``. A missing key counts as empty there. Null and empty texts have no words; repeated rows count
    as often as they occur.
    """
    words = df.select(named(key).alias("key"), F.explode(_runs(named(text), least_length)).alias("word"))
    if damage_every:
        words = words.select(damaged(F.col("word"), F.col("key"), damage_every).alias("word"))
        words = words.filter(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def reduced(words: list[str], symbols: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbol and place in its word of every letter, where words begin (one more at the end), and powers of the base by place."""
    points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
    first = np.concatenate(([0], np.cumsum([len(p) for p in points])))
    letters = np.concatenate(points) if points else np.empty(0, np.uint32)
    place = np.arange(len(letters)) - np.repeat(first[:-1], np.diff(first))
    power = np.cumprod(np.full(int(place.max(initial=0)) + 1, _BASE, np.uint64)) * np.uint64(_BACK)
    return (letters % symbols).astype(np.int64), place, first, power


def _values(symbol, place, first, power) -> tuple[np.ndarray, np.ndarray]:
    """Each letter's term of its word's value, and the values; words have at least one letter."""
    term = (symbol + 1).astype(np.uint64) * power[place]
    return term, np.add.reduceat(term, first[:-1])


def keys(words: list[str], symbols: int = SYMBOLS) -> np.ndarray:
    """The value of every reduced word."""
    return mix(_values(*reduced(words, symbols))[1])


def neighbourhood(words: list[str], symbols: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """(which word, value) of every reduced word itself, what it gives by a deletion, and by a replacement with a higher symbol."""
    symbol, place, first, power = reduced(words, symbols)
    term, value = _values(symbol, place, first, power)
    of = np.repeat(np.arange(len(words)), np.diff(first))
    upto = np.cumsum(term)  # wraps around like all sums here
    before = upto - term - (upto[first[:-1]] - term[first[:-1]])[of]
    after = value[of] - before - term
    again = (place > 0) & (symbol == np.concatenate(([-1], symbol[:-1])))  # deleting either of two equal symbols gives the same
    whose, found = [np.arange(len(words)), of[~again]], [value, (before + after * np.uint64(_BACK))[~again]]
    for up in range(1, symbols):
        here = symbol + up < symbols
        whose.append(of[here])
        found.append(value[of[here]] + np.uint64(up) * power[place[here]])
    return np.concatenate(whose), mix(np.concatenate(found))


def _portions(words: list[str]) -> Iterator[list[str]]:
    low = 0
    while low < len(words):
        high, size = low, 0
        while high < len(words) and (high == low or size + len(words[high]) <= _AT_ONCE):
            size += len(words[high])
            high += 1
        yield words[low:high]
        low = high


def _keyed(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            found = np.concatenate([keys(part, symbols) for part in _portions(words)]) if words else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["word", "n", "key"])

    return run


def _neighbours(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            at = 0
            for part in _portions(batch.column(1).to_pylist()):
                whose, found = neighbourhood(part, symbols)
                yield pa.RecordBatch.from_arrays([pa.array(own[at + whose]), pa.array(found.view(np.int64))], ["source", "key"])
                at += len(part)

    return run


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """Every two words one inserted, deleted or replaced letter apart: a, n_a, b, n_b, once. Words (word, n) are distinct and not empty."""
    small_batches(words.sparkSession, _ROWS)
    known = materialise(words.select("word", "n").mapInArrow(_keyed(symbols), "word string, n bigint, key bigint"), "words")
    sources = known.groupBy("key").agg(F.min("word").alias("word"))
    named_ = sources.mapInArrow(_neighbours(symbols), "source bigint, key bigint")
    named_ = perhaps_named(named_, F.col("key"), known, "key")
    right = known.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
    left = known.select(F.col("key").alias("source"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    met = named_.join(right, "key").join(left, "source")
    met = met.filter((F.col("source") != F.col("key")) | (F.col("a") < F.col("b")))
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")


def _last(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last one. Jumps double, so chains of n forms take log n rounds."""
    jumps = materialise(forms.select("word", F.col("form").alias("root")), "jumps")
    while True:
        further = jumps.select(F.col("word").alias("at"), F.col("root").alias("to"))
        ahead = jumps.join(further, F.col("root") == F.col("at"), "left")
        ahead = materialise(ahead.select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "jumps")
        jumps = ahead.select("word", "root")
        if ahead.filter("moved").isEmpty():
            return jumps


def variants(words: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """One row per word of (word, n): n_near words one edit away, the form among them and how often that occurs, and the root.

    The form is the near word of largest n, of equal ones the smallest in code-point order, if its n is at least ``ratio`` times the word's;
    otherwise it is null, and the word is its own root. ``ratio`` is above 1, so forms never run in a circle. No rows give no rows.
    """
    words = materialise(words.select("word", "n"), "vocabulary")
    pairs = materialise(near_pairs(words, symbols), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m"))
    )
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    found = words.join(best, "word", "left")
    much = -F.col("best.less") >= ratio * F.col("n")
    found = found.select(
        "word",
        F.when(much, F.col("best.other")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(much, -F.col("best.less")).alias("form_n"),
    )
    found = materialise(found, "forms")
    roots = _last(found.filter(F.col("form").isNotNull()))
    out = found.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


