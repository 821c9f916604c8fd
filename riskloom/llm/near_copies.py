"""Near-duplicate documents by order MinHash on five-word shingles, verified by banded alignment.

Each of several hash functions picks the few smallest occurrence-labelled shingles of a text and keeps them in text order, so
two texts agree where they share content in the same order. Texts that agree on one function meet in a bucket and are aligned
with the bucket's hub, not with each other: what no hub explains meets further hubs, each compared with the whole bucket.
Similarity is the number of shingles in the best alignment over the number of shingles in either text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import free_name, named, small_batches
from riskloom.llm.groups import components, hub_links, perhaps_named
from riskloom.llm.words import common_length, mix, shingles, words
from riskloom.session import materialise

SHINGLE = 5
LEAST = 0.8
FUNCTIONS = 16  # a pair of similarity 0.8 misses all of them with a chance of about 1 in 100,000
KEPT = 3  # smallest shingles per function
MAPS = 8  # 64-bit words of a text's bitmap of shingles
_CHUNK = 1 << 22  # bytes of text aligned at once
_ROWS = 100  # per Arrow batch, as pairs of very long texts travel together


def encoded(texts) -> list[bytes]:
    return [t.encode("utf-8", "replace") for t in texts]


def _labels(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every shingle, text after text, and how many each text has; the n-th occurrence of one in its text is told apart from the others."""
    hashes, _, _, first = words(texts)
    shingle, start = shingles(hashes, first, k)
    many = np.diff(start)
    if not len(shingle):
        return shingle, many
    text = np.repeat(np.arange(len(texts)), many)
    joint = mix(shingle + mix(text.astype(np.uint64)))
    order = np.argsort(joint, kind="stable")
    fresh = np.concatenate(([True], joint[order][1:] != joint[order][:-1]))
    run = np.flatnonzero(fresh)
    nth = np.empty(len(order), np.uint64)
    nth[order] = (np.arange(len(order)) - np.repeat(run, np.diff(np.append(run, len(order))))).astype(np.uint64)
    return mix(shingle + nth * np.uint64(0x9E3779B97F4A7C15)), many


def _bitmaps(label: np.ndarray, many: np.ndarray) -> np.ndarray:
    """64 * MAPS bits per text: each tells whether an odd number of its shingles falls on it, so two texts differ in as many shingles or more."""
    text = np.repeat(np.arange(len(many)), many)
    at = text * 64 * MAPS + (mix(label) % np.uint64(64 * MAPS)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(many) * 64 * MAPS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(many), 64 * MAPS), axis=1).view(np.int64)


def sketches(texts: list[bytes], functions: int = FUNCTIONS, kept: int = KEPT, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """One signed 64-bit value per text and function, see the module, and how many shingles each has; without any the values mean nothing."""
    label, many = _labels(texts, k)
    return _sketches(label, many, functions, kept), many


def _sketches(label: np.ndarray, many: np.ndarray, functions: int, kept: int) -> np.ndarray:
    out = np.zeros((len(many), functions), np.uint64)
    full = np.flatnonzero(many)
    if not len(full):
        return out.view(np.int64)
    counts, begin = many[full], (np.cumsum(many) - many)[full]
    text = np.repeat(np.arange(len(full)), counts)
    top = np.iinfo(np.uint64).max
    for f in range(functions):
        value = mix(label ^ mix(np.uint64([f + 1])))
        places = np.full((len(full), kept), len(label))
        for round_ in range(kept):
            least = np.minimum.reduceat(value, begin)
            hit = np.flatnonzero((value == np.repeat(least, counts)) & (value != top))
            places[text[hit[::-1]], round_] = hit[::-1]
            value[hit] = top
        places.sort(axis=1)
        total = np.zeros(len(full), np.uint64)
        for c in range(kept):
            here = places[:, c]
            total = mix(total + np.where(here < len(label), label[np.minimum(here, len(label) - 1)], 0).astype(np.uint64) + np.uint64(1))
        out[full, f] = total
    return out.view(np.int64)


def alike(left: list[bytes], right: list[bytes], least: float = LEAST, k: int = SHINGLE) -> np.ndarray:
    """Similarity of each pair of texts by banded alignment of their shingles; 0 where it is below ``least``.

    A pair of at least that similarity can't leave the band. Pairs whose shingles alone show that they fall short aren't aligned.
    """
    out = np.zeros(len(left))
    low = 0
    while low < len(left):  # so many bytes at a time, whatever the texts' length
        high, size = low, 0
        while high < len(left) and (high == low or size + len(left[high]) + len(right[high]) <= _CHUNK):
            size += len(left[high]) + len(right[high])
            high += 1
        out[low:high] = _alike(left[low:high], right[low:high], least, k)
        low = high
    return out


def _alike(left: list[bytes], right: list[bytes], least: float, k: int) -> np.ndarray:
    places: dict[bytes, int] = {}  # a hub's text meets many others
    one, two = ([places.setdefault(t, len(places)) for t in side] for side in (left, right))
    hashes, _, _, first = words(list(places))
    shingle, start = shingles(hashes, first, k)
    parts = [shingle[x:y] for x, y in zip(start, start[1:])]
    known: dict[int, tuple] = {}

    def counted(i: int) -> tuple:
        if i not in known:
            known[i] = np.unique(parts[i], return_counts=True)
        return known[i]

    out = np.zeros(len(left))
    asked = []
    for row, (i, j) in enumerate(zip(one, two, strict=True)):
        n, m = len(parts[i]), len(parts[j])
        if not n or not m:
            out[row] = float(n == m)
            continue
        if min(n, m) < least * max(n, m):
            continue
        if i != j:
            needed = least / (1 + least) * (n + m) - 1e-9
            (values, counts), (other, others) = counted(i), counted(j)
            _, x, y = np.intersect1d(values, other, assume_unique=True, return_indices=True)
            if np.minimum(counts[x], others[y]).sum() < needed:
                continue
        asked.append((row, parts[i], parts[j], int((n + m) * (1 - least) / (1 + least)) + 1))
    found = common_length([(a, b, w) for _, a, b, w in asked])
    for (row, a, b, _), common in zip(asked, found, strict=True):
        share = common / (len(a) + len(b) - common)
        out[row] = share if share >= least - 1e-12 else 0.0
    return out


def node_of(key: Column, text: Column) -> Column:
    """The key, or a negative number made of the text where it is null."""
    return F.coalesce(key.cast("bigint"), -1 - F.pmod(F.xxhash64(text), F.lit(1 << 62)))


def _sketched(df: DataFrame, text: str, key: str) -> DataFrame:
    """One row per text: node (its smallest key) and how many rows have that, its digest, how many shingles, its sketch and bitmap."""

    @F.pandas_udf("sketch array<bigint>, size int, bits array<bigint>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            label, sizes = _labels(encoded(texts), SHINGLE)
            values = _sketches(label, sizes, FUNCTIONS, KEPT)
            yield pd.DataFrame({"sketch": list(values), "size": sizes.astype(np.int32), "bits": list(_bitmaps(label, sizes))})

    body = F.coalesce(named(text), F.lit(""))
    rows = df.select(node_of(named(key), body).alias("node"), F.sha2(body, 256).alias("digest"), sketch(body).alias("s"))
    rows = rows.groupBy("digest", "node").agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("digest").agg(F.min(F.struct("node", "n", "s")).alias("r"))
    return materialise(first.select("digest", "r.node", "r.n", "r.s.size", "r.s.sketch", "r.s.bits"), "sketches")


def _verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    @F.pandas_udf("double")
    def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(alike(encoded(left), encoded(right), least))

    one = texts.select(F.col("node").alias("b"), F.col("body").alias("body_b"))
    two = texts.select(F.col("node").alias("a"), F.col("body").alias("body_a"))
    met = pairs.join(one, "b").join(two, "a")
    return met.select("a", "b", similarity("body_a", "body_b").alias("similarity"))


def links(df: DataFrame, text: str = "text", key: str = "doc_id", least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b, similarity) between different texts, a < b, and the table of texts (digest, node, n, size, sketch, bits)."""
    small_batches(df.sparkSession, _ROWS)
    known = _sketched(df, text, key)
    maps = [F.get("bits", F.lit(i)).alias(f"map{i}") for i in range(MAPS)]
    spread = known.filter("size > 0").select("node", "size", *maps, F.posexplode("sketch").alias("band", "value"))
    spread = spread.select(F.xxhash64("band", "value").alias("bucket"), "node", "size", *[f"map{i}" for i in range(MAPS)])
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = materialise(spread.join(shared, "bucket"), "buckets")
    body = F.coalesce(named(text), F.lit(""))
    texts = df.select(node_of(named(key), body).alias("node"), body.alias("body"))
    wanted = materialise(members.select("node").distinct(), "wanted")
    texts = perhaps_named(texts, F.col("node"), wanted, "node").join(wanted, "node")
    texts = materialise(texts.groupBy("node").agg(F.min("body").alias("body")), "texts")
    floor = 1 - 2 * (1 - least)

    def may_reach(one: str, two: str, least: float) -> Column:  # what an alignment has in common: the shorter text at most, and not what differs
        n, m = F.col(one + "size"), F.col(two + "size")
        differ = sum((F.bit_count(F.col(f"{one}map{i}").bitwiseXOR(F.col(f"{two}map{i}"))) for i in range(MAPS)), F.lit(0))
        return (F.least(n, m) >= least * F.greatest(n, m) - 1e-9) & ((n + m - differ) / 2 >= least / (1 + least) * (n + m) - 1e-9)

    return hub_links(members, lambda pairs: _verify(pairs, texts, floor), least, may_reach), known


def near_copies(df: DataFrame, text: str = "text", key: str = "doc_id", least: float = LEAST) -> DataFrame:
    """One row per document: key, class_id (smallest key of its class), n_links (other texts its text was found linked to).

    A null text counts as empty. Texts without words are alike only if equal; texts of 1 to 4 words are one shingle.
    Equal rows are copies like any other. Rows without a key are told apart by their text, and a class of none but those has a
    negative number. Of an empty table nothing comes out.
    """
    found, known = links(df, text, key, least)
    ends = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    classes = components(found).join(degree, "node")
    texts = known.select("digest", "node").join(classes, "node", "left").select(
        "digest", F.coalesce("label", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")
    )
    docs = df.select(named(key).alias(key), F.sha2(F.coalesce(named(text), F.lit("")), 256).alias("digest"))
    return docs.join(texts, "digest").select(named(key), "class_id", "n_links")


def one_of_each(df: DataFrame, text: str = "text", key: str = "doc_id", least: float = LEAST) -> DataFrame:
    """Only the document with the smallest key of each class, once; columns stay as they are."""
    found, known = links(df, text, key, least)
    classes = components(found)
    gone = classes.filter(F.col("node") != F.col("label")).select("node")
    kept = known.join(gone, "node", "left_anti").select("digest", "node", "n")
    digest, node, n = (free_name(df, c) for c in ("__digest", "__node", "__n"))
    body = F.coalesce(named(text), F.lit(""))
    rows = df.withColumns({digest: F.sha2(body, 256), node: node_of(named(key), body)})
    kept = materialise(kept.toDF(digest + "k", node + "k", n), "kept")
    rows = rows.join(kept, (F.col(digest) == F.col(digest + "k")) & (F.col(node) == F.col(node + "k")))
    columns = [named(c) for c in df.columns]
    if kept.filter(F.col(n) > 1).isEmpty():
        return rows.select(*columns)
    again = rows.filter(F.col(n) > 1)  # rows alike in key and text: one of them stays
    once = again.groupBy(node).agg(F.min(F.struct(*columns)).alias(n)).select(f"{n}.*")
    return rows.filter(F.col(n) == 1).select(*columns).unionByName(once)
