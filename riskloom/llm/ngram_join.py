"""Exact join of documents by the Jaccard similarity of their word n-grams: size-banded tiles of hashed bitmaps.

A tile holds a bounded number of sets, banded by size, and compares bitmaps: two sets that differ in d members have bitmaps that differ in at most
d places, so counting bits bounds their overlap from above. What passes is decided by intersecting the sorted arrays. A tile returns links that
connect its sets as all its links would, so its output is never more than its input, however many of its pairs are alike.

Keys keep tiles away from sets that share nothing. Similarity fixes how many members two sets may differ in; dealt by
hash into more parts than that, they agree in a part as a whole. So each set names its first non-empty parts, one more than it may
differ in, and sets alike name an equal part. No pair is lost by that: before the first non-empty
part in which two sets agree lie only parts in which they differ. Sets whose members clump into too few parts name their smallest members as well, as many
as the similarity leaves unmatched and one more.

First the sets that name a key are sieved in tiles of bitmaps alone. Pairs within the bound connect sets to blocks, and the texts of
blocks meet in tiles that intersect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import named, small_batches
from riskloom.llm.groups import components, perhaps_named
from riskloom.llm.words import mix, shingles, words
from riskloom.operators.joins import lookup_join
from riskloom.session import materialise

WORDS = 4
LEAST = (85, 100)
TILE_SETS = 1024  # sets in a tile at most
TILE_MEMBERS = 1 << 21  # their members together at most, unless a single pair has more
_STEP = 1.5  # largest size by smallest, of the sets that share a scheme of parts
_ROWS = 100  # per Arrow batch, as whole texts travel
_AT_ONCE = 1 << 19  # members worked on at once
_BLANK = (0x20, *range(0x09, 0x0E))
IS_WORD = np.array([b not in _BLANK for b in range(256)])


def sets_of(texts: list[bytes], k: int = WORDS) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct word n-grams; a text of fewer words is one n-gram, one without words has none."""
    hashes, _, _, first = words(texts, IS_WORD)
    found, start = shingles(hashes, first, k)
    return [np.unique(found[a:b]) for a, b in zip(start, start[1:])]


def may_differ(sizes: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """In how many members sets of these sizes can at most differ from any set alike: size * (1 - least) / least."""
    return sizes * (least[1] - least[0]) // least[0]


def _bands(largest: int) -> np.ndarray:
    """The least size of every band up to the one after that of ``largest``; sizes of a band share a scheme of parts."""
    found = [1]
    while found[-1] <= largest:
        found.append(max(found[-1] + 1, int(found[-1] * _STEP)))
    return np.array(found)


def _summed(values: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """64-bit sums of values by place. Halves are added as floats, which is exact for fewer than two million values a place."""
    low = np.bincount(places, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    high = np.bincount(places, (values >> np.uint64(32)).astype(np.float64), size)
    return low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))


def _named_parts(members, of, sizes, differ, band, parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest and set of the parts that sets name under the schemes of these bands, and which sets have too few."""
    base = np.concatenate(([0], np.cumsum(parts)))
    scheme = mix(band.astype(np.uint64) + np.uint64(1))
    part = (mix(members ^ scheme[of]) % parts[of].astype(np.uint64)).astype(np.int64)
    place = base[of] + part
    total = _summed(mix(members + np.uint64(0x9E3779B97F4A7C15)), place, base[-1])
    some = np.bincount(place, minlength=base[-1]) > 0
    whose = np.repeat(np.arange(len(sizes)), parts)
    before = np.cumsum(some) - some
    rank = before - before[base[:-1]][whose]
    chosen = some & (rank <= differ[whose])
    number = np.arange(base[-1]) - base[whose]
    keys = mix(total + mix(scheme[whose] + number.astype(np.uint64)))
    return keys[chosen], whose[chosen], np.add.reduceat(some.astype(np.int64), base[:-1]) <= differ


def meeting_keys(sets: list[np.ndarray], least: tuple[int, int] = LEAST) -> list[np.ndarray]:
    """Keys of each set: any two different sets alike have one in common. Sets too small to be like any other have none."""
    out = [np.empty(0, np.uint64) for _ in sets]
    sizes = np.array([len(s) for s in sets], np.int64)
    differ = may_differ(sizes, least)
    asked = np.flatnonzero(differ > 0)
    if not len(asked):
        return out
    sizes, differ = sizes[asked], differ[asked]
    members = np.concatenate([sets[i] for i in asked])
    of = np.repeat(np.arange(len(asked)), sizes)
    reach = sizes * least[1] // least[0]
    edges = _bands(int(reach.max()))
    own = np.searchsorted(edges, sizes, "right") - 1
    keys, whose, clumped = [], [], np.zeros(len(asked), bool)
    # The scheme of a pair is that of its larger set, so a set names parts by the schemes of all bands it reaches into.
    for step in range(len(edges)):
        here = np.flatnonzero((own + step + 1 < len(edges)) & (reach >= edges[np.minimum(own + step, len(edges) - 1)]))
        if not len(here):
            break
        place = np.zeros(len(asked), np.int64)
        place[here] = np.arange(len(here))
        inside = np.isin(of, here) if len(here) < len(asked) else np.ones(len(of), bool)
        band = own[here] + step
        parts = may_differ(edges[band + 1], least) * 5 // 4 + 2
        found, owner, few = _named_parts(members[inside], place[of[inside]], sizes[here], differ[here], band, parts)
        keys.append(found)
        whose.append(here[owner])
        clumped[here] |= few
    keys, whose = np.concatenate(keys), np.concatenate(whose)
    if clumped.any():
        at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        prefix = sizes - -(-sizes * least[0] // least[1]) + 1
        inside = clumped[of] & (at < prefix[of])
        keys, whose = np.concatenate([keys, mix(members[inside] + np.uint64(7))]), np.concatenate([whose, of[inside]])
    order = np.argsort(whose, kind="stable")
    cut = np.searchsorted(whose[order], np.arange(len(asked) + 1))
    for i, a, b in zip(asked, cut, cut[1:]):
        out[i] = np.unique(keys[order[a:b]])
    return out


def _digest(members: np.ndarray) -> int:
    return int(mix(np.uint64([len(members)]) + np.add.reduce(mix(members)))[0].astype(np.int64))


def _portions(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high]) <= 8 * _AT_ONCE):
            size += len(texts[high])
            high += 1
        yield low, high
        low = high


def _described(k: int, least: tuple[int, int]):
    """Adds to every row its set's size, digest, keys and bitmap; a task names the last two of equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary()).to_pylist()
            for low, high in _portions(texts):
                sets = sets_of(texts[low:high], k)
                digests = [_digest(s) if len(s) else None for s in sets]
                fresh = []
                for i, d in enumerate(digests):
                    if d is not None and d not in seen:
                        seen.add(d)
                        fresh.append(i)
                keys = [np.empty(0, np.uint64)] * len(sets)
                maps: list[bytes | None] = [None] * len(sets)
                for i, found in zip(fresh, meeting_keys([sets[i] for i in fresh], least), strict=True):
                    keys[i] = found
                    maps[i] = bitmap(sets[i]).tobytes() if len(found) else None
                ends = np.concatenate(([0], np.cumsum([len(x) for x in keys])))
                values = np.concatenate(keys).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        batch.column(1).slice(low, high - low),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64())),
                        pa.array(maps, pa.binary()),
                    ],
                    ["doc", "body", "n", "node", "keys", "bits"],
                )

    return run


def bitmap(members: np.ndarray) -> np.ndarray:
    """A set's hashed bitmap as 64-bit words: four to eight places a member, a power of two."""
    places = 1 << max(6, (4 * len(members) - 1).bit_length())
    at = mix(members ^ np.uint64(0xD1B54A32D192ED03)) & np.uint64(places - 1)
    flags = np.zeros(places, np.uint8)
    flags[at.astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    """The bitmap of the same set with fewer places."""
    while len(words) > width:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def within_bound(sizes: np.ndarray, maps: list[np.ndarray], sides: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """Pairs that bit counts leave open, as rows (bits apart, place, place). Sizes ascend.

    Where two sides are given, only sets of different sides are compared. Bitmaps of unlike width are compared at the smaller one.
    """
    mixed = sides.min() != sides.max()
    ends = np.searchsorted(sizes * least[0], sizes * least[1], "right")  # larger ones are not alike
    widths = np.array([len(m) for m in maps])
    near = [np.empty((3, 0), np.int64)]
    for width in np.unique(widths):
        here = np.flatnonzero(widths == width)
        low, high = here[0], ends[here[-1]]
        block = np.stack([_folded(m, width) for m in maps[low:high]])
        for i in here:
            if ends[i] > i + 1:
                apart = np.bitwise_count(block[i + 1 - low : ends[i] - low] ^ block[i - low]).sum(axis=1, dtype=np.int64)
                most = (sizes[i] + sizes[i + 1 : ends[i]]) * (least[1] - least[0]) // (least[1] + least[0])
                keep = apart <= most
                if mixed:
                    keep &= sides[i + 1 : ends[i]] != sides[i]
                j = np.flatnonzero(keep)
                near.append(np.stack([apart[j], np.full(len(j), i), j + i + 1]))
    return np.concatenate(near, axis=1)


def connected(pairs: np.ndarray, size: int, holds=None) -> list[tuple[int, int]]:
    """Those pairs, nearest first, that connect what is not connected yet and for which ``holds`` is true."""
    pairs = pairs[:, np.argsort(pairs[0], kind="stable")]
    top = list(range(size))

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    links: list[tuple[int, int]] = []
    for i, j in zip(pairs[1].tolist(), pairs[2].tolist()):
        a, b = root(i), root(j)
        if a != b and (holds is None or holds(i, j)):
            top[a] = b
            links.append((i, j))
            if len(links) == size - 1:
                break
    return links


def linked(sets: list[np.ndarray], sides: np.ndarray, least: tuple[int, int] = LEAST) -> list[tuple[int, int]]:
    """Links between sets alike that connect them as all their links would: places of the sets."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, sides = [sets[i] for i in order], sides[order]

    def alike(i: int, j: int) -> bool:
        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return least[1] * common >= least[0] * (len(sets[i]) + len(sets[j]) - common)

    near = within_bound(np.array([len(s) for s in sets]), [bitmap(s) for s in sets], sides, least)
    return [(int(order[i]), int(order[j])) for i, j in connected(near, len(sets), alike)]


def _by_tile(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """What ``work(nodes, sides, values)`` finds in each tile of rows (tile, side, node, value) that come sorted by tile and node."""

    def finish() -> pa.RecordBatch:
        found = work(nodes, np.array(sides), values)
        ends = [[min(nodes[i], nodes[j]) for i, j in found], [max(nodes[i], nodes[j]) for i, j in found]]
        return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], ["a", "b"])

    now, nodes, sides, values = None, [], [], []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[:3]] + [batch.column(3).cast(pa.large_binary()).to_pylist()]
        for tile, side, node, value in zip(*columns, strict=True):
            if tile != now:
                if len(nodes) > 1:
                    yield finish()
                now, nodes, sides, values = tile, [], [], []
            if not nodes or (nodes[-1], sides[-1]) != (node, side):  # rows alike in key and text
                nodes.append(node)
                sides.append(side)
                values.append(value)
    if len(nodes) > 1:
        yield finish()


def _intersected(k: int, least: tuple[int, int]):
    def work(nodes, sides, texts):
        sets: list[np.ndarray] = []
        for low, high in _portions(texts):
            sets += sets_of(texts[low:high], k)
        return linked(sets, sides, least)

    return lambda batches: _by_tile(batches, work)


def _sieved(least: tuple[int, int]):
    """Values are a set's size as 8 bytes, then its bitmap."""

    def work(nodes, sides, values):
        sizes = np.array([int.from_bytes(v[:8], "big") for v in values])
        order = np.argsort(sizes, kind="stable")
        near = within_bound(sizes[order], [np.frombuffer(values[i], np.uint64, offset=8) for i in order], sides[order], least)
        return [(order[i], order[j]) for i, j in connected(near, len(nodes))]

    return lambda batches: _by_tile(batches, work)


def _tiled(members: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Rows (node, tile, side) of (node, n, label): what has one label is one tile if it is small enough, others are cut by band and salt.

    Two sets alike lie in the same band or neighbouring ones. Every two salts of one or of two neighbouring bands make a tile.
    """
    ratio = 1.001 * least[1] / least[0]
    members = members.select("node", "n", "label").withColumn("band", F.floor(F.log("n") / F.log(F.lit(ratio))).cast("int"))
    figures = members.groupBy("label", "band").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("members"))
    cut = F.greatest(F.ceil(2 * F.col("sets") / TILE_SETS), F.ceil(2 * F.col("members") / TILE_MEMBERS)).cast("int")
    figures = materialise(figures.withColumn("salts", cut), "bands")
    whole = figures.groupBy("label").agg(F.sum("sets").alias("sets"), F.sum("members").alias("members"))
    large = (F.col("sets") > TILE_SETS) | (F.col("members") > TILE_MEMBERS)
    whole = whole.select("label", "sets", large.alias("large"))
    whole = materialise(whole, "blocks")
    sized = lookup_join(members, whole, ["label"], "sets")
    small = sized.filter("NOT large").select("node", F.xxhash64("label").alias("tile"), F.lit(0).alias("side"))
    own = figures.select("label", "band", "sets", "salts")
    above, below = (
        figures.select("label", (F.col("band") + step).alias("band"), F.col("salts").alias(name)) for step, name in ((-1, "above"), (1, "below"))
    )
    own = own.join(above, ["label", "band"], "left").join(below, ["label", "band"], "left").na.fill(0, ["above", "below"])
    rest = sized.filter("large").select("node", "label", "band")
    rest = lookup_join(rest, materialise(own, "salts"), ["label", "band"], "sets")
    rest = rest.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))

    def side_by_side(count: str, make):
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), make)).otherwise(F.array())

    def tile(low_band, low_salt, high_salt, cross: bool, side):
        return F.struct(F.xxhash64("label", low_band, F.lit(cross), low_salt, high_salt).alias("tile"), side.cast("int").alias("side"))

    salt, band = F.col("salt"), F.col("band")
    same = side_by_side("salts", lambda s: tile(band, F.least(s, salt), F.greatest(s, salt), False, salt > s))
    upward = side_by_side("above", lambda s: tile(band, salt, s, True, F.lit(0)))
    downward = side_by_side("below", lambda s: tile(band - 1, s, salt, True, F.lit(1)))
    placed = rest.select("node", F.explode(F.concat(same, upward, downward)).alias("t")).select("node", "t.tile", "t.side")
    return small.unionByName(placed)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("tile").sortWithinPartitions("tile", "node", "side")


def linked_documents(df: DataFrame, text: str = "text", key: str = "doc_id", k: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """One row per document: key, n_shingles (distinct word n-grams) and component_id, the smallest key that links lead to.

    Two documents link when their sets' Jaccard similarity is least[0] / least[1] or more. A word is a run without blanks; A-Z
    count as a-z. A text of fewer words is one n-gram; a null text, one without words and an empty one have no n-grams and are linked with nothing.
    Documents with equal sets are linked. Repeated rows and keys are documents like any other. Rows without a key get the smallest key of their component, null if
    it has none. Other columns play no part, whatever their names. Of an empty table nothing comes out. Sets are told apart by 64-bit digests.
    """
    spark = df.sparkSession
    small_batches(spark, _ROWS)
    body = F.coalesce(named(text), F.lit(""))
    rows = df.select(named(key).cast("bigint").alias("doc"), F.xxhash64(body).alias("body"), body.alias("text"))
    described = rows.mapInArrow(_described(k, least), "doc bigint, body bigint, n bigint, node bigint, keys array<bigint>, bits binary")
    docs = materialise(described, "sets")

    met = docs.filter(F.size("keys") > 0).select("node", F.explode("keys").alias("key"))
    group = Window.partitionBy("key")
    met = met.select("node", "key", F.min("node").over(group).alias("low"), F.max("node").over(group).alias("high")).filter("low <> high")
    met = materialise(met.select("node", "key").distinct(), "met")
    # Many keys are named by the same sets: one key of those does.
    named_by = met.groupBy("key").agg(F.count(F.lit(1)).alias("c"), *[F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)])
    one = named_by.groupBy("c", "x0", "x1").agg(F.min("key").alias("key")).select("key")
    seen = materialise(met.select("node").distinct(), "seen")
    maps = docs.filter(F.col("bits").isNotNull()).join(seen, "node").groupBy("node").agg(F.min("n").alias("n"), F.min("bits").alias("bits"))
    maps = materialise(maps, "maps")
    grouped = met.join(one, "key").join(maps.select("node", "n"), "node").select("node", "n", F.col("key").alias("label"))
    sieve = _tiled(materialise(grouped, "groups"), least).join(maps, "node")
    value = F.concat(F.unhex(F.lpad(F.hex("n"), 16, "0")), "bits")
    blocks = components(materialise(_dealt(sieve.select("tile", "side", "node", value.alias("value"))).mapInArrow(_sieved(least), "a bigint, b bigint"), "near"))

    nodes = docs.filter("n > 0").groupBy("node").agg(
        F.min("n").alias("n"), F.min("doc").alias("least_doc"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("doc", "body")).alias("at")
    )
    nodes = materialise(nodes, "nodes")
    members = materialise(nodes.join(blocks, "node").select("node", "n", "label", "at.doc", "at.body"), "members")
    tiles = materialise(_tiled(members, least).join(members.select("node", "doc", "body"), "node"), "tiles")
    texts = perhaps_named(rows, F.col("body"), members, "body").alias("r")
    same = (F.col("r.body") == F.col("t.body")) & F.col("r.doc").eqNullSafe(F.col("t.doc"))
    placed = _dealt(texts.join(tiles.alias("t"), same).select("tile", "side", "node", "text"))
    links = materialise(placed.mapInArrow(_intersected(k, least), "a bigint, b bigint"), "links")

    joined = nodes.join(components(links), "node", "left").select("node", "rows", "least_doc", F.coalesce("label", "node").alias("label"))
    joined = materialise(joined, "joined")
    least_doc = joined.groupBy("label").agg(F.min("least_doc").alias("component_id"))
    found = materialise(joined.join(least_doc, "label").select("node", "rows", "component_id"), "components")
    out = lookup_join(docs.select("doc", "n", "node"), found, ["node"], "rows")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc"))
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
