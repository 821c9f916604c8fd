"""Classes of linked nodes, links within buckets without listing all pairs, and narrowing a table to named rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialise

_BITS = 1 << 22
_MANY = 256  # members of a bucket from which on its first hub is the one that most members meet


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): label is the smallest node reachable. Labels spread and jump until still."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("to"), "label")
        spread = materialise(spread, "spread")
        top = spread.select(F.col("node").alias("of"), F.col("to").alias("top"))
        moved = spread.join(top, F.col("to") == F.col("of")).select("node", F.least("to", "top").alias("to"), "label")
        moved = materialise(moved, "labels")
        still = moved.filter(F.col("to") != F.col("label")).isEmpty()
        labels = moved.select("node", F.col("to").alias("label"))
        if still:
            return labels


def hub_links(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame], least: float, may_reach: Callable[[str, str, float], Column] | None = None
) -> DataFrame:
    """Links (a, b, similarity >= least), a < b, that connect all members sharing a bucket and that similar, without listing all pairs.

    ``members`` (materialised) has a bucket, a node and further columns that ``may_reach(left, right, s)`` may use: a condition that
    is true wherever two members' similarity can be s or more. ``verify`` gives pairs (a, b) their exact similarity, or 0
    below that. 1 - similarity must be a metric. Each round compares the waiting members of a bucket with hubs drawn
    from them: one, then about two, four and so on. In large buckets the first is the member that meets most others in all its buckets: what the
    others are copies of meets more of them than they meet each other. Two hubs need only be told to be alike. A member a hub explains stops waiting. If two similar members part
    at a hub, neither is further than twice the limit from it, so the pairs that the triangle inequality leaves open are few
    and are compared too. Hence every two similar members of a bucket end up connected.
    """
    limit = 1 - least
    others = [c for c in members.columns if c not in ("bucket", "node")]
    waiting, done, seen, round_ = members, None, [], 0

    def ask(pairs: DataFrame) -> None:
        nonlocal done
        fresh = pairs.select("a", "b").distinct()
        if done is not None:
            fresh = fresh.join(done.select("a", "b"), ["a", "b"], "left_anti")
        checked = verify(fresh)
        done = materialise(checked if done is None else done.unionByName(checked), "compared")

    while True:
        h = F.xxhash64("node", F.pmod(F.xxhash64("bucket"), F.lit(2)))
        first = waiting.groupBy("bucket").agg(F.min_by("node", h).alias("first"), F.count(F.lit(1)).alias("left")).filter("left > 1")
        first = materialise(first, "first-hubs")
        large = first.filter(F.col("left") > _MANY).select("bucket", "left")
        inside = waiting.select("bucket", "node").join(large, "bucket")
        known = inside.groupBy("node").agg(F.sum("left").alias("meets"))
        top = inside.join(known, "node").groupBy("bucket").agg(F.max_by("node", F.struct("meets", F.xxhash64("node"))).alias("top"))
        first = first.join(top, "bucket", "left").select("bucket", F.coalesce("top", "first").alias("first"), "left")
        met = waiting.join(first, "bucket")
        more = F.when(F.col("left") > _MANY, F.lit(4**round_ - 1)).otherwise(F.lit(2**round_ - 1))
        is_hub = (F.col("node") == F.col("first")) | (F.pmod(F.xxhash64("node", F.lit(round_)), F.col("left")) < more)
        met = materialise(met.select(*members.columns, is_hub.alias("is_hub")), "dealt")
        hubs = materialise(met.filter("is_hub").select("bucket", F.col("node").alias("hub"), *[F.col(c).alias("hub_" + c) for c in others]), "hubs")
        l, r = met.alias("l"), hubs.alias("r")
        apart = (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.node") != F.col("r.hub"))
        if may_reach:
            apart = apart & may_reach("l.", "r.hub_", 1 - 2 * limit) & (~F.col("l.is_hub") | may_reach("l.", "r.hub_", least))
        pairs = l.join(r, apart)
        pairs = pairs.select(
            "l.bucket", "node", "hub", F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")
        )
        pairs = materialise(pairs, "met")
        ask(pairs)
        told = materialise(pairs.join(done.filter("similarity > 0"), ["a", "b"]).select("bucket", "node", "hub", (1 - F.col("similarity")).alias("away")), "told")
        seen.append(told)
        over = told.filter(F.col("away") <= limit + 1e-9).select("bucket", "node").unionByName(hubs.select("bucket", F.col("hub").alias("node")))
        rest = met.select(*members.columns).join(over.distinct(), ["bucket", "node"], "left_anti")
        waiting = materialise(rest.select(*members.columns), "waiting")
        round_ += 1
        if waiting.isEmpty():
            break
    told = seen[0]
    for more in seen[1:]:
        told = told.unionByName(more)
    # All near a hub are connected already, so only members not yet connected to it can add anything.
    labels = materialise(components(done.filter(F.col("similarity") >= least - 1e-12)), "joined")
    mine, theirs = labels.toDF("node", "own"), labels.toDF("hub", "hubs_own")
    far = told.filter(F.col("away") > limit + 1e-9).join(mine, "node", "left").join(theirs, "hub", "left")
    far = far.filter(F.coalesce("own", "node") != F.coalesce("hubs_own", "hub"))
    far = materialise(far.select(*told.columns), "apart")
    near = told.filter(F.col("away") <= limit + 1e-9).join(far.select("bucket", "hub").distinct(), ["bucket", "hub"])
    known = members.select("node", *others).dropDuplicates(["node"])
    near, far = near.join(known, "node").alias("n"), far.join(known, "node").alias("f")
    open_ = (
        (F.col("n.bucket") == F.col("f.bucket"))
        & (F.col("n.hub") == F.col("f.hub"))
        & (F.col("n.away") >= F.col("f.away") - limit - 1e-9)
        & (F.col("n.node") != F.col("f.node"))
    )
    if may_reach:
        open_ = open_ & may_reach("n.", "f.", least)
    pairs = near.join(far, open_).select(F.least("n.node", "f.node").alias("a"), F.greatest("n.node", "f.node").alias("b"))
    ask(pairs)
    return done.filter(F.col("similarity") >= least - 1e-12)


def perhaps_named(rows: DataFrame, column: Column, names: DataFrame, name: str) -> DataFrame:
    """Rows whose column may be among the names: none of those is lost, few others stay."""
    return rows.filter(perhaps(column, names, name))


def perhaps(column: Column, names: DataFrame, name: str) -> Column:
    """Whether a column may be among the names: true for all of those and for few others.

    A bit table of fixed size says so; it only spares shuffling rows that a join would drop anyway.
    """
    place = F.pmod(F.xxhash64(F.col(name)), F.lit(_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(F.col(name)), F.lit(64)).cast("int"))
    words = names.groupBy(F.floor(place / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    table = fixed_array(words, "word", "bits", _BITS // 64, "bigint")
    here = F.element_at(table, (F.floor(F.pmod(F.xxhash64(column), F.lit(_BITS)) / 64) + 1).cast("int"))
    mine = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(column), F.lit(64)).cast("int"))
    return here.bitwiseAND(mine) != 0


def fixed_array(rows: DataFrame, place: str, value: str, size: int, kind: str) -> Column:
    """Rows of (place, value), one per place, as an array of ``size`` values (0 where there is none) for use in any expression."""
    spark = rows.sparkSession
    all_places = spark.range(size).select(F.col("id").alias("place"), F.lit(0).cast(kind).alias("value"))
    filled = all_places.unionByName(rows.select(F.col(place).cast("bigint").alias("place"), F.col(value).cast(kind).alias("value")))
    filled = filled.groupBy("place").agg(F.max(F.struct(F.col("value") != 0, "value")).alias("v"))
    listed = filled.agg(F.array_sort(F.collect_list(F.struct("place", "v.value"))).alias("all"))  # size rows, whatever the data
    return materialise(listed.select(F.transform("all", lambda x: x["value"]).alias("all")), "table").scalar()
