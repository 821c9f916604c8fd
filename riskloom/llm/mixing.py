"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

The mix keeps its document rates as close to 1 (in relative entropy) as the token constraint of each source allows. The
convex dual has one multiplier per source; its optimum tilts rates exponentially: rate = min(2, exp(multiplier * size / mean size)).
Newton steps, kept inside a shrinking bracket, solve all sources at once over (source, size) counts.
Rates are then rounded into copies: within a source the documents with most rate left over for their hashed ticket get
one more copy, up to the target, so a source misses its target by less than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import free_name, named
from riskloom.operators.joins import lookup_join
from riskloom.operators.running import running_totals, with_row_ids
from riskloom.session import materialise

WEIGHTS = (3, 1, 2)  # of the sources in order, repeating
SHARE = 1.5  # the mix's size as a part of all sizes
LIMIT = 2  # times its own size that a source or document may be taken
_STEPS, _NEAR = 60, 1e-9
_FINE = 1 << 50


def words(text: Column) -> Column:
    """Number of runs of characters other than blanks and the controls 9 to 13; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def targets(sources: DataFrame) -> DataFrame:
    """Add ``target`` to rows of (source, n, source_size), one per source.

    Sources in code-point order, null last, weigh WEIGHTS, repeating, and share SHARE of all sizes. A target stops at
    LIMIT times its source's size and the excess is shared again by weight. Only sums reach the driver.
    """
    placed = with_row_ids(sources, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    placed = materialise(placed.withColumn("weight", weight), "sources")
    whole = placed.agg(F.sum("source_size")).first()[0] or 0
    top = (LIMIT * F.col("source_size")).cast("double")
    level = None  # target per unit of weight
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level > top
        held, open_weight = placed.agg(
            F.sum(F.when(full, top).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        raised = (SHARE * whole - (held or 0.0)) / open_weight if open_weight else 0.0
        if level is not None and raised <= level:
            break
        level = raised
    return placed.withColumn("target", F.least(F.col("weight") * F.lit(level), top)).drop("place", "weight")


def rate(size: Column, mean: Column, multiplier: Column) -> Column:
    """The tilted rate of a document; an empty one keeps the rate 1."""
    tilt = F.when(size > 0, multiplier * size / mean).otherwise(0.0)
    return F.least(F.lit(float(LIMIT)), F.exp(F.least(tilt, F.lit(1.0))))


def multipliers(counts: DataFrame, goals: DataFrame) -> DataFrame:
    """Solve the dual: (source, n, source_size, target, mean, multiplier) from (source, size, n) counts.

    Each step is one grouped sum over the counts. A source whose target is LIMIT times its size takes all of it that often.
    """
    whole = F.col("target") >= LIMIT * F.col("source_size") * (1 - 1e-12)
    state = goals.select(
        "*",
        F.greatest(F.col("source_size") / F.col("n"), F.lit(1e-9)).alias("mean"),
        F.when(whole, 1e9).otherwise(0.0).alias("multiplier"),
        F.lit(-1e9).alias("low"),
        F.lit(1e9).alias("high"),
        whole.alias("done"),
    )
    state = materialise(state, "dual")
    for _ in range(_STEPS):
        s, c = state.filter(~F.col("done")).alias("s"), counts.alias("c")
        size, r = F.col("c.size"), rate(F.col("c.size"), F.col("s.mean"), F.col("s.multiplier"))
        slope = F.when(r < LIMIT, r * size / F.col("s.mean")).otherwise(0.0)
        sums = c.join(s, F.col("c.source").eqNullSafe(F.col("s.source"))).groupBy(F.col("c.source").alias("of")).agg(
            F.sum(F.col("c.n") * size * r).alias("taken"), F.sum(F.col("c.n") * size * slope).alias("slope")
        )
        over = F.col("taken") - F.col("target")
        low = F.when(over < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(over > 0, F.col("multiplier")).otherwise(F.col("high"))
        reach = 1 + 2 * F.abs(F.col("multiplier"))
        step = F.coalesce(F.try_divide(-over, F.col("slope")), F.when(over < 0, reach).otherwise(-reach))
        newton = F.col("multiplier") + F.greatest(-reach, F.least(reach, step))
        inside = (newton > low) & (newton < high)
        near = F.coalesce(F.abs(over) <= _NEAR * F.col("target"), F.lit(True))  # a source without rows is done
        move = ~F.col("done") & ~near
        state = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").select(
            *goals.columns,
            "mean",
            F.when(move, F.when(inside, newton).otherwise((low + high) / 2)).otherwise(F.col("multiplier")).alias("multiplier"),
            F.when(move, low).otherwise(F.col("low")).alias("low"),
            F.when(move, high).otherwise(F.col("high")).alias("high"),
            (F.col("done") | near).alias("done"),
        )
        state = materialise(state, "dual")
        if state.filter(~F.col("done")).isEmpty():
            break
    # Sums of doubles depend on their order in the last digits; what follows must not.
    return state.drop("low", "high", "done").withColumn("multiplier", F.round("multiplier", 7))


def _spare(rate_: Column, ticket: Column) -> Column:
    """What a rate leaves over its whole copies, less the ticket, as an integer; the largest are rounded up first."""
    share = F.pmod(ticket, F.lit(_FINE)) / float(_FINE)
    return F.when(rate_ < LIMIT, F.floor((rate_ - F.floor(rate_) - share + 1) * _FINE)).otherwise(F.lit(-1)).cast("bigint")


def solve(sizes: DataFrame) -> DataFrame:
    """Parameters per source, from materialised (source, size, ticket) rows: all a document's copies depend on."""
    counts = materialise(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    sources = counts.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    solved = multipliers(counts, targets(sources))
    rated = lookup_join(sizes, solved, ["source"], "n")
    r = rate(F.col("size"), F.col("mean"), F.col("multiplier"))
    rated = rated.select("source", "size", r.alias("rate"), _spare(r, F.col("ticket")).alias("spare"))
    base = rated.groupBy(F.col("source").alias("of")).agg(F.sum((F.floor("rate") * F.col("size")).cast("bigint")).alias("base"))
    # Equal (source, spare, size) rows are counted first, so what is ordered has no repeats.
    tickets = rated.filter((F.col("spare") >= 0) & (F.col("size") > 0)).groupBy("source", "spare", "size")
    tickets = tickets.agg(F.sum("size").alias("amount"))
    ordered = running_totals(tickets, [F.col("spare").desc(), F.col("size").desc()], {"before": "amount"}, within=["source"])
    need = solved.join(base, F.col("source").eqNullSafe(F.col("of")), "left").withColumn(
        "need", F.col("target") - F.coalesce(F.col("base"), F.lit(0))
    )
    need = materialise(need.drop("of", "base"), "needs")
    joined = lookup_join(ordered, need.select("source", "n", "need"), ["source"], "n")
    last = joined.filter(F.col("before") + F.col("amount") / 2 <= F.col("need"))
    last = last.groupBy(F.col("source").alias("of")).agg(F.min("spare").alias("last"))
    found = need.join(last, F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "need")
    return materialise(found, "mix")


def ticket(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def mixed(df: DataFrame, text: str = "text", source: str = "source", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add ``size``, ``source_size``, ``target`` and ``copies`` to documents.

    Null texts have size 0; null sources are one source. Empty documents keep one copy. Rows alike in keys, text and source share
    their rounding, so reruns agree. Of an empty table nothing comes out. Added names get an underscore in front where taken.
    """
    place, size, draw = (free_name(df, n) for n in ("__source", "__size", "__ticket"))
    drawn = ticket(*[named(k) for k in keys], named(text), named(source))
    rows = df.withColumns({place: named(source), size: words(named(text)), draw: drawn})
    sizes = rows.select(F.col(place).alias("source"), F.col(size).alias("size"), F.col(draw).alias("ticket"))
    mix = solve(materialise(sizes, "mix-sizes"))
    own = [free_name(df, "__" + c) for c in mix.columns]
    mix = mix.toDF(*[place if c == "source" else o for c, o in zip(mix.columns, own, strict=True)])
    of = dict(zip(("source", *[c for c in ("n", "source_size", "target", "mean", "multiplier", "last")]), own, strict=True))
    found = lookup_join(rows, mix, [place], of["n"])
    r = rate(F.col(size), F.col(of["mean"]), F.col(of["multiplier"]))
    spare = _spare(r, F.col(draw))
    extra = F.coalesce((spare >= 0) & (spare >= F.col(of["last"])) & (F.col(size) > 0), F.lit(False))
    return found.select(
        *[named(c) for c in df.columns],
        F.col(size).alias(free_name(df, "size")),
        F.col(of["source_size"]).alias(free_name(df, "source_size")),
        F.col(of["target"]).alias(free_name(df, "target")),
        (F.floor(r) + extra.cast("int")).cast("bigint").alias(free_name(df, "copies")),
    )


def taken(df: DataFrame) -> DataFrame:
    """The documents as the mix holds them: each row as many times as it has copies, its columns unchanged."""
    count = free_name(df, "copies")
    found = mixed(df).filter(F.col(count) > 0)
    again = free_name(df, "__again")
    return found.select(*[named(c) for c in df.columns], F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(count))).alias(again)).drop(again)
