"""Best-two-fit packing of tokenised documents into sequences.

Only how many pieces have each length decides how bins are filled, so bins are planned on that bounded table: fill a bin greedily,
then replace its smallest piece with two unpacked ones that fit the widened gap more tightly. A filling is repeated
for as many bins as the counts allow. The pieces of each length are numbered by Spark and look up their place in the plan.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import free_name, named, small_batches
from riskloom.operators.running import running_totals
from riskloom.session import materialise

SIZE = 1024
END = 2  # the id after each document
VOCABULARY = "byte_bpe_50k"

# Text that both tokenizer libraries are known to split alike; anything else goes to the library that defines the ids.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-¬®-ɏ]*")
_LONG_WORD = re.compile(r"\S{400}")


def encoders(folder: str | None, vocabulary: str):
    """The fast encoder and a loader of the defining one, kept for the life of a worker.

    Tasks unpickle their functions anew, so what must outlive a task hangs on an imported module.
    """
    import base64

    import public_tokenizers
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_kept_encoders", {})
    key = (folder, vocabulary)
    if key not in kept:
        place = (lambda name: f"{folder}/{name}") if folder else public_tokenizers.path
        with open(place(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def defining():
            if key + ("full",) not in kept:
                from tokenizers import Tokenizer

                kept[key + ("full",)] = Tokenizer.from_file(place(f"{vocabulary}.json"))
            return kept[key + ("full",)]

        kept[key] = fast, defining
    return kept[key]


def encode(text: str, fast, defining) -> np.ndarray:
    """Ids of a text followed by END, as little-endian unsigned 32-bit numbers."""
    plain = (text.isascii() or _PLAIN.fullmatch(text)) and "<|" not in text and not _LONG_WORD.search(text)
    ids = fast.encode_ordinary(text) if plain else defining().encode(text, add_special_tokens=False).ids
    ids.append(END)
    return np.array(ids, dtype="<u4")


def cut(length: int, size: int = SIZE) -> list[int]:
    """Ends of the pieces of a document: only a longer one is cut, and its first piece may be shorter."""
    first = (length - 1) % size + 1
    return list(range(first, length + 1, size))


def pieces(df: DataFrame, text: str = "text", size: int = SIZE, folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: the columns of ``df`` without the text, then piece, start, length and ids_crc32."""
    small_batches(df.sparkSession)

    @F.pandas_udf("first bigint, sums array<bigint>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tools = encoders(folder, vocabulary)
        for texts in batches:
            firsts, sums = [], []
            for t in texts:
                ids = encode(t, *tools)
                ends = cut(len(ids), size)
                firsts.append(ends[0])
                sums.append([zlib.crc32(ids[max(0, e - size) if i else 0 : e].tobytes()) for i, e in enumerate(ends)])
            yield pd.DataFrame({"first": firsts, "sums": sums})

    kept = [named(c) for c in df.columns if c != text]
    at, sums, held = (free_name(df, n) for n in ("__piece", "__sum", "__ids"))
    found = df.withColumn(held, encoded(F.coalesce(named(text), F.lit(""))))
    found = found.select(*kept, F.col(held)["first"].alias(held), F.posexplode(F.col(held)["sums"]).alias(at, sums))
    later = F.col(at) > 0
    return found.select(
        *kept,
        F.col(at).alias("piece"),
        F.when(later, F.col(held) + (F.col(at) - 1) * size).otherwise(0).cast("bigint").alias("start"),
        F.when(later, F.lit(size)).otherwise(F.col(held)).cast("bigint").alias("length"),
        F.col(sums).alias("ids_crc32"),
    )


def plan(counts: Mapping[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """Fillings (lengths in order) and for how many bins each is used; every counted piece is used once.

    Where few lengths occur, swapping only for an exact fit, or not at all, can save bins; the counts are few, so all are planned and the
    one with fewest bins is taken, the full swap where they tie.
    """
    plans = [_plan(counts, size, least) for least in (0, size, size + 1)]
    return min(plans, key=lambda fillings: sum(bins for _, bins in fillings))


def _plan(counts: Mapping[int, int], size: int, least: int) -> list[tuple[list[int], int]]:
    """``least`` is how full a bin must be after its smallest piece gave way to two."""
    left = [0] * (size + 1)
    for length, n in counts.items():
        left[length] += n
    fillings = []

    def largest() -> list[int]:
        """The largest length still there that is at most each gap; 0 if none."""
        best = [0] * (size + 1)
        for x in range(1, size + 1):
            best[x] = x if left[x] else best[x - 1]
        return best

    while (best := largest())[size]:
        items, gap = [], size
        while gap and (item := best[gap]):
            items.append(item)
            left[item] -= 1
            gap -= item
            if not left[item]:
                best = largest()
        if gap:
            smallest = items[-1]
            room, pair = gap + smallest, (0, 0)
            a = best[room]
            while a and 2 * a > sum(pair):
                left[a] -= 1
                b = min(room - a, a)
                while b and not left[b]:
                    b -= 1
                left[a] += 1
                if b and a + b > max(smallest, sum(pair)):
                    pair = (a, b)
                a = best[a - 1]
            if pair[0] and size - room + sum(pair) >= least:
                left[smallest] += 1
                left[pair[0]] -= 1
                left[pair[1]] -= 1
                items[-1:] = pair
        use = {x: items.count(x) for x in set(items)}
        more = min(left[x] // n for x, n in use.items())
        for x, n in use.items():
            left[x] -= n * more
        fillings.append((items, more + 1))
    return fillings


def slots(fillings: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, number after the last, pieces per bin, first bin, first offset) for the numbered pieces."""
    rows, used, base = [], {}, 0
    for items, bins in fillings:
        offset = 0
        for x in sorted(set(items), reverse=True):
            n = items.count(x)
            low = used.get(x, 0)
            used[x] = low + n * bins
            rows.append((x, low, used[x], n, base, offset))
            offset += n * x
        base += bins
    return rows


def pack(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, folder: str | None = None) -> DataFrame:
    """Place every piece of every document: key, piece, start, length, ids_crc32, sequence_id and offset.

    A null or empty text is a document of the one id END. Repeated rows are packed as often as they occur. A null key is kept. An empty
    table gives no rows. Other columns of ``df`` are not returned, so their names can't clash.
    """
    cut_up = materialise(pieces(df.select(named(key).alias("__key"), named(text).alias("__text")), "__text", size, folder), "pieces")
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length
    spark = df.sparkSession
    schema = "slot_length bigint, low bigint, high bigint, per_bin bigint, first_bin bigint, first_offset bigint"
    places = F.broadcast(spark.createDataFrame(slots(plan(counts, size)), schema))  # bounded by the number of lengths
    order = [F.col("__key").asc_nulls_first(), F.col("piece"), F.col("ids_crc32")]
    numbered = running_totals(cut_up, order, {"number": F.lit(1)}, within=["length"])
    fits = (F.col("length") == F.col("slot_length")) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high"))
    step = F.col("number") - F.col("low")
    return numbered.join(places, fits).select(
        F.col("__key").alias(key),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_bin") + F.floor(step / F.col("per_bin"))).cast("bigint").alias("sequence_id"),
        (F.col("first_offset") + step % F.col("per_bin") * F.col("length")).cast("bigint").alias("offset"),
    )
