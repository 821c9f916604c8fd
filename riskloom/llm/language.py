"""Language identification by a byte convolutional network trained in numpy.

A window of bytes is embedded, filters of several widths slide over it, each filter keeps its
largest response, and a softmax over those gives the language. A document's languages are the
mean of its windows' probabilities, weighted by their bytes; windows overlap by the widest filter
less one, so every byte sequence a filter can see lies in some window of a whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import free_name, named, small_batches

UNDETERMINED = "und"
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
DIMENSIONS = 6
# The classifier is fitted on at most this many different texts of each language, with WINDOWS_PER_TEXT windows of each text.
SAMPLE_PER_LANGUAGE = 400
WINDOWS_PER_TEXT = 3
_CHUNK = 128  # windows per matrix product, which bounds a task's memory


@dataclass
class ByteNet:
    """Weights: byte embedding, one filter matrix over the widest width, and the softmax layer."""

    languages: list[str]
    embedding: np.ndarray  # 256 x DIMENSIONS
    filters: np.ndarray  # (max width * DIMENSIONS) x filters; zero outside a filter's own width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """Embedded windows, with the bytes a filter sees at each place side by side."""
        x = self.embedding[windows]
        places = windows.shape[1] - max(WIDTHS) + 1
        return np.concatenate([x[:, o : o + places] for o in range(max(WIDTHS))], axis=2)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        seen = self.columns(windows)
        pooled = (seen.reshape(-1, seen.shape[2]) @ self.filters).reshape(len(windows), seen.shape[1], -1).max(axis=1)
        return softmax(np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def padded(pieces: list[bytes]) -> np.ndarray:
    """One row of WINDOW bytes per piece, cut or filled with zero bytes."""
    joined = b"".join(p[:WINDOW].ljust(WINDOW, b"\0") for p in pieces)
    return np.frombuffer(joined, dtype=np.uint8).reshape(-1, WINDOW)


def train(pieces: list[bytes], labels: list[str], epochs: int = 5, rate: float = 0.01, seed: int = 7) -> ByteNet:
    """Fit by Adam on cross entropy. Pieces are also cut at random so that short texts are learned."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    index = {name: i for i, name in enumerate(languages)}
    y = np.array([index[name] for name in labels])
    x = padded(pieces)
    lengths = np.array([min(len(p), WINDOW) for p in pieces])
    widest, n_filters = max(WIDTHS), FILTERS * len(WIDTHS)
    own = np.zeros((widest * DIMENSIONS, n_filters), dtype=np.float32)
    for i, w in enumerate(WIDTHS):
        own[: w * DIMENSIONS, i * FILTERS : (i + 1) * FILTERS] = 1
    net = ByteNet(
        languages,
        rng.normal(0, 0.5, (256, DIMENSIONS)).astype(np.float32),
        (rng.normal(0, 0.4, own.shape) * own).astype(np.float32),
        np.zeros(n_filters, dtype=np.float32),
        rng.normal(0, 0.3, (n_filters, len(languages))).astype(np.float32),
        np.zeros(len(languages), dtype=np.float32),
    )
    parts = [net.embedding, net.filters, net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    weight = (len(y) / (len(languages) * np.bincount(y, minlength=len(languages)).clip(1)))[y]
    steps = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for start in range(0, len(order), 64):
            rows = order[start : start + 64]
            batch, goal = x[rows].copy(), y[rows]
            cut = np.where(rng.random(len(rows)) < 0.5, (lengths[rows] * rng.random(len(rows))).astype(int) + 8, WINDOW)
            batch[np.arange(WINDOW)[None, :] >= cut[:, None]] = 0
            seen = net.columns(batch)
            response = (seen.reshape(-1, seen.shape[2]) @ net.filters).reshape(len(rows), seen.shape[1], -1)
            place = response.argmax(axis=1)
            pooled = np.take_along_axis(response, place[:, None, :], axis=1)[:, 0]
            hidden = np.maximum(pooled + net.bias, 0)
            error = softmax(hidden @ net.out + net.out_bias)
            error[np.arange(len(rows)), goal] -= 1
            error = (error * weight[rows][:, None] / len(rows)).astype(np.float32)
            back = (error @ net.out.T) * (hidden > 0)
            at = seen[np.arange(len(rows))[:, None], place]  # the inputs each filter kept
            to_input = (back[:, :, None] * net.filters.T[None]).reshape(len(rows), n_filters, widest, DIMENSIONS)
            to_bytes = np.zeros_like(net.embedding)
            kept = batch[np.arange(len(rows))[:, None, None], place[:, :, None] + np.arange(widest)]
            np.add.at(to_bytes, kept.reshape(-1), to_input.reshape(-1, DIMENSIONS))
            slopes = [to_bytes, np.einsum("nf,nfk->kf", back, at) * own, back.sum(0), hidden.T @ error, error.sum(0)]
            steps += 1
            pace = rate * (1 - epoch / (epochs + 1))
            for p, g, m, v in zip(parts, slopes, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= pace * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    return net


def classify(net: ByteNet, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Best language's place and its mean probability per text, over all windows of the text."""
    step = WINDOW - max(WIDTHS) + 1
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(raw) + b"\0" * WINDOW, dtype=np.uint8)
    counts = np.maximum(1, -(-np.maximum(sizes - max(WIDTHS) + 1, 0) // step))
    first = np.concatenate([[0], np.cumsum(counts)])
    total = np.zeros((len(texts), len(net.languages)))
    mass = np.zeros(len(texts))
    for low in range(0, int(first[-1]), _CHUNK):
        window = np.arange(low, min(low + _CHUNK, int(first[-1])))
        doc = np.searchsorted(first, window, side="right") - 1
        begin = starts[doc] + (window - first[doc]) * step
        inside = np.clip(starts[doc + 1] - begin, 0, WINDOW)
        place = np.arange(WINDOW)[None, :]
        windows = np.where(place < inside[:, None], data[begin[:, None] + place], 0)
        share = np.maximum(inside, 1).astype(float)
        np.add.at(total, doc, net.probabilities(windows) * share[:, None])
        np.add.at(mass, doc, share)
    mean = total / np.maximum(mass, 1)[:, None]
    best = mean.argmax(axis=1)
    return best, np.clip(mean[np.arange(len(texts)), best], 0, 1)


def sample_windows(labelled: DataFrame, text: str, lang: str) -> list:
    """Hashed sample of (language, piece) rows: of each language the SAMPLE_PER_LANGUAGE different texts of smallest hash.

    Pieces are cut out of the texts before these travel. Copies of a text count once, however many there are, and no language is left
    out. A task keeps at most the sample of each language it meets; what reaches the driver grows with the languages alone.
    """
    rows = labelled.filter(named(text).isNotNull() & named(lang).isNotNull() & named(text).rlike("\\p{L}"))
    rows = rows.select(F.xxhash64(named(text)).alias("ticket"), named(lang).alias("l"), named(text).alias("t"), F.lower(named(text)).alias("low"))
    spot = "cast(pmod(xxhash64(t, i), greatest(length(low) - 100, 1)) as int)"
    cut = f"transform(sequence(1, {WINDOWS_PER_TEXT}), i -> substring(low, 1 + {spot}, {WINDOW}))"
    pieces = rows.select("l", "ticket", F.expr(cut).alias("pieces"))
    once = pieces.groupBy("l", "ticket").agg(F.min("pieces").alias("pieces"))
    order = Window.partitionBy("l").orderBy("ticket")  # a rank limit is applied before the shuffle too
    sample = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SAMPLE_PER_LANGUAGE)
    return [(r["l"], p.encode("utf-8", "replace")) for r in sample.select("l", "pieces").collect() for p in r["pieces"]]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> ByteNet | None:
    """Train on labelled rows; None where there is no usable row. Only text and lang are read."""
    found = sorted(set(sample_windows(labelled, text, lang)))
    return train([p for _, p in found], [name for name, _ in found]) if found else None


def prediction(net: ByteNet | None, text: Column) -> Column:
    """Struct of ``lang_pred`` and ``score`` for a text column; see ``identify``."""

    @F.pandas_udf("lang_pred string, score double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            best, score = classify(net, list(texts))
            yield pd.DataFrame({"lang_pred": [net.languages[i] for i in best], "score": score})

    nothing = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    if net is None:
        return nothing
    readable = F.coalesce(text.rlike("\\p{L}"), F.lit(False))
    return F.when(readable, apply(F.when(readable, text).otherwise(F.lit("")))).otherwise(nothing)


def identify(df: DataFrame, net: ByteNet | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` (a learned language) and ``score`` (0 to 1), judged on the whole text.

    A null text, or one without a letter, gets `und` and 0, as does every text if nothing could be learned (an empty table).
    Equal texts get equal results; ties go to the language first in order. Other columns stay, also of these two
    names: the added ones then get an underscore in front.
    """
    small_batches(df.sparkSession)
    held = free_name(df, "__language")
    found = df.withColumn(held, prediction(net, named(text)))
    return found.select(
        *[named(c) for c in df.columns],
        F.col(held)["lang_pred"].alias(free_name(df, "lang_pred")),
        F.col(held)["score"].alias(free_name(df, "score")),
    )


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn_from_documents(docs: DataFrame) -> ByteNet | None:
    """The classifier learned from the documents that are not held out; a row without id is not learned from."""
    return fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang"))


def accepted(df: DataFrame, net: ByteNet | None, least: float = 0.35) -> DataFrame:
    """Rows whose language could be told with a score of at least ``least``; the columns stay as they are.

    A null text, or one without a letter, goes, and so does every row if nothing could be learned. Equal texts stay or go together; of an
    empty table nothing comes out.
    """
    held = free_name(df, "__language")
    small_batches(df.sparkSession)
    found = df.withColumn(held, prediction(net, named("text")))
    told = (F.col(held)["lang_pred"] != UNDETERMINED) & (F.col(held)["score"] >= least)
    return found.filter(told).select(*[named(c) for c in df.columns])
