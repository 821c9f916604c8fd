"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

The vocabulary is a trie. Each node has a failure link to the node reached after the longest pieces are taken off its
front, and the number of pieces so taken. Following links while reading a word once counts the
pieces of greedy longest-match without ever cutting the word; the work is linear in the word's length.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import free_name, named, small_batches

VOCABULARY = "word_bpe_49k"
END = "\n"  # stands for the end of a word; no byte is written as this character
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed value: how the vocabulary's words are split
_REMEMBERED = 500_000  # distinct words a worker remembers at once


def byte_letters() -> list[str]:
    """The printable character standing for each byte in byte-level vocabularies: itself if printable, else the next above 255."""
    own = {b for low, high in ((33, 126), (161, 172), (174, 255)) for b in range(low, high + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Automaton:
    """``steps[node][letter]`` is the trie; ``link`` and ``popped`` are the failure link of a node and its count.

    A letter outside the vocabulary, or a front no piece covers, counts as one piece for the whole word; so does an end mark left over by itself.
    """

    def __init__(self, pieces: Iterable[str]):
        self.steps: list[dict[str, int]] = [{}]
        is_piece = [False]
        for p in pieces:
            node = 0
            for letter in p:
                after = self.steps[node].get(letter)
                if after is None:
                    after = self.steps[node][letter] = len(self.steps)
                    self.steps.append({})
                    is_piece.append(False)
                node = after
            is_piece[node] = bool(p)
        self.link: list[int] = [-1] * len(self.steps)
        self.popped = [0] * len(self.steps)
        level = [0]
        while level:
            deeper = []
            for parent in level:
                for letter, node in self.steps[parent].items():
                    deeper.append(node)
                    if is_piece[node]:
                        self.link[node], self.popped[node] = 0, 1
                        continue
                    at, count = self.link[parent], self.popped[parent]
                    while at >= 0 and letter not in self.steps[at]:
                        count += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[node], self.popped[node] = self.steps[at][letter], count
            level = deeper

    def count(self, word: str) -> int:
        """Pieces of greedy longest-match of a word, its END included; 1 if it can't be covered."""
        steps, link, popped = self.steps, self.link, self.popped
        node = total = 0
        for letter in word:
            after = steps[node].get(letter)
            while after is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return 1
                after = steps[node].get(letter)
            node = after
        while node:
            total += popped[node]
            node = link[node]
            if node < 0:
                return 1
        return total


class Counter(dict):
    """Pieces per word, worked out when first asked for; bounded, as it starts anew when full."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton, self.letters = automaton, byte_letters()

    def __missing__(self, word: str) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        letters = self.letters
        n = self.automaton.count("".join([letters[b] for b in word.encode("utf-8", "replace")]) + END)
        if len(word) <= 64:
            self[word] = n
        return n


def load(folder: str | None = None, vocabulary: str = VOCABULARY) -> Automaton:
    """The automaton of a tokenizer file's vocabulary; pieces that end a word are marked there by `</w>`."""
    import public_tokenizers

    path = f"{folder}/{vocabulary}.json" if folder else public_tokenizers.path(f"{vocabulary}.json")
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    special = {t["content"] for t in found["added_tokens"]}
    names = [t for t in found["model"]["vocab"] if t not in special]
    return Automaton(t[:-4] + END if t.endswith("</w>") else t for t in names)


def _counter(folder: str | None, vocabulary: str) -> Counter:
    kept = regex.__dict__.setdefault("_kept_counters", {})  # outlives a task, as an imported module does
    key = (folder, vocabulary)
    if key not in kept:
        kept[key] = Counter(load(folder, vocabulary))
    return kept[key]


def split(text: str) -> list[str]:
    return regex.findall(WORDS, text.lower())


def counted(text: Column, folder: str | None = None, vocabulary: str = VOCABULARY) -> Column:
    @F.pandas_udf("n_words bigint, n_tokens bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = _counter(folder, vocabulary)
        for texts in batches:
            rows = []
            for t in texts:
                words = split(t)
                rows.append((len(words), sum(map(pieces.__getitem__, words))))
            yield pd.DataFrame(rows, columns=["n_words", "n_tokens"])

    return count(F.coalesce(text, F.lit("")))


def with_token_counts(df: DataFrame, text: str = "text", folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Add ``n_words`` and ``n_tokens`` of the whole text: 0 for a null or empty one.

    Texts are lower-cased. Equal rows get equal counts; other columns stay, and added names get an underscore in front where taken.
    """
    small_batches(df.sparkSession)
    held = free_name(df, "__counts")
    return df.withColumn(held, counted(named(text), folder, vocabulary)).select(
        *[named(c) for c in df.columns],
        *[F.col(held)[n].alias(free_name(df, n)) for n in ("n_words", "n_tokens")],
    )
