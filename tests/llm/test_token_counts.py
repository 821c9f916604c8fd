import json
import random

import public_tokenizers
import pytest

from riskloom.llm import token_counts as T
from tests.llm.data import empty, odd


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return {t[:-4] + T.END if t.endswith("</w>") else t for t in json.load(f)["model"]["vocab"]}


def greedy(word, pieces):
    count = 0
    while word:
        size = next((n for n in range(len(word), 0, -1) if word[:n] in pieces), 0)
        if not size:
            return 1
        word, count = word[size:], count + 1
    return count


def test_matches_greedy_longest_match(vocabulary):
    counter, letters, rng = T.Counter(T.load()), T.byte_letters(), random.Random(5)
    words = ["the", "äöü", "日本語", "a" * 3000, "'s", "9", "…"] + ["".join(rng.choice("abcdeinorst'é") for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    for w in words:
        assert counter[w] == greedy("".join(letters[b] for b in w.encode()) + T.END, vocabulary)


def test_pops_pieces_along_failure_links():
    automaton = T.Automaton(["a", "ab", "abcd", "b", "c\n", "d\n", "\n"])
    for w in ["abc\n", "abcd\n", "abcab\n", "abab\n", "aabcd\n", "x\n", "\n"]:
        assert automaton.count(w) == greedy(w, {"a", "ab", "abcd", "b", "c\n", "d\n", "\n"})


def test_byte_letters_are_those_of_the_vocabulary(vocabulary):
    assert set(T.byte_letters()) <= vocabulary and len(set(T.byte_letters())) == 256


def test_whole_texts(spark, vocabulary):
    rows = [(1, "The cat's 12 mats, Straße!"), (2, "a" * 70 + " the"), (3, "THE the")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    letters = T.byte_letters()
    for r in T.with_token_counts(df).collect():
        words = T.split(r.text)
        assert r.n_words == len(words)
        assert r.n_tokens == sum(greedy("".join(letters[b] for b in w.encode()) + T.END, vocabulary) for w in words)
    assert T.split("The cat's 12 mats, Straße!") == ["the", "cat", "'s", "1", "2", "mats", ",", "straße", "!"]


def test_odd_rows(spark):
    found = T.with_token_counts(odd(spark))
    assert found.columns[-2:] == ["_n_words", "_n_tokens"]
    by = {r.doc_id: (r["_n_words"], r["_n_tokens"]) for r in found.collect()}
    assert by[1] == by[2] == by[8] == (0, 0) and by[7][0] == 18000 and by[9][0] == 1
    assert T.with_token_counts(empty(spark)).count() == 0


def test_a_word_that_leaves_only_its_end_mark_counts_one(vocabulary):
    letters = "".join(T.byte_letters()[b] for b in "ciónue".encode())
    assert T.Counter(T.load())["ciónue"] == greedy(letters + T.END, vocabulary) == 1 and greedy(letters, vocabulary) == 3
