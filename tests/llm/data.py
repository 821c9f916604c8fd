"""Small tables the corpus tests share."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use for what they add.
CLASHING = ["score", "Lang_Pred", "size", "copies", "target", "source_size", "n_words", "n_tokens", "piece", "node", "digest", "body", "doc", "label", "bucket", "__source", "row", "h", "k"]


def prose(seed: int, words: int, letters: str = "abcdefghij") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(words))


def odd_rows():
    """Nulls in every column, empty and wordless texts, repeated rows, repeated and missing keys, a very long text."""
    long_ = "\n".join(prose(i, 12) for i in range(1500))
    return [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (None, prose(1, 80), "en", "a", 1),
        (None, prose(1, 80), "en", "a", 1),
        (3, "!!! ... ???", "en", None, 3),
        (4, prose(2, 120) + "\n" + prose(3, 9), "de", "b", 4),
        (4, prose(2, 120) + "\n" + prose(3, 9), "de", "b", 4),
        (5, prose(2, 120) + "\n" + prose(3, 9), "de", "a", 4),
        (6, prose(4, 60) + " " + "x" * 5000, "de", "b", 5),
        (6, prose(5, 60), "de", "c", 5),
        (7, long_, "en", "c", 6),
        (8, "\n\n\n", "en", "c", 3),
        (9, "word", "en", "c", 4),
    ]


def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), SCHEMA)
    return df.select("*", *[F.lit("kept").alias(c) for c in CLASHING])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
