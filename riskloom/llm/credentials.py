"""Secret scans: candidates found by patterns, false positives removed by a random forest, all in DataFrame operations.

A candidate is judged by its length and make-up, how likely its letters follow one another in the corpus's own words, how much of it
dictionary words cover, the path it was found under, and the words around it. The forest is trained on labelled findings. Dictionary and
letter transitions are counted over all texts.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import named
from riskloom.session import materialise

# What makes a word a candidate, what a candidate is, and the words that speak for or against a secret.
RUN = "[A-Za-z0-9+/_-]{12,}"
KEYED = "(?i:password|passwd|pwd|secret|token|key)(?:[0-9_.-][A-Za-z0-9_.-]{0,200})?[\"']?"
NAME = f"[A-Za-z0-9_.-]{{0,200}}{KEYED}"
GIVES = "[:=]=?>?"
VALUE = "[\"']?([^\\s\"']{6,})"
NUMBERED_RUN = "(?=[A-Za-z+/_-]{0,200}[0-9])[A-Za-z0-9+/_-]{12,}"
CANDIDATE = f"{NUMBERED_RUN}|{KEYED}\\s*{GIVES}\\s*{VALUE}"
ASSIGNED = f"{KEYED}{GIVES}{VALUE}"
SPANNING = f"{KEYED}\\s*{GIVES}\\s*{VALUE}\\S*$"  # the value lies in the last word
SPEAKS_FOR = "(?i)passw|pwd|secret|token|key|auth|credential|bearer|access|private"
SPEAKS_AGAINST = "(?i)example|sample|test|dummy|phone|tel|version|license|uuid|sha|md5|commit|checksum|card|order|invoice"
ISSUED = "^(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,}|xox[abp]-[A-Za-z0-9-]{10,})$"

NEIGHBOURS = 3
FINDINGS = 20_000  # labelled findings of each class the forest is trained on, at most
TREES, DEPTH = 30, 8
_COMMON = 1 / 50_000  # share of all words from which a word is in the dictionary, which bounds its size
_LETTERS = 28  # a to z, digits, everything else

FEATURES = [
    "length", "digits", "capitals", "small", "hex", "distinct", "transitions", "covered", "for_before", "against_before",
    "for_after", "against_after", "assigned", "quoted", "path_for", "path_against", "path_place",
]


def candidates(df: DataFrame, text: str = "text", path: str = "source", key: str = "doc_id") -> DataFrame:
    """(key, path, place, word, value, before, after): every candidate of the whole texts and its neighbouring words.

    ``place`` counts the words of the text from 0. A word may hold several candidates: its runs and what it
    assigns, or what the words before it assign. Null and empty texts hold none.
    """
    found = df.select(named(key).alias("key"), named(path).cast("string").alias("path"), named(text).alias("body"))
    found = found.filter(F.col("body").rlike(CANDIDATE)).select("key", "path", F.split("body", "\\s+").alias("words"))
    # A value may follow its name after blanks: a word is read with the two before it.
    tail = F.transform("words", lambda w, i: F.concat_ws(" ", F.get("words", i - 2), F.get("words", i - 1), w))
    found = found.select("key", "path", "words", F.posexplode(tail).alias("place", "tail"))
    word = F.element_at("words", F.col("place") + 1)
    found = found.filter(word.rlike(NUMBERED_RUN) | F.col("tail").rlike(SPANNING) | word.rlike(ASSIGNED))
    found = found.select(
        "key", "path", "place", word.alias("word"), "tail",
        F.concat_ws(" ", F.slice("words", F.greatest(F.lit(1), F.col("place") + 1 - NEIGHBOURS), F.least(F.lit(NEIGHBOURS), F.col("place")))).alias("before"),
        F.concat_ws(" ", F.slice("words", F.col("place") + 2, F.lit(NEIGHBOURS))).alias("after"),
    )
    inside = F.regexp_extract_all("word", F.lit(ASSIGNED), F.lit(1))
    assigned = F.when(F.size(inside) > 0, inside).otherwise(F.array(F.regexp_extract("tail", SPANNING, 1)))
    # A name is no value, whatever it looks like; its sign may open the next word.
    unnamed = F.regexp_replace("word", f"{NAME}(?={GIVES})", " ")
    unnamed = F.when(F.col("after").rlike(f"^{GIVES}"), F.regexp_replace(unnamed, f"{NAME}$", " ")).otherwise(unnamed)
    runs = F.filter(F.regexp_extract_all(unnamed, F.lit(f"({RUN})"), F.lit(1)), lambda r: r.rlike("[0-9]"))
    found = found.withColumn("value", F.explode(F.array_union(runs, assigned))).filter(F.length("value") > 0)
    return found.select("key", "path", "place", "word", "value", "before", "after")


def dictionary(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Words common enough in all texts, and log-probabilities of one letter class after another in all words by their counts."""
    words = df.select(F.explode(F.split(F.lower(named(text)), "[^a-z0-9]+")).alias("word")).filter("word != ''")
    counts = materialise(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = counts.filter((F.col("n") >= total * _COMMON) & F.col("word").rlike("^[a-z]{3,8}$")).select("word")
    steps = counts.select("n", F.explode(_steps("word")).alias("s")).groupBy("s.a", "s.b").agg(F.sum("n").alias("n"))  # _LETTERS squared rows
    steps = materialise(steps, "steps")
    outs = steps.groupBy("a").agg(F.sum("n").alias("all"))
    likely = steps.join(F.broadcast(outs), "a").select("a", "b", F.log2((F.col("n") + 1) / (F.col("all") + _LETTERS)).alias("bits"))
    return materialise(common, "dictionary"), materialise(likely, "transitions")


def _steps(word: str) -> Column:
    kind = "if({0} BETWEEN 97 AND 122, {0} - 97, if({0} BETWEEN 48 AND 57, 26, 27))"
    one, two = (kind.format(f"ascii(substring({word}, i + {o}, 1))") for o in (0, 1))
    return F.expr(f"if(length({word}) > 1, transform(sequence(1, length({word}) - 1), i -> struct({one} AS a, {two} AS b)), array())")


def described(found: DataFrame, common: DataFrame, likely: DataFrame) -> DataFrame:
    """Candidates with the columns FEATURES and a row number ``at``."""
    rows = materialise(found.withColumn("at", F.monotonically_increasing_id()), "candidates")
    steps = rows.select("at", F.explode(_steps("lower(value)")).alias("s")).select("at", "s.a", "s.b")
    unseen = -16.0
    odds = steps.join(F.broadcast(likely), ["a", "b"], "left").groupBy("at").agg(F.avg(F.coalesce("bits", F.lit(unseen))).alias("transitions"))
    low = F.lower("value")
    parts = rows.select("at", low.alias("v"), F.explode(F.expr("sequence(3, 8)")).alias("n")).filter(F.length("v") >= F.col("n"))
    parts = parts.select("at", "v", "n", F.explode(F.expr("sequence(1, length(v) - n + 1)")).alias("i"))
    parts = parts.select("at", "n", "i", F.expr("substring(v, i, n)").alias("word")).join(F.broadcast(common), "word")
    covered = parts.select("at", F.explode(F.expr("sequence(i, i + n - 1)")).alias("c")).groupBy("at").agg(F.countDistinct("c").alias("n_covered"))
    length = F.length("value")

    def share(pattern: str) -> Column:
        return F.regexp_count("value", F.lit(pattern)) / length

    def says(text: str, pattern: str) -> Column:
        return F.coalesce(F.col(text).rlike(pattern), F.lit(False)).cast("double")

    named_by = F.concat_ws(" ", "before", F.expr("if(instr(word, value) > 1, substring(word, 1, instr(word, value) - 1), '')"))
    rows = rows.withColumn("led", named_by).join(odds, "at", "left").join(covered, "at", "left")
    return rows.select(
        "*",
        length.cast("double").alias("length"), share("[0-9]").alias("digits"), share("[A-Z]").alias("capitals"), share("[a-z]").alias("small"),
        F.col("value").rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double").alias("hex"),
        (F.size(F.array_distinct(F.split("value", ""))) / length).alias("distinct"),
        (F.coalesce("n_covered", F.lit(0)) / length).alias("covered"),
        says("led", SPEAKS_FOR).alias("for_before"), says("led", SPEAKS_AGAINST).alias("against_before"),
        says("after", SPEAKS_FOR).alias("for_after"), says("after", SPEAKS_AGAINST).alias("against_after"),
        says("led", "[:=]\\s*[\"']?$").alias("assigned"), says("word", "[\"']").alias("quoted"),
        says("path", SPEAKS_FOR).alias("path_for"), says("path", SPEAKS_AGAINST).alias("path_against"),
        F.coalesce(F.pmod(F.xxhash64("path"), F.lit(16)), F.lit(-1)).cast("double").alias("path_place"),
    ).fillna(0.0, ["transitions"])


def assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def train(rows: DataFrame, label: str = "label", trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel | None:
    """A forest from described rows with a label 0 or 1 (others are left out); None unless both occur.

    At most FINDINGS of each class are used, drawn by a hash of the finding.
    """
    rows = rows.filter(F.col(label).isin(0, 1))
    ticket = F.xxhash64("value", "before", "after")
    parts = [rows.filter(F.col(label) == c).orderBy(ticket, "at").limit(FINDINGS).select(*FEATURES, F.col(label).cast("double").alias("label")) for c in (0, 1)]
    used = materialise(parts[0].unionByName(parts[1]), "findings")
    if used.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, featuresCol="features", labelCol="label")
    return forest.fit(assembled(used))


def judged(rows: DataFrame, forest: RandomForestClassificationModel | None) -> DataFrame:
    """Described rows with ``score``, the forest's probability of a secret; without a forest, null."""
    if forest is None:
        return rows.withColumn("score", F.lit(None).cast("double"))
    found = forest.transform(assembled(rows))
    return found.withColumn("score", F.round(vector_to_array("probability")[1], 9)).drop("features", "rawPrediction", "probability", "prediction")


def by_format(rows: DataFrame) -> Column:
    """Label of a finding whose format settles it, for training where no reviewed findings exist; null if undecided.

    An issuer's format, or 16 or more hexadecimal or mixed characters given to a name that speaks of secrets, is one; digits alone, words
    and what is called an example are none.
    """
    value = F.col("value")
    issued = value.rlike(ISSUED)
    given = (F.col("assigned") > 0) & (F.col("for_before") > 0) & value.rlike("^[A-Za-z0-9+/_-]{16,}$") & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    none = value.rlike("^[0-9_+/-]+$") | ~value.rlike("[0-9]") | (F.col("against_before") > 0)
    return F.when(none, 0).when(issued | given, 1).when((F.col("for_before") == 0) & (F.col("digits") < 0.2), 0)


def scan(df: DataFrame, learn_from: Column, text: str = "text", path: str = "source", key: str = "doc_id") -> DataFrame:
    """Every candidate with its score: key, place, value, score and is_secret (0.5 or more; null scores give null).

    The forest learns from the findings of rows where ``learn_from`` holds, labelled by their format. Repeated rows repeat their findings.
    Null or empty texts and an empty table give no rows; a null path is a path of its own. Other columns are not returned, so their
    names can't clash.
    """
    common, likely = dictionary(df, text)
    clear = df.select(named(text).alias("__text"), named(path).alias("__path"), F.struct(named(key).alias("id"), F.coalesce(learn_from, F.lit(False)).alias("use")).alias("__key"))
    rows = materialise(described(candidates(clear, "__text", "__path", "__key"), common, likely), "described")
    forest = train(rows.withColumn("label", F.when(F.col("key.use"), by_format(rows))))
    found = judged(rows, forest)
    return found.select(F.col("key.id").alias(key), "place", "value", "score", (F.col("score") >= 0.5).alias("is_secret"))
