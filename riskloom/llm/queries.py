"""The registered queries of this package and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (
    credentials,
    fingerprints,
    language,
    lines,
    manifest,
    mixing,
    near_copies,
    ngram_join,
    packing,
    passages,
    spelling,
    token_counts,
    topk,
)
from riskloom.llm.common import read


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.learn_from_documents(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_token_counts(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.classes(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("version").withColumnRenamed("doc", "doc_id")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return credentials.scan(docs.select("doc_id", "text", "source"), ~language.held_out(F.col("doc_id")))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(read(spark, sf_dir, "documents").select("doc_id", "text"), damage_every=31)
    return spelling.variants(words)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.proved_documents(read(spark, sf_dir, "documents"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))


_TOPK_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# CRC-32 of texts whose letters are below U+0100, byte by byte with the table of the reversed polynomial.
_CRC_TABLE_SQL = """
crc_table AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i)
  )
)"""


def _crc_sql(text: str) -> str:
    points = f"list_transform(string_split({text}, ''), lambda c: CAST(unicode(c) AS BIGINT))"
    data = f"flatten(list_transform({points}, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + (p >> 6), 128 + (p & 63)] END))"
    return f"xor(list_reduce([4294967295] || {data}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


_SPELLING_SQL = f"""
WITH RECURSIVE {_CRC_TABLE_SQL}, runs AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '[a-zÀ-ÿ]+')) AS run FROM documents
), occurrences AS (
  SELECT run, count(*) AS n, {_crc_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h
  FROM (SELECT doc_id, run FROM runs WHERE length(run) >= 7), crc_table GROUP BY doc_id, run, t
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM occurrences
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cuts AS MATERIALIZED (
  SELECT DISTINCT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT DISTINCT * FROM (
    SELECT a.word, b.word AS near, b.n AS m FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
    UNION ALL SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
    UNION ALL SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word
  )
), ranked AS (
  SELECT word, near, m, row_number() OVER (PARTITION BY word ORDER BY m DESC, near) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM pairs
), formed AS MATERIALIZED (
  SELECT w.word, CASE WHEN m >= 10 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN m END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND k = 1
), roots AS (
  SELECT word, word AS last, form AS next FROM formed
  UNION ALL SELECT r.word, f.word, f.form FROM roots r JOIN formed f ON f.word = r.next
)
SELECT f.word, f.form, last AS root, n, n_near, form_n FROM formed f JOIN roots r ON r.word = f.word AND r.next IS NULL
"""


def _manifest_sql(levels: int = 8, fanout: int = 16) -> str:
    """Trees level by level. A tree of one node passes a level as it is, so unrolled levels do for 16 ** 8 leaves a source and as many sources."""

    def sha(parts: str) -> str:
        return f"sha256({parts})"

    def value(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"

    def leaf(text: str) -> str:
        return sha(" || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars", text)))

    steps = [_CRC_TABLE_SQL]
    steps.append(
        f"d AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {_crc_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 "
        f"THEN {leaf(_LOWER.format('text'))} END AS altered FROM documents, crc_table)"
    )
    steps.append("sources AS MATERIALIZED (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM d))")
    steps.append(
        "p0 AS MATERIALIZED (SELECT doc_id, leaf, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS node, "
        "coalesce(altered, leaf) AS cur, '' AS proof FROM d JOIN sources s ON s.source IS NOT DISTINCT FROM d.source)"
    )
    step = 0

    def climb(of: str) -> None:
        """One level up: ``p`` holds a row per document with its ancestor's place and digest, its folded digest and its proof so far."""
        nonlocal step
        steps.append(
            f"r{step} AS MATERIALIZED (SELECT {of}, run, list(node ORDER BY pos) AS members, sum(count(*)) OVER (PARTITION BY {of}) AS nodes FROM "
            f"(SELECT DISTINCT {of}, pos, pos // {fanout} AS run, node FROM p{step}) GROUP BY {of}, run)"
        )
        place = f"pos % {fanout}"
        before, after = f"array_to_string(members[1:{place}], '')", f"array_to_string(members[{place} + 2:], '')"
        rest = "p.* EXCLUDE (pos, node, cur, proof)"
        steps.append(
            f"p{step + 1} AS MATERIALIZED (SELECT {rest}, CASE WHEN nodes = 1 THEN pos ELSE run END AS pos, CASE WHEN nodes = 1 THEN node ELSE "
            f"{sha(chr(39) * 2 + ' || array_to_string(members, ' + chr(39) * 2 + ')')} END AS node, CASE WHEN nodes = 1 THEN cur ELSE "
            f"{sha(f'{before} || cur || {after}')} END AS cur, CASE WHEN nodes = 1 THEN proof ELSE proof || {before} || {after} END AS proof "
            f"FROM p{step} p JOIN r{step} r ON r.{of} = p.{of} AND r.run = p.pos // {fanout})"
        )
        step += 1

    for _ in range(levels):
        climb("tree")
    steps.append(f"p{step + 1} AS MATERIALIZED (SELECT doc_id, leaf, 0 AS top, node AS subroot, tree AS pos, node, cur, proof FROM p{step})")
    step += 1
    for _ in range(levels):
        climb("top")
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, node AS root, {sha('proof')} AS proof_sha256, cur AS folded_root, cur = node AS verified FROM p{step}"


_NGRAM_SQL = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE
    list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM texts WHERE w IS NOT NULL
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
  ) JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b WHERE 100 * shared >= 85 * (m.n + n.n - shared)
), reach AS (
  SELECT doc_id, doc_id AS other FROM sizes
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(other) AS component FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""


def queries():
    found = [
        op1_language, op2_fingerprints, op3_passages, op4_mixing, op5_token_counts, op6_near_copies, op7_lines, op8_topk, op9_packing,
        op10_secrets, op11_spelling, op12_manifest, op13_ngram_join,
    ]
    return {f.__name__: f for f in found}


def oracle():
    return {"op8_topk": _TOPK_SQL, "op11_spelling": _SPELLING_SQL, "op12_manifest": _manifest_sql(), "op13_ngram_join": _NGRAM_SQL}
