import collections

import pytest
from pyspark.sql import functions as F

from riskloom.llm import language as L
from riskloom.llm import queries
from tests.llm.data import empty, odd

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def net(spark):
    return L.learn_from_documents(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", "text")
    found = queries.op1_language(spark, FOLDER).join(docs, "doc_id").filter("held_out").toPandas()
    assert (found.lang == found.lang_pred)[found.text.str.len() >= 60].mean() > 0.99
    assert found.score.between(0, 1).all()
    assert set(found.lang_pred) <= {"de", "en", "es", "fr", "und"}


def test_rows_learned_from_exclude_held_out(spark):
    rows = [(i, "text", "en") for i in range(200)] + [(None, "text", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    held = df.withColumn("h", L.held_out(F.col("doc_id"))).collect()
    import zlib

    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)


def test_odd_rows(spark, net):
    found = L.identify(odd(spark), net)
    assert found.columns[-2:] == ["_lang_pred", "_score"]
    rows = found.collect()
    assert len(rows) == 13 and all(r.score == "kept" for r in rows)
    by = {r.doc_id: (r["_lang_pred"], r["_score"]) for r in rows}
    assert by[1] == by[2] == by[3] == by[8] == ("und", 0.0)
    assert by[7][0] != "und" and 0 < by[7][1] <= 1


def test_long_text_is_read_to_its_end(spark, net):
    german = "und der die das nicht mit einer schen Heit und der Schung ist ein "
    english = "the and of that with this was for the thing "
    docs = spark.createDataFrame([(1, english * 3), (2, english * 3 + german * 400)], "doc_id bigint, text string")
    found = {r.doc_id: r.lang_pred for r in L.identify(docs, net).collect()}
    assert found == {1: "en", 2: "de"}


def test_nothing_to_learn_from(spark):
    assert L.learn_from_documents(empty(spark)) is None
    assert L.identify(empty(spark), None).count() == 0
    found = L.identify(odd(spark), None).collect()
    assert {r["_lang_pred"] for r in found} == {"und"}


def test_accepted_keeps_columns(spark, net):
    kept = L.accepted(odd(spark), net)
    assert kept.columns == odd(spark).columns
    assert {1, 2, 3, 8}.isdisjoint({r.doc_id for r in kept.collect()})


def test_copies_of_one_text_leave_the_other_languages_their_sample(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("lang is not null").select("text", "lang")
    text = docs.filter("lang = 'en' and length(text) > 200").agg(F.min("text")).first()[0]
    many = spark.range(6000).select(F.lit(text).alias("text"), F.lit("en").alias("lang"))
    plain = collections.Counter(name for name, _ in L.sample_windows(docs, "text", "lang"))
    found = collections.Counter(name for name, _ in L.sample_windows(docs.unionByName(many), "text", "lang"))
    assert found == plain and len(found) == docs.select("lang").distinct().count()
    assert max(found.values()) <= L.SAMPLE_PER_LANGUAGE * L.WINDOWS_PER_TEXT


def test_any_number_of_languages(spark):
    rows = [("word %d and more" % i, "l%d" % (i % 300)) for i in range(900)]
    sample = L.sample_windows(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    assert len({name for name, _ in sample}) == 300
