import os
import uuid

import pytest
from pyspark.sql import functions as F

from catalog.frames import lending_tables
from riskloom.plans import applicants as A
from riskloom.sources.tables import write_bucketed

FOLDER = "/root/testdata/sf0.001"


def test_coded_table_and_its_clusters(spark):
    df = spark.range(200).select(
        F.col("id").alias("SK_ID_CURR"),
        (F.col("id") % 4 == 0).cast("int").alias("TARGET"),
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("kind"),
        (F.col("id") * 1.5).alias("AMT_CREDIT"),
        F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id")).cast("double").alias("X_MEAN"),
    )
    table = A.coded_applicants(df)
    assert (table.values, table.codes, table.n_codes) == (["AMT_CREDIT", "X_MEAN"], ["kind"], 3)
    got = {r["SK_ID_CURR"]: r for r in table.rows.collect()}
    assert len(got) == 200 and [got[i]["kind"] for i in range(3)] == [0, 1, 2]
    assert got[199]["AMT_CREDIT"] == 1.0 and got[5]["X_MEAN"] == 0.0
    rows, attributes = A.applicant_clusters(table, zero_share=0.5)
    assert attributes == ["kind"]
    assert {r["cluster_id"]: r["degree"] for r in rows.collect()} == {0: 67, 1: 67, 2: 66}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
def test_bucketed_tables_spare_the_exchanges(spark, tmp_path):
    plain = lending_tables(spark, FOLDER)
    tables = write_bucketed(plain, str(tmp_path), f"t{uuid.uuid4().hex}", 8)  # as many as shuffle partitions

    def exchanged(t):
        plan = A.applicant_features(t)._jdf.queryExecution().executedPlan().toString()
        return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # Left are the credits, which balances meet by their own key, and the balances' sums per applicant: a row per credit and less.
        found = exchanged(tables)
        assert len(exchanged(plain)) > 10 and len(found) <= 2, found
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_key_too_large_for_a_bucket_is_refused(spark, tmp_path):
    df = spark.range(9000).selectExpr("IF(id % 3 = 0, 7, id) AS SK_ID_CURR")
    with pytest.raises(ValueError, match="3000 of 9000|3001 of 9000"):
        write_bucketed({"pos_cash_balance": df}, str(tmp_path), "hot", 16)


def test_a_table_with_one_large_key_is_read_as_it_is(spark, tmp_path):
    """One applicant, or rows without one, may hold too much for a bucket; the other tables are bucketed all the same."""
    hot = spark.range(20000).selectExpr("id AS SK_ID_PREV", "CASE WHEN id % 2 = 0 THEN id END AS SK_ID_CURR")
    even = spark.range(2000).selectExpr("id AS SK_ID_CURR")
    tables = {"pos_cash_balance": hot, "application": even}
    made = write_bucketed(tables, str(tmp_path), f"t{uuid.uuid4().hex}", 16, refuse=False)
    assert made["pos_cash_balance"] is hot
    assert made["application"] is not even and made["application"].count() == 2000
