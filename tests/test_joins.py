from pyspark.sql import functions as F

from riskloom.operators.joins import lookup_join, measure


def test_both_ways_give_the_same_rows(spark):
    rows = spark.range(30000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 4000).alias("k")
    )
    mapping = rows.filter("k IS NULL OR k < 3990").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    small = lookup_join(rows, mapping, ["k"], "n")
    large = lookup_join(rows, mapping, ["k"], "n", broadcast_bytes=0)
    assert large.columns == small.columns
    key = lambda r: r["id"]
    assert sorted(small.collect(), key=key) == sorted(large.collect(), key=key)
    assert large.count() == 30000
    assert large.filter("k = 7 AND top IS NULL").count() == 0 and large.filter("k IS NULL AND top IS NULL").count() == 0


def test_hot_key_does_not_pile_up(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(40000).select("id", F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("k"))
        mapping = rows.groupBy("k").agg(F.count("*").alias("n"))
        out = lookup_join(rows, mapping, ["k"], "n", broadcast_bytes=0)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2 * 40000 / len(sizes)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lists_of_records_are_measured_in_full(spark):
    record = F.struct(F.lit(1.0).alias("d"), F.lit(2).cast("bigint").alias("k"))
    mapping = spark.range(10).select("id", F.lit(1).alias("n"), F.array_repeat(record, 20).alias("all"))
    assert measure(mapping, "n")[0]["bytes"] >= 10 * 20 * 24
