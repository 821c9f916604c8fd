import os

import pytest
from pyspark.sql import functions as F

from riskloom import session


def test_materialised_tables_live_in_the_checkpoint_folder(spark):
    df = session.materialise(spark.range(10))
    path = df.inputFiles()[0]
    assert path.startswith(session.shared_folder(spark).replace("file:///", "file:/").split(":")[0])
    assert "/tables/" in path and sorted(r["id"] for r in df.collect()) == list(range(10))
    session.clear_tables(spark)
    assert not os.path.exists(path.removeprefix("file://"))


def test_scopes_delete_their_own_tables_only(spark):
    outside = session.materialise(spark.range(3))
    with session.scoped_tables(spark):
        path = session.materialise(spark.range(5)).inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path) and outside.count() == 3
    with pytest.raises(ZeroDivisionError), session.scoped_tables(spark):
        path = session.materialise(spark.range(5)).inputFiles()[0].removeprefix("file://")
        1 / 0
    assert not os.path.exists(path)


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_many_rows_of_one_partition_are_dealt_out_to_all_cores(spark):
    from riskloom.session import ROWS_A_TASK, dealt_out

    cores = spark.sparkContext.defaultParallelism
    rows = 2 * cores * ROWS_A_TASK
    dealt = dealt_out(spark.range(rows).coalesce(1), rows)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == cores and sum(sizes) == rows and max(sizes) < 1.1 * rows / cores
    few = spark.range(100).coalesce(1)
    assert dealt_out(few, 100) is few


def test_a_fit_reads_a_single_file_with_several_tasks(spark, tmp_path, monkeypatch):
    from riskloom.operators import models

    spark.range(40000).selectExpr("id % 7 * 1D AS a", "id % 5 * 1D AS b", "CAST(id % 2 AS INT) AS y").coalesce(1).write.parquet(str(tmp_path / "t"))
    read, fit = [], models.LEARNERS["lr"]

    def watched(*args):
        learner = fit(*args)

        class Seen:
            def fit(self, data):
                read.append(data.rdd.getNumPartitions())
                return learner.fit(data)

        return Seen()

    monkeypatch.setitem(models.LEARNERS, "lr", watched)
    models.fit("lr", spark.read.parquet(str(tmp_path / "t")), ["a", "b"], "y", max_iter=2)
    assert read == [3]


def test_batches_are_made_smaller_never_larger(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name)
    with session.batch_bytes(spark, 1 << 20):
        assert spark.conf.get(name) == str(1 << 20)
        with session.batch_bytes(spark, 1 << 22):
            assert spark.conf.get(name) == str(1 << 20)
    assert spark.conf.get(name) == own
