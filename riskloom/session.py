"""Session helpers: the shared folder, and materialising intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Mappings measured up to this size are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 * 1024 * 1024

# Rows that are worth a task of their own where a job reads the same rows again and again.
ROWS_A_TASK = 1 << 14
MOST_ROWS_A_TASK = 1 << 20

# Settings worth having in any session running these jobs; all can be changed at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, taken from ``spark.checkpoint.dir``.

    Where that setting is absent a private folder is used, but only in local
    mode: on a cluster a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            configured = tempfile.mkdtemp(prefix="riskloom-")
        sc.setCheckpointDir(configured)
        folder = sc.getCheckpointDir()
    return folder


_scopes: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    return "/".join([shared_folder(spark), "tables", *_scopes[-1:], f"{label}-{uuid.uuid4().hex}"])


@contextmanager
def scoped_tables(spark: SparkSession) -> Iterator[None]:
    """Delete what is materialised inside once the block ends: use results, or write them elsewhere, before that."""
    name = f"scope-{uuid.uuid4().hex}"
    _scopes.append(name)
    try:
        yield
    finally:
        _scopes.remove(name)
        _delete(spark, f"{shared_folder(spark)}/tables/{name}")


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write once to the shared folder and read back.

    This cuts the lineage, so a value that depends on partition placement stays
    fixed if an executor is lost, and keeps column pruning for later readers.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def task_count(spark: SparkSession, rows: int) -> int:
    """Over how many partitions ``dealt_out`` deals so many rows."""
    cores = spark.sparkContext.defaultParallelism
    return max(min(cores, -(-rows // ROWS_A_TASK)), rows // MOST_ROWS_A_TASK)


def dealt_out(df: DataFrame, rows: int) -> DataFrame:
    """The same rows evenly over all cores, for jobs that read them again and again; over more partitions where they are very many.

    A small file is read by one task, however many passes follow. Rows that fill a single task stay where they are.
    """
    many = task_count(df.sparkSession, rows)
    return df.repartition(many) if many > 1 else df


@contextmanager
def batch_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Rows travel to Python, in jobs run inside, in batches of about so many bytes at most: never more than the session's own limit.

    A batch is held several times over, by the JVM and by each Python process a task's rows pass through.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name)
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(own)
    if limit > most or limit <= 0:
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def discard(table: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more, such as the former state of a loop."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        _delete(table.sparkSession, folder)


def clear_tables(spark: SparkSession) -> None:
    """Delete the tables this session materialised, once none of its results is needed."""
    _delete(spark, f"{shared_folder(spark)}/tables")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, in any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
