"""Lineage cuts for iterative operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder; a cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="groovemill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _new_table(spark: SparkSession, name: str) -> str:
    folder = f"{shared_folder(spark)}/rounds-{spark.sparkContext.applicationId}"
    path, files = _path(spark, folder)
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a Parquet table in the shared folder; the tables of an application go when its driver ends.

    For loops: Spark keeps the estimated size of what it checkpoints and multiplies those of joined tables, so that after some
    rounds the numbers alone take minutes. A table's size is that of its files.
    """
    spark = df.sparkSession
    table = _new_table(spark, name)
    df.write.parquet(table)
    found = spark.read.schema(df.schema).parquet(table)
    found.stored_in = table
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: computed once, and read from a stored table from then on."""
    return stored(df, "checkpoint")


def in_buckets(df: DataFrame, parts: int, key: str) -> DataFrame:
    """``df`` from a stored table in buckets by its key: joins and sums by that key don't deal it out again.

    There are so many buckets, but no fewer than Spark's own number of partitions, as Spark would deal fewer out again.
    """
    spark = df.sparkSession
    parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table, name = _new_table(spark, "buckets"), f"buckets_{uuid.uuid4().hex}"
    # a bucket is a partition of the shuffle, so each is one file
    df.repartition(parts, key).write.format("parquet").bucketBy(parts, key).option("path", table).saveAsTable(name)
    found = spark.table(name)
    found.stored_in, found.named = table, name
    return found


@contextmanager
def bucketed(df: DataFrame, parts: int, key: str) -> Iterator[DataFrame]:
    """``in_buckets`` for as long as the block lasts."""
    found = in_buckets(df, parts, key)
    try:
        yield found
    finally:
        forget(found)


def forget(*tables: DataFrame) -> None:
    """Removes stored tables that nothing reads any more."""
    for table in tables:
        if getattr(table, "named", None):
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {table.named}")
        path, files = _path(table.sparkSession, table.stored_in)
        files.delete(path, True)
