"""Tables written on the way, in the folder that all machines of the cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, a temporary folder, which only a local session may use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="groovemill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def _folder(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once as a Parquet table and read again: later uses read the table, also after an executor is lost.

    Tables go when the driver ends, or earlier by ``forget`` and ``clear_stored``. Loops take them instead of checkpoints:
    Spark keeps the estimated size of what it checkpoints and multiplies those of joined tables, round after round.
    """
    spark = df.sparkSession
    path, files = _folder(spark, _tables(spark))
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    table = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(table)
    found = spark.read.schema(df.schema).parquet(table)
    found.stored_in = table
    return found


def forget(table: DataFrame) -> None:
    """Removes a stored table that nothing reads any more."""
    path, files = _folder(table.sparkSession, table.stored_in)
    files.delete(path, True)


def clear_stored(spark: SparkSession) -> None:
    """Removes all tables that this application has stored, once nothing that was made of them is needed any more."""
    path, files = _folder(spark, _tables(spark))
    files.delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint, which Spark removes when nothing refers to it any more."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
