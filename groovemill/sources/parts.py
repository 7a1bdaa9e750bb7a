"""How many partitions a step needs, from the rows of the table it starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: About as many rows are in a task, so that its memory doesn't grow with the input.
ROWS = 1 << 20


def parts_of(table: DataFrame) -> int:
    """Partitions of about ROWS rows of a Parquet table; Spark counts these by the files' footers."""
    return -(-table.count() // ROWS)


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``df`` in so many partitions by its keys; as it is where Spark's own number of partitions is enough."""
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
