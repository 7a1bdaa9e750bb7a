"""Edges of the artist graph as GraphML, whose attributes are text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE = "_source string, _target string, data array<string>"
#: Most edges of a file, some 30 MB: a document can't be split, so a task reads whole ones.
EDGES = 1 << 18


def write_edges(edges: DataFrame, path: str) -> None:
    """Edges (src, dst, weight) as ``edge`` elements; each of Spark's files is a document of its own, of at most EDGES."""
    rows = edges.select(F.col("src").alias("_source"), F.col("dst").alias("_target"), F.array(F.col("weight").cast("string")).alias("data"))
    rows.write.mode("overwrite").format("xml").option("rootTag", "graphml").option("rowTag", "edge").option("maxRecordsPerFile", EDGES).save(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, weight of a GraphML file or folder; an edge without a weight that is a number weighs 1."""
    rows = spark.read.format("xml").schema(EDGE).option("rowTag", "edge").load(path)
    return rows.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.coalesce(F.get("data", F.lit(0)).try_cast("double"), F.lit(1.0)).alias("weight"))
