"""Incremental ingest: new ids only, and idempotent batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groovemill.sources import versions
from groovemill.sources.checkpoints import checkpointed


def unseen(stream: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of the stream whose key a static table doesn't have yet."""
    return stream.join(existing.select(key), key, "left_anti")


def once_per_key(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def write_new_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is there now, then ends; a run with nothing new does nothing, and none is written twice."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def register_batch(rows: DataFrame, batch_id: int, path: str, key: str, stream: str = "batches") -> None:
    """Appends the batch's distinct ids to the versioned registry of batches (run_at, review_ids) as JSON lines, whole or not at all.

    Nothing is written if the batch has no ids, has been registered before (a batch may be delivered twice), or the latest
    batch has the same ids, also where another writer commits meanwhile. A batch's ids are one row, as the registry's
    readers expect.
    """
    spark = rows.sparkSession
    new = checkpointed(rows.where(F.col(key).isNotNull()).agg(F.array_sort(F.collect_set(key)).alias("review_ids")).where(F.size("review_ids") > 0).select(F.current_timestamp().alias("run_at"), "review_ids"))

    def with_new(known: DataFrame | None) -> DataFrame | None:
        if new.isEmpty() or known is None:
            return None if new.isEmpty() else new
        latest = known.orderBy(F.col("run_at").desc()).limit(1).select(F.array_sort("review_ids").alias("review_ids"))
        added = new.join(latest, "review_ids", "left_anti").select("run_at", "review_ids")
        return None if added.isEmpty() else known.unionByName(added)

    versions.replace(spark, path, with_new, "json", (stream, batch_id))


def register_batches(stream: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Registers each micro-batch of the stream once."""
    return stream.writeStream.foreachBatch(lambda rows, batch_id: register_batch(rows, batch_id, path, key)).option("checkpointLocation", checkpoint).start()
