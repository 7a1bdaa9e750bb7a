"""Ingest batches: inference from arrival times, merging, and keyed merges of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groovemill.sources.checkpoints import forget, stored

#: Longest time from a batch's first arrival to its last.
SPAN_SECONDS = 3 * 3600


def next_anchors(times: DataFrame, key: str, span: int) -> DataFrame:
    """key, at, next: for each of the distinct times (key, at) the first one more than ``span`` later, null if there is none.

    Searched for within buckets of time, as long as the span; beyond a bucket's end the least time of the next one that has any
    is known from one row for each bucket.
    """
    width = max(1, span)
    bucket = lambda x: F.floor(x / width).cast("long")
    asked = times.select(key, (F.col("at") + span).alias("time"), F.col("at").alias("asks"))
    both = times.select(key, F.col("at").alias("time"), F.lit(None).cast("long").alias("asks")).union(asked).withColumn("bucket", bucket(F.col("time")))
    arrival = F.when(F.col("asks").isNull(), F.col("time"))
    later = Window.partitionBy(key, "bucket").orderBy(F.col("time").desc(), F.col("asks").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("inside", F.min(arrival).over(later)).where("asks IS NOT NULL")
    beyond = Window.partitionBy(key).orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    firsts = both.groupBy(key, "bucket").agg(F.min(arrival).alias("first")).select(key, "bucket", F.min("first").over(beyond).alias("beyond"))
    return found.join(firsts, [key, "bucket"]).select(key, F.col("asks").alias("at"), F.coalesce("inside", "beyond").alias("next"))


def anchors(times: DataFrame, key: str, span: int) -> DataFrame:
    """key, at of the times (key, at; distinct) at which batches start: each key's first one, and from each the next one beyond the span.

    Found by pointer jumping: a time after a gap longer than the span starts a batch whatever comes before it; from these
    on, every round follows pointers of twice the length, so there are as many rounds as the number of batches
    between two gaps has binary digits, and no task reads a key from end to end.
    """
    following = stored(next_anchors(times, key, span), "next")
    # a time is after a gap if no time is within the span before it: so if it isn't the second of two that are close
    width = max(1, span)
    close = times.withColumn("bucket", F.floor(F.col("at") / width).cast("long"))
    earlier = F.lag("at").over(Window.partitionBy(key, "bucket").orderBy("at"))
    before = close.groupBy(key, (F.col("bucket") + 1).alias("bucket")).agg(F.max("at").alias("last"))
    gaps = close.withColumn("earlier", earlier).join(before, [key, "bucket"], "left")
    found = stored(gaps.where(F.coalesce(F.col("at") - F.coalesce("earlier", "last") > span, F.lit(True))).select(key, "at"), "anchors")
    steps = stored(following.where("next IS NOT NULL").join(found.withColumnRenamed("at", "next"), [key, "next"], "left_anti").select(key, "at", "next"), "steps")
    forget(following)
    while True:
        reached = stored(found.join(steps, [key, "at"]).select(key, F.col("next").alias("at")), "reached")
        if reached.isEmpty():
            forget(reached, steps)
            return found
        # two anchors never lead to one: each belongs to one chain
        wider, longer = stored(found.union(reached), "anchors"), stored(steps.join(steps.select(key, F.col("at").alias("next"), F.col("next").alias("then")), [key, "next"]).select(key, "at", F.col("then").alias("next")), "steps")
        forget(found, steps, reached)
        found, steps = wider, longer


def anchored_batches(arrivals: DataFrame, key: str, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """key, batch, run_at (last arrival), n, ids (in order of arrival) of each key's batches.

    arrivals: key, id, seen_at. A batch takes arrivals up to ``span_seconds`` after its first one, however small the gaps
    between them. Arrivals without a time are left out; null keys are a key of their own. A batch is one row, so its arrivals
    come together; nothing else does.
    """
    span = span_seconds * 1_000_000
    width = max(1, span)
    own = F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("is")))
    rows = arrivals.where("seen_at IS NOT NULL").select(F.coalesce(own, F.struct(F.lit(None).cast(dict(arrivals.dtypes)[key]).alias("is"))).alias("owner"), "id", F.col("seen_at").cast("timestamp_ntz").alias("seen_at"), F.unix_micros(F.col("seen_at").cast("timestamp")).alias("at"))
    starts = anchors(rows.select("owner", "at").distinct(), "owner", span).withColumnRenamed("at", "start")
    starts = starts.withColumn("batch", (F.row_number().over(Window.partitionBy("owner").orderBy("start")) - 1).cast("long")).withColumn("bucket", F.floor(F.col("start") / width).cast("long"))
    # anchors are further apart than a bucket is wide: an arrival's is the one of its bucket, or else of the bucket before
    here = starts.select("owner", "bucket", F.struct("start", "batch").alias("here"))
    past = starts.select("owner", (F.col("bucket") + 1).alias("bucket"), F.struct("start", "batch").alias("past"))
    placed = rows.withColumn("bucket", F.floor(F.col("at") / width).cast("long")).join(here.join(past, ["owner", "bucket"], "full_outer"), ["owner", "bucket"])
    batch = F.when(F.col("here.start") <= F.col("at"), F.col("here.batch")).otherwise(F.col("past.batch"))
    listed = placed.groupBy("owner", batch.alias("batch")).agg(F.max("seen_at").alias("run_at"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("seen_at", "id"))).alias("rows"))
    return listed.select(F.col("owner.is").alias(key), "batch", "run_at", "n", F.transform("rows", lambda x: x["id"]).alias("ids"))


def merge_batches(existing: DataFrame, inferred: DataFrame) -> DataFrame:
    """Batches (run_at, review_ids) of both; of those with the same ids, in their order, the existing one stays."""
    return existing.unionByName(inferred.join(existing.select("review_ids").distinct(), "review_ids", "left_anti"))


def append_batch(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """``existing`` and the batch, its ids de-duplicated; left out if it has no ids or the latest batch has the same set."""
    new = batch.withColumn("review_ids", F.array_distinct("review_ids")).where(F.size("review_ids") > 0)
    key = F.array_sort(F.array_distinct("review_ids"))
    latest = existing.orderBy(F.col("run_at").desc()).limit(1).select(key.alias("key"))
    return existing.unionByName(new.withColumn("key", key).join(F.broadcast(latest), "key", "left_anti").drop("key"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of largest ``order`` for each key; other columns may be of any type."""
    return rows.groupBy(key).agg(F.max_by(F.struct(order, *(c for c in rows.columns if c not in (key, order))), order).alias("r")).select(key, "r.*")


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of smallest ``order`` for each key; other columns may be of any type."""
    return rows.groupBy(*key).agg(F.min_by(F.struct(order, *(c for c in rows.columns if c != order and c not in key)), order).alias("r")).select(*key, "r.*")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: str) -> DataFrame:
    """Rows of ``new`` (one of each key), with ``keep`` from ``old`` where it has the key, and the other rows of ``old``."""
    new = new.dropDuplicates([key])
    kept = old.select(F.col(key).alias("k"), F.col(keep).alias("kept"))
    merged = new.join(kept, new[key] == kept["k"], "left").withColumn(keep, F.coalesce("kept", keep)).select(*old.columns)
    return merged.unionByName(old.join(new.select(key), key, "left_anti"))


def written(old: DataFrame, new: DataFrame, key: str, mode: str) -> DataFrame:
    """What a table holds after ``new`` was written: overwrite (new rows alone), update (new rows instead of old ones of their key)
    or append (new rows of keys that aren't there yet). Of several new rows of a key any one counts once."""
    once = new.dropDuplicates([key])
    if mode == "overwrite":
        return once
    if mode == "update":
        return once.unionByName(old.join(once.select(key), key, "left_anti"))
    if mode == "append":
        return old.unionByName(once.join(old.select(key), key, "left_anti"))
    raise ValueError(f"unknown mode {mode}")


def new_ids(wanted: DataFrame, existing: DataFrame, key: str, least: int = 0) -> DataFrame:
    """Ids from ``least`` on that don't exist yet."""
    return wanted.where(F.col(key) >= least).select(key).distinct().join(existing.select(key), key, "left_anti")


def merge_favorites(saved: DataFrame, incoming: DataFrame, known: DataFrame) -> DataFrame:
    """user_id, review_id, saved_at: insert or ignore of known reviews; the first of equal ones stays."""
    fresh = first_wins(incoming.join(known.select("review_id"), "review_id", "left_semi"), ["user_id", "review_id"], "saved_at")
    return saved.unionByName(fresh.join(saved.select("user_id", "review_id"), ["user_id", "review_id"], "left_anti"))


def remove_favorites(saved: DataFrame, gone: DataFrame) -> DataFrame:
    """``saved`` without the rows that ``gone`` (user_id, review_id) names."""
    return saved.join(gone.select("user_id", "review_id"), ["user_id", "review_id"], "left_anti")


def inserted_counts(saved: DataFrame, merged: DataFrame) -> DataFrame:
    """user_id, inserted: how many favourites a merge has added."""
    return merged.join(saved.select("user_id", "review_id"), ["user_id", "review_id"], "left_anti").groupBy("user_id").agg(F.count("*").alias("inserted"))


def listed_favorites(saved: DataFrame) -> DataFrame:
    """``saved`` with ``place``, the last saved first; equal times go by the larger id."""
    return saved.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("saved_at").desc(), F.col("review_id").desc())).cast("long"))


def next_ids(existing: DataFrame, key: str, first: int | None, last: int) -> DataFrame:
    """Ids from ``first`` to ``last`` that don't exist yet; without ``first``, those after the largest existing one."""
    spark = existing.sparkSession
    if first is None:
        first = (existing.agg(F.max(key)).first()[0] or 0) + 1
    # each id is needed once, and none outside of the range
    there = existing.select(key).where(F.col(key).between(first, last)).distinct()
    return spark.range(first, max(first, last + 1)).select(F.col("id").alias(key)).join(there, key, "left_anti")


def gap_runs(ids: DataFrame, stop_after: int) -> DataFrame:
    """first, last, missing of runs of at least ``stop_after`` missing ids between existing ones."""
    # neighbours are found within ranges of ids and across their borders, not in one task
    width = 1 << 20
    block = F.floor(F.col("id") / width)
    rows = ids.select("id").distinct().withColumn("block", block)
    edges = rows.groupBy("block").agg(F.max("id").alias("top")).select("block", F.lag("top").over(Window.orderBy("block")).alias("before"))
    previous = F.coalesce(F.lag("id").over(Window.partitionBy("block").orderBy("id")), F.col("before"))
    pairs = rows.join(edges, "block").select("id", previous.alias("previous"))
    return pairs.where(F.col("id") - F.col("previous") - 1 >= stop_after).select((F.col("previous") + 1).alias("first"), (F.col("id") - 1).alias("last"), (F.col("id") - F.col("previous") - 1).alias("missing"))
