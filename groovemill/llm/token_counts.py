"""Operator 6: token counts for every context limit from one exact histogram of encoded lengths.

Documents are aggregated by their encoded length; suffix sums over the histogram then answer every limit at once. The
histogram has a row for each length that occurs, so its size follows the longest document, not their number; its
suffix sums are taken within blocks of lengths and over the blocks' totals, so that no task gets all of it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored
from .subwords import count_rows, rank_encoder
from .text import slices, text_bytes

#: Lengths in a block, which is the most that a task's window holds.
BLOCK = 64


def encoded_lengths(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and n_tokens of each row's whole ``text``; a null or empty text has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_encoder(ranks_path, pattern)
        for batch in slices(batches):
            counts = count_rows(*text_bytes(batch.column(1)), encode)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """For each ``n_tokens`` that occurs, read as a context limit: what lies below, at and above it.

    n_docs has this length; docs_up_to and tokens_up_to cover this length and shorter ones; docs_longer and
    tokens_longer the longer ones; truncated_total is the sum of min(length, n_tokens) over all documents and
    lost_tokens what it cuts off; quantile is docs_up_to over all documents. No rows give no rows; repeated rows count
    as often as they occur.

    limits: n_tokens of further limits, from 0 on; those between the lengths that occur get rows with an n_docs of 0.
    Null, negative and repeated limits add nothing. The histogram is written once to the shared folder.
    """
    hist = stored(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths")
    whole = hist.agg(F.sum("n_docs").alias("all_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("all_tokens"))
    rows = hist
    if limits is not None:
        asked = limits.select(F.col("n_tokens").cast("long")).where("n_tokens >= 0").distinct()
        rows = hist.union(asked.join(hist, "n_tokens", "left_anti").withColumn("n_docs", F.lit(0).cast("long")))
    rows = rows.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    docs, tokens = F.sum("n_docs"), F.sum(F.col("n_docs") * F.col("n_tokens"))
    longer = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = rows.groupBy("block").agg(docs.alias("d"), tokens.alias("t")).select(
        "block", F.coalesce(F.sum("d").over(longer), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("t").over(longer), F.lit(0)).alias("tokens_after")
    )
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    inside = lambda x: F.coalesce(x.over(within), F.lit(0))
    suffixes = rows.join(after, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_after") + inside(docs)).alias("docs_longer"),
        (F.col("tokens_after") + inside(tokens)).alias("tokens_longer"),
    )
    up_to = F.col("all_tokens") - F.col("tokens_longer")
    truncated = up_to + F.col("docs_longer") * F.col("n_tokens")
    return suffixes.join(F.broadcast(whole), F.col("all_docs") > 0).select(  # whole has one row
        "n_tokens",
        "n_docs",
        (F.col("all_docs") - F.col("docs_longer")).alias("docs_up_to"),
        up_to.alias("tokens_up_to"),
        "docs_longer",
        "tokens_longer",
        truncated.alias("truncated_total"),
        (F.col("all_tokens") - truncated).alias("lost_tokens"),
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("quantile"),
    )


def quantile_lengths(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """share, n_tokens: the least length that at least this share of the documents doesn't exceed; null without documents."""
    least = histogram.where("n_docs > 0").agg(*(F.min(F.when(F.col("quantile") >= s, F.col("n_tokens"))).alias(f"s{i}") for i, s in enumerate(shares)))
    return least.select(F.inline(F.array(*(F.struct(F.lit(float(s)).alias("share"), F.col(f"s{i}").alias("n_tokens")) for i, s in enumerate(shares)))))
