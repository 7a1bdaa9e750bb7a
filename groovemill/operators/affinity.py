"""How much of an album's references belongs to each artist community."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groovemill.functions.numbers import position_weight
from groovemill.functions.text import name_key


def weighted_refs(refs: DataFrame) -> DataFrame:
    """``refs`` with ``w``, the weight of each reference's position among all of its album's."""
    return refs.withColumn("w", position_weight(F.col("pos"), F.col("n_refs")))


def community_masses(refs: DataFrame, memberships: DataFrame) -> DataFrame:
    """review_id, community, mass: every occurrence counts; references without a community only take their positions."""
    left = weighted_refs(refs).withColumn("key", name_key(F.col("artist")))
    right = memberships.select(name_key(F.col("artist")).alias("key"), "community")
    return left.join(right, "key").groupBy("review_id", "community").agg(F.sum("w").alias("mass"))


def album_affinities(masses: DataFrame, threshold: float = 0.0, top_k: int | None = None) -> DataFrame:
    """review_id, community, share of the album's mass; then shares of at least ``threshold`` and the ``top_k`` largest."""
    album = Window.partitionBy("review_id")
    shares = masses.withColumn("share", F.col("mass") / F.sum("mass").over(album)).drop("mass")
    if threshold > 0:
        shares = shares.where(F.col("share") >= threshold)
    return top_communities(shares, top_k).drop("place") if top_k else shares


def top_communities(affinities: DataFrame, k: int) -> DataFrame:
    """The k communities of largest share of each album, with their place."""
    order = Window.partitionBy("review_id").orderBy(F.round("share", 9).desc(), "community")
    return affinities.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)


def community_tags(affinities: DataFrame, selected: DataFrame, least: float = 0.1) -> DataFrame:
    """Shares of at least ``least`` with their place, also of communities that aren't selected; ``matched`` tells which are."""
    marked = affinities.where(F.round("share", 9) >= least).join(F.broadcast(selected.select("community", F.lit(True).alias("m"))), "community", "left")
    order = Window.partitionBy("review_id").orderBy(F.round("share", 9).desc(), "community")
    return marked.select("review_id", "community", "share", F.coalesce("m", F.lit(False)).alias("matched"), F.row_number().over(order).cast("long").alias("place"))
