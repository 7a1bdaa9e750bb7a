"""Genres of albums from tags, artists' genre profiles, and genres of untagged albums from either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groovemill.functions.tags import genres_of, tag_token


def genres_from_tags(tags: DataFrame) -> DataFrame:
    """review_id and its sorted genres, from ``tags`` (review_id, tag).

    Each distinct tag is matched once; every album with tags has a row, also if none is a style.
    """
    known = tags.select("tag").distinct().select("tag", genres_of(tag_token(F.col("tag"))).alias("g"))
    return tags.join(known, "tag").select("review_id", F.explode_outer("g").alias("genre")).groupBy("review_id").agg(F.array_sort(F.collect_set("genre")).alias("genres"))


def artist_key(mbid: Column, artist: Column) -> Column:
    return F.when(F.coalesce(mbid, F.lit("")) != "", F.concat(F.lit("mbid:"), mbid)).otherwise(F.concat(F.lit("name:"), artist))


def genre_counts(metadata: DataFrame) -> DataFrame:
    """artist_key, genre, n of albums with genres; rows with a blank artist don't count."""
    rows = metadata.where("trim(artist) <> ''").select(artist_key(F.col("mbid"), F.col("artist")).alias("artist_key"), F.explode("genres").alias("genre"))
    return rows.groupBy("artist_key", "genre").agg(F.count("*").alias("n"))


def main_genres(counts: DataFrame, key: str, least_share: float = 0.15, top_k: int = 3) -> DataFrame:
    """key, genre, n, share, place of each key's main genres: those of at least ``least_share``; only if there is none, the
    ``top_k`` most frequent. Equal counts go by name."""
    own = Window.partitionBy(key)
    order = own.orderBy(F.col("n").desc(), "genre")
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(own)).withColumn("place", F.row_number().over(order).cast("long"))
    any_main = F.max("share").over(own) >= least_share
    return shares.withColumn("any", any_main).where((F.col("any") & (F.col("share") >= least_share)) | (~F.col("any") & (F.col("place") <= top_k))).drop("any")


def artist_profiles(metadata: DataFrame, least_albums: int = 1) -> DataFrame:
    """artist_key, total_albums, main_genres (array, most frequent first) of artists with genres and enough albums."""
    albums = metadata.where("trim(artist) <> ''").groupBy(artist_key(F.col("mbid"), F.col("artist")).alias("artist_key")).agg(F.countDistinct("review_id").alias("total_albums"))
    main = main_genres(genre_counts(metadata), "artist_key").groupBy("artist_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "genre"))), lambda x: x["genre"]).alias("main_genres"))
    return albums.where(F.col("total_albums") >= least_albums).join(main, "artist_key")


def impute_from_artist(metadata: DataFrame, profiles: DataFrame) -> DataFrame:
    """``metadata`` with empty genres filled from the artist's profile; ``from_artist`` tells where."""
    joined = metadata.withColumn("artist_key", artist_key(F.col("mbid"), F.col("artist"))).join(profiles.select("artist_key", "main_genres"), "artist_key", "left")
    fill = (F.size("genres") == 0) & F.col("main_genres").isNotNull()
    return joined.select("review_id", "artist", "mbid", F.when(fill, F.col("main_genres")).otherwise(F.col("genres")).alias("genres"), fill.alias("from_artist"))


def impute_from_refs(metadata: DataFrame, refs: DataFrame, counts: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """review_id, genre, place: main genres of albums without genres, from the first ``most`` references with a profile.

    counts: artist_key, genre, n. names: artist, artist_key; a key with an mbid goes before one by name, the last mbid
    first. A reference with no profile doesn't use up a place.
    """
    best = names.groupBy("artist").agg(F.coalesce(F.max(F.when(F.col("artist_key").startswith("mbid:"), F.col("artist_key"))), F.min("artist_key")).alias("artist_key"))
    usable = best.join(counts.select("artist_key").distinct(), "artist_key")
    empty = metadata.where(F.size("genres") == 0).select("review_id")
    order = Window.partitionBy("review_id").orderBy("pos")
    used = refs.join(empty, "review_id", "left_semi").join(usable, "artist").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    summed = used.join(counts, "artist_key").groupBy("review_id", "genre").agg(F.sum("n").alias("n"))
    return main_genres(summed, "review_id").select("review_id", "genre", "place")
