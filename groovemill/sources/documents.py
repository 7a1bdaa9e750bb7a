"""Domain documents as JSON: memberships, affinities, communities, labels, categories, artist profiles, image records and reports.

Entities of unbounded number are lines, one for each; communities, labels and categories are one object each, as there are
only as many communities as a person can look through.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groovemill.operators.batches import last_wins
from groovemill.sources.jsonl import read_jsonl, read_keyed, valid

MEMBERSHIP = "artist_id string, artist string, communities map<string,string>"
AFFINITY = "review_id long, communities map<string,array<struct<id:string,score:double>>>"
COMMUNITIES = "resolution double, communities array<struct<id:string,centroid:string,size:long,top_artists:array<string>>>"
LABELS = "labels array<struct<community_id:string,genre_label:string>>"
CATEGORIES = "broad_categories array<string>, mappings array<struct<community_id:string,broad_categories:array<string>>>"
PROFILE = "artist_mbid string, artist_name string, total_albums long, genre_counts map<string,long>, main_genres array<string>"
METADATA = "review_id long, artist string, artist_mbid string, genres array<string>"
IMAGE = "artist_mbid string, artist_name string, status string, fetched_at timestamp"


def res_key(resolution: float) -> str:
    """``res_10``, ``res_1.5``: the name of a resolution in rows; files have ``_`` for the dot."""
    return f"res_{resolution:g}"


def res_file(resolution: float) -> str:
    return f"communities_{res_key(resolution).replace('.', '_')}.json"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder."""
    try:
        spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def read_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row of the fields of a file that is one JSON object; no rows if it is missing or can't be read."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("o")).where("o IS NOT NULL").select("o.*")


def write_object(row: DataFrame, path: str) -> None:
    """Writes a frame of one row as one JSON object."""
    row.coalesce(1).write.mode("overwrite").json(path)


def read_memberships(spark: SparkSession, path: str, key: str = "res_10") -> DataFrame:
    """artist, community of the artists that have one at a resolution."""
    rows = valid(read_jsonl(spark, path, MEMBERSHIP)).where("artist_id IS NOT NULL")
    return rows.select(F.col("artist_id").alias("artist"), F.try_element_at("communities", F.lit(key)).alias("community")).where("community IS NOT NULL")


def write_memberships(memberships: DataFrame, path: str, key: str = "res_10") -> None:
    """Memberships (artist, community) as lines, sorted by artist."""
    rows = memberships.select(F.col("artist").alias("artist_id"), "artist", F.create_map(F.lit(key), F.col("community")).alias("communities"))
    rows.orderBy("artist_id").write.mode("overwrite").json(path)


def read_affinities(spark: SparkSession, path: str, key: str = "res_10") -> DataFrame:
    """review_id, community, share: the entries of a resolution with a score above 0, of the last row of each review."""
    rows = read_keyed(spark, path, AFFINITY, "review_id")
    entries = rows.select("review_id", F.explode(F.try_element_at("communities", F.lit(key))).alias("e"))
    return entries.select("review_id", F.col("e.id").alias("community"), F.col("e.score").alias("share")).where("community IS NOT NULL AND share > 0")


def write_affinities(affinities: DataFrame, path: str, key: str = "res_10") -> None:
    """Affinities (review_id, community, share) as lines, the largest share first."""
    entries = F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("o"), F.col("community").alias("id"), F.col("share").alias("score"))))
    rows = affinities.groupBy("review_id").agg(F.transform(entries, lambda e: F.struct(e["id"].alias("id"), e["score"].alias("score"))).alias("c"))
    rows.select("review_id", F.create_map(F.lit(key), F.col("c")).alias("communities")).write.mode("overwrite").json(path)


def read_communities(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """community, centroid, size, top_artists, resolution. strict: a missing or unreadable document is an error, else it has no rows."""
    found = read_object(spark, path, COMMUNITIES)
    if strict and found.where("communities IS NOT NULL").isEmpty():
        raise ValueError(f"{path} has no array of communities")
    return found.select("resolution", F.explode("communities").alias("c")).where("coalesce(c.id, '') <> ''").select(F.col("c.id").alias("community"), "c.centroid", "c.size", "c.top_artists", "resolution")


def write_communities(communities: DataFrame, path: str, resolution: float) -> None:
    """Communities (community, centroid, size, top_artists) as one object, sorted by id."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("community").alias("id"), "centroid", "size", "top_artists")))
    write_object(communities.agg(listed.alias("communities")).select(F.lit(float(resolution)).alias("resolution"), "communities"), path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """community, label of the communities that have one."""
    rows = read_object(spark, path, LABELS).select(F.explode("labels").alias("l"))
    return rows.select(F.col("l.community_id").alias("community"), F.col("l.genre_label").alias("label")).where("community IS NOT NULL AND coalesce(label, '') <> ''")


def write_labels(labels: DataFrame, path: str) -> None:
    write_object(labels.agg(F.array_sort(F.collect_list(F.struct(F.col("community").alias("community_id"), F.col("label").alias("genre_label")))).alias("labels")), path)


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """community, category of each mapping."""
    rows = read_object(spark, path, CATEGORIES).select(F.explode("mappings").alias("m"))
    return rows.select(F.col("m.community_id").alias("community"), F.explode("m.broad_categories").alias("category")).where("community IS NOT NULL")


def write_categories(categories: DataFrame, path: str) -> None:
    names = categories.agg(F.array_sort(F.collect_set("category")).alias("broad_categories"))
    mapped = categories.groupBy("community").agg(F.array_sort(F.collect_set("category")).alias("broad_categories"))
    mappings = mapped.agg(F.array_sort(F.collect_list(F.struct(F.col("community").alias("community_id"), "broad_categories"))).alias("mappings"))
    write_object(names.crossJoin(mappings), path)  # one row each


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """artist_key and the fields of a profile, of lines with artist_key or of one object with a profile for each key."""
    lines = valid(read_jsonl(spark, path, f"artist_key string, {PROFILE}")).drop("seq").where("artist_key IS NOT NULL")
    if not lines.isEmpty():
        return lines
    fields = T.StructType.fromDDL(PROFILE)
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("artist_key", T.StringType()), *fields]))
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", T.MapType(T.StringType(), fields)).alias("profiles"))
    return whole.select(F.explode("profiles").alias("artist_key", "p")).where("p IS NOT NULL").select("artist_key", "p.*")


def write_profiles(profiles: DataFrame, path: str) -> None:
    """Profiles (artist_key, total_albums, main_genres, ...) as lines, sorted by key."""
    profiles.orderBy("artist_key").write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, imputed: str, raw: str) -> DataFrame:
    """The last row of each review, of the imputed file if there is one, else of the raw one."""
    return read_keyed(spark, imputed if exists(spark, imputed) else raw, METADATA, "review_id")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each artist with an mbid."""
    return read_keyed(spark, path, IMAGE, "artist_mbid").where("artist_mbid <> ''")


def upsert_images(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records of both, the new ones instead of old ones of the same mbid, sorted by name and mbid. new: its last row counts, by fetched_at."""
    fresh = last_wins(new, "artist_mbid", "fetched_at").select(*old.columns)
    return fresh.unionByName(old.join(fresh, "artist_mbid", "left_anti")).orderBy(F.lower("artist_name"), "artist_mbid")


def write_report(findings: DataFrame, path: str, config: dict[str, str]) -> None:
    """A health report as one object: the numbers of errors and warnings, the settings and the findings (code, severity, n), sorted."""
    severe = lambda s: F.count_if(F.col("severity") == s)
    row = findings.agg(F.struct(severe("error").alias("error_count"), severe("warning").alias("warning_count")).alias("summary"), F.array_sort(F.collect_list(F.struct("code", "severity", "n"))).alias("findings"))
    write_object(row.select("summary", F.create_map(*(F.lit(x) for pair in sorted(config.items()) for x in pair)).alias("config"), "findings"), path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """code, severity, n, error_count, warning_count of a report's findings."""
    found = read_object(spark, path, "summary struct<error_count:long,warning_count:long>, findings array<struct<code:string,severity:string,n:long>>")
    return found.select("summary.*", F.explode("findings").alias("f")).select("f.*", "error_count", "warning_count")

