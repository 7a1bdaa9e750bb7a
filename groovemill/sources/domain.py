"""Albums, references, communities and genres as views over the driver's tables, with the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groovemill.sources.parts import dealt, parts_of


class Tables:
    """Domain views over the tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def parts(self) -> int:
        """Partitions that steps on single references or tracks need."""
        return parts_of(self.read("lineitem"))

    def _lines(self) -> DataFrame:
        return dealt(self.read("lineitem"), self.parts(), "l_orderkey")

    def reviews(self) -> DataFrame:
        """review_id, artist, album, author, label, release_date, release_year, rating."""
        key = F.col("o_orderkey")
        return (
            self.read("orders")
            .join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .select(
                key.alias("review_id"),
                F.col("c_name").alias("artist"),
                F.concat(F.lit("Album "), key.cast("string")).alias("album"),
                F.col("c_mktsegment").alias("author"),
                F.when(key % 11 != 0, F.col("o_orderpriority")).alias("label"),
                F.col("o_orderdate").cast("date").alias("release_date"),
                F.when(key % 13 != 0, F.year("o_orderdate").cast("long")).alias("release_year"),
                F.when(key % 7 != 0, (key % 11).cast("double")).alias("rating"),
            )
        )

    def refs(self) -> DataFrame:
        """review_id, artist, pos (from 1), n_refs: each album's references in their order."""
        album = Window.partitionBy("l_orderkey")
        order = album.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        return self._lines().select(F.col("l_orderkey").alias("review_id"), _artist("l_partkey"), F.row_number().over(order).cast("long").alias("pos"), F.count("*").over(album).alias("n_refs"))

    def memberships(self) -> DataFrame:
        """artist, community: artists without a community have no row."""
        return self.read("part").where("p_size <= 45").select(_artist("p_partkey"), F.concat(F.lit("C"), F.lpad(F.substring("p_brand", 7, 99), 3, "0")).alias("community"))

    def metadata(self) -> DataFrame:
        """review_id, artist, mbid, genres: the types of the parts that an album refers to, sorted; empty for each third album."""
        lines = self.read("lineitem").join(self.read("part"), F.col("l_partkey") == F.col("p_partkey"))
        genres = lines.groupBy(F.col("l_orderkey").alias("review_id")).agg(F.array_sort(F.collect_set(F.lower("p_type"))).alias("g"))
        orders = self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        key = F.col("o_orderkey")
        albums = orders.select(key.alias("review_id"), F.col("c_name").alias("artist"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("mb"), F.col("o_custkey").cast("string"))).alias("mbid"))
        return albums.join(genres, "review_id", "left").select("review_id", "artist", "mbid", F.when(F.col("review_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.coalesce("g", F.array().cast("array<string>"))).alias("genres"))

    def tracks(self) -> DataFrame:
        """review_id, number, title, is_highlight."""
        album = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        numbered = self._lines().withColumn("number", F.row_number().over(album).cast("long"))
        return numbered.join(self.read("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("review_id"), "number", F.concat_ws(" ", "p_name", F.col("l_linenumber").cast("string")).alias("title"), (F.col("l_returnflag") == "R").alias("is_highlight"))


def _artist(key: str):
    return F.concat(F.lit("Customer#"), F.lpad(F.col(key).cast("string"), 9, "0")).alias("artist")


#: The same views for DuckDB, to stand in a WITH clause.
SQL = {
    "reviews": """reviews AS (SELECT o_orderkey AS review_id, c_name AS artist, 'Album ' || o_orderkey AS album, c_mktsegment AS author,
        CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS label, CAST(o_orderdate AS DATE) AS release_date,
        CASE WHEN o_orderkey % 13 <> 0 THEN year(o_orderdate) END AS release_year,
        CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 11 AS DOUBLE) END AS rating
        FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "refs": """refs AS (SELECT l_orderkey AS review_id, 'Customer#' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS artist,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos,
        count(*) OVER (PARTITION BY l_orderkey) AS n_refs FROM lineitem)""",
    "memberships": """memberships AS (SELECT 'Customer#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS artist,
        'C' || lpad(substr(p_brand, 7), 3, '0') AS community FROM part WHERE p_size <= 45)""",
    "metadata": """metadata AS (SELECT o_orderkey AS review_id, c_name AS artist, CASE WHEN o_custkey % 2 = 0 THEN 'mb' || o_custkey END AS mbid,
        CASE WHEN o_orderkey % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE coalesce(g, CAST([] AS VARCHAR[])) END AS genres
        FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, list_sort(list(DISTINCT lower(p_type))) AS g
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON l_orderkey = o_orderkey)""",
    "tracks": """tracks AS (SELECT l_orderkey AS review_id, number, p_name || ' ' || l_linenumber AS title, l_returnflag = 'R' AS is_highlight
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS number FROM lineitem)
        JOIN part ON l_partkey = p_partkey)""",
    "weighted": """weighted AS (SELECT *, CASE WHEN n_refs <= 0 THEN 0.2::DOUBLE WHEN n_refs = 1 THEN 1::DOUBLE
        ELSE 0.2::DOUBLE + 0.8::DOUBLE * (n_refs - pos) / (n_refs - 1) END AS w FROM refs)""",
    "affinities": """masses AS (SELECT review_id, community, sum(w) AS mass FROM weighted JOIN memberships USING (artist) GROUP BY 1, 2),
        affinities AS (SELECT review_id, community, mass / sum(mass) OVER (PARTITION BY review_id) AS share FROM masses)""",
    "edges": """firsts AS (SELECT review_id, artist AS dst, min(pos) AS pos, max(n_refs) AS n_refs FROM refs GROUP BY 1, 2),
        albums AS (SELECT artist, count(*) AS n_albums FROM reviews GROUP BY 1),
        edges AS (SELECT r.artist AS src, dst, sum(CASE WHEN n_refs = 1 THEN 1::DOUBLE ELSE 0.2::DOUBLE + 0.8::DOUBLE * (n_refs - pos) / (n_refs - 1) END) / max(n_albums) AS weight
        FROM firsts JOIN reviews r USING (review_id) JOIN albums a ON a.artist = r.artist GROUP BY 1, 2)""",
}


def with_views(*names: str) -> str:
    """A WITH clause of the named views and of those that they need."""
    needs = {"weighted": ("refs",), "affinities": ("refs", "weighted", "memberships"), "edges": ("reviews", "refs")}
    order: list[str] = []

    def add(name: str) -> None:
        for other in needs.get(name, ()):
            add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in order)
