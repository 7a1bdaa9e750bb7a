"""Queries on references, affinities and the artist graph."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from groovemill.functions.numbers import position_weight
from groovemill.operators import affinity, communities, genres, graph
from groovemill.sources import graph_files
from groovemill.sources.checkpoints import checkpointed, shared_folder
from groovemill.sources.domain import Tables, with_views

#: How far distances go.
CUTOFF = 10


def _r(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


def _affinities(t: Tables):
    return affinity.album_affinities(affinity.community_masses(t.refs(), t.memberships()))


def _edges(t: Tables):
    return graph.artist_edges(t.reviews(), t.refs(), t.parts())


def position_weights(spark, sf_dir):
    refs = Tables(spark, sf_dir).refs()
    return refs.select("review_id", "artist", "pos", F.round(position_weight(F.col("pos"), F.col("n_refs")), 9).alias("w"))


def album_affinities(spark, sf_dir):
    return _affinities(Tables(spark, sf_dir)).select("review_id", "community", *_r("share"))


def top_communities(spark, sf_dir):
    return affinity.top_communities(_affinities(Tables(spark, sf_dir)), 2).select("review_id", "community", "place", *_r("share"))


def artist_edges(spark, sf_dir):
    return _edges(Tables(spark, sf_dir)).select("src", "dst", *_r("weight"))


def undirected_edges(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.undirected_edges(_edges(t), t.parts()).select("a", "b", *_r("weight"))


def weighted_degree_centroid(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.community_centroids(graph.weighted_degrees(_edges(t)), t.memberships(), 3).select("community", "place", "artist", *_r("degree"))


def artist_attribute_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.attribute_counts(t.reviews(), t.metadata().select("review_id", "genres"))


def attribute_purity(spark, sf_dir):
    t = Tables(spark, sf_dir)
    counts = graph.attribute_counts(t.reviews(), t.metadata().select("review_id", "genres"))
    return graph.attribute_purity(counts, t.memberships()).select("kind", *_r("purity", "coverage"))


def cluster_quality(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.cluster_quality(_edges(t), t.memberships(), 1.0).select("num_communities", "num_nodes", "num_edges", "min_size", "max_size", *_r("modularity", "avg_size", "internal_weight", "external_weight", "internal_share", "external_share"))


def cross_community_neighbors(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.top_neighbours(graph.cross_community_edges(_edges(t), t.memberships())).select("community", "neighbour", "place", *_r("weight"))


def label_propagation(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.propagate_labels(_edges(t), t.memberships(), t.parts())


def _centroids(t: Tables, edges):
    return checkpointed(graph.community_centroids(graph.weighted_degrees(edges), t.memberships(), 1).select("community", "artist"))


def bfs_distances(spark, sf_dir):
    t = Tables(spark, sf_dir)
    edges = checkpointed(_edges(t))
    return graph.hop_distances(edges, _centroids(t, edges).select("artist"), CUTOFF)


def community_distances(spark, sf_dir):
    t = Tables(spark, sf_dir)
    edges = checkpointed(_edges(t))
    found = graph.community_distances(edges, _centroids(t, edges).select("artist"), t.memberships(), CUTOFF)
    return found.select("source", "community", "min_hops", *_r("mean_hops"))


def community_distance_matrix(spark, sf_dir):
    t = Tables(spark, sf_dir)
    edges = checkpointed(_edges(t))
    centroids = _centroids(t, edges)
    ends = centroids.select("artist")
    return graph.community_matrix(graph.hop_distances(edges, ends, CUTOFF, ends), centroids)


def modular_communities(spark, sf_dir):
    """Gains up to a thousandth of an artist's degree don't count: the tables' references are made by chance, and smaller ones go back and forth one by one."""
    return communities.modular_communities(_edges(Tables(spark, sf_dir)), least=0.001)


def purity_summary(spark, sf_dir):
    return graph.combined_purity(attribute_purity(spark, sf_dir)).select(F.round("combined_purity", 5).alias("combined_purity"))


def community_map(spark, sf_dir):
    """Nodes with their sizes, neighbours and places on a circle."""
    t = Tables(spark, sf_dir)
    edges = checkpointed(_edges(t))
    near = graph.top_neighbours(graph.cross_community_edges(edges, t.memberships()))
    listed = near.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "neighbour"))), lambda x: x["neighbour"]), ",").alias("neighbours"))
    sizes = t.memberships().groupBy("community").agg(F.count("*").alias("size"))
    return graph.circular_layout(sizes.join(listed, "community", "left")).select("community", "size", F.coalesce("neighbours", F.lit("")).alias("neighbours"), *_r("x", "y"))


def incremental_export(spark, sf_dir):
    """Memberships of which each fourth is new, updated and described."""
    t = Tables(spark, sf_dir)
    edges = checkpointed(_edges(t))
    now = checkpointed(graph.updated_memberships(edges, t.memberships().where("cast(right(artist, 9) as int) % 4 <> 0"), t.parts()))
    return graph.described_communities(edges, now, 3).select("community", "centroid", "size", F.array_join("top_artists", ",").alias("top_artists"))


def graph_document(spark, sf_dir):
    """Edges written as GraphML, whose weights are text, and read again."""
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    graph_files.write_edges(_edges(Tables(spark, sf_dir)), path)
    return graph_files.read_edges(spark, path).select("src", "dst", *_r("weight"))


def artist_genre_profiles(spark, sf_dir):
    found = genres.artist_profiles(Tables(spark, sf_dir).metadata())
    return found.select("artist_key", "total_albums", F.array_join("main_genres", ",").alias("main_genres"))


def impute_same_artist(spark, sf_dir):
    metadata = Tables(spark, sf_dir).metadata()
    return genres.impute_from_artist(metadata, genres.artist_profiles(metadata)).select("review_id", F.array_join("genres", ",").alias("genres"), "from_artist")


def impute_from_references(spark, sf_dir):
    t = Tables(spark, sf_dir)
    metadata = t.metadata()
    names = metadata.select("artist", genres.artist_key(F.col("mbid"), F.col("artist")).alias("artist_key")).distinct()
    return genres.impute_from_refs(metadata, t.refs(), genres.genre_counts(metadata), names)


_KEY = "CASE WHEN coalesce(mbid, '') <> '' THEN 'mbid:' || mbid ELSE 'name:' || artist END"
_COUNTS = f"counts AS (SELECT artist_key, genre, count(*) AS n FROM (SELECT {_KEY} AS artist_key, unnest(genres) AS genre FROM metadata) GROUP BY 1, 2)"


def _main(source: str, key: str) -> str:
    return f"""SELECT {key}, genre, n, place FROM (SELECT *, max(share) OVER (PARTITION BY {key}) >= 0.15 AS has_main FROM (
        SELECT *, n / sum(n) OVER (PARTITION BY {key}) AS share, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, genre) AS place FROM {source}))
        WHERE CASE WHEN has_main THEN share >= 0.15 ELSE place <= 3 END"""


_PROFILES = f"{_COUNTS}, main AS ({_main('counts', 'artist_key')}), profiles AS (SELECT artist_key, string_agg(genre, ',' ORDER BY place) AS main_genres FROM main GROUP BY 1)"
_ATTRIBUTES = """attributes AS (SELECT artist, kind, value, count(*) AS n FROM (
    SELECT artist, 'author' AS kind, author AS value FROM reviews
    UNION ALL SELECT artist, 'years', CAST(y // 5 * 5 AS VARCHAR) || '-' || CAST(y // 5 * 5 + 4 AS VARCHAR) FROM (SELECT artist, coalesce(release_year, year(release_date)) AS y FROM reviews)
    UNION ALL SELECT artist, 'label', label FROM reviews
    UNION ALL SELECT artist, 'genre', unnest(genres) FROM metadata) WHERE value IS NOT NULL GROUP BY 1, 2, 3)"""
_PLACED = """placed AS (SELECT e.*, a.community AS sc, b.community AS dc FROM edges e JOIN memberships a ON a.artist = src JOIN memberships b ON b.artist = dst)"""
_DEGREES = "degrees AS (SELECT artist, sum(weight) AS degree FROM (SELECT src AS artist, weight FROM edges UNION ALL SELECT dst, weight FROM edges) GROUP BY 1)"


#: A keyed recursion sees only the rows of the round before, and all rows as ``recurring``; it ends when a round adds none.
_PROPAGATED = """labelled(artist, community) USING KEY (artist) AS (SELECT artist, community FROM memberships
    UNION SELECT src, community FROM (SELECT src, community, row_number() OVER (PARTITION BY src ORDER BY w DESC, community DESC) AS k FROM (
    SELECT src, l.community, round(sum(weight), 9) AS w FROM edges JOIN labelled l ON l.artist = dst WHERE src NOT IN (SELECT artist FROM recurring.labelled) GROUP BY 1, 2)) WHERE k = 1)"""
_EXPORT = _PROPAGATED.replace("FROM memberships", "FROM memberships WHERE CAST(right(artist, 9) AS INT) % 4 <> 0")
_BFS = f"""{_DEGREES}, centroids AS (SELECT community, artist FROM (SELECT community, artist, row_number() OVER (PARTITION BY community ORDER BY round(coalesce(degree, 0), 9) DESC, artist) AS place
    FROM memberships LEFT JOIN degrees USING (artist)) WHERE place = 1),
    both_ways AS (SELECT DISTINCT * FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) WHERE src <> dst),
    hops(source, artist, hops) USING KEY (source, artist) AS (SELECT DISTINCT artist, artist, 0::BIGINT FROM centroids UNION SELECT DISTINCT h.source, b.dst, h.hops + 1 FROM hops h JOIN both_ways b ON b.src = h.artist
    WHERE h.hops < {CUTOFF} AND NOT EXISTS (SELECT 1 FROM recurring.hops r WHERE r.source = h.source AND r.artist = b.dst))"""

SQL = {
    "position_weights": f"{with_views('weighted')} SELECT review_id, artist, pos, round(w, 9) AS w FROM weighted",
    "album_affinities": f"{with_views('affinities')} SELECT review_id, community, round(share, 6) AS share FROM affinities",
    "top_communities": f"{with_views('affinities')} SELECT review_id, community, place, round(share, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY round(share, 9) DESC, community) AS place FROM affinities) WHERE place <= 2",
    "artist_edges": f"{with_views('edges')} SELECT src, dst, round(weight, 6) AS weight FROM edges",
    "undirected_edges": f"{with_views('edges')} SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(sum(weight), 6) AS weight FROM edges GROUP BY 1, 2",
    "weighted_degree_centroid": f"""{with_views("edges", "memberships")}, {_DEGREES} SELECT community, place, artist, round(degree, 6) AS degree FROM (
        SELECT community, artist, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY community ORDER BY round(coalesce(degree, 0), 9) DESC, artist) AS place FROM memberships LEFT JOIN degrees USING (artist)) WHERE place <= 3""",
    "artist_attribute_counts": f"{with_views('reviews', 'metadata')}, {_ATTRIBUTES} SELECT * FROM attributes",
    "attribute_purity": f"""{with_views("reviews", "metadata", "memberships")}, {_ATTRIBUTES}, j AS (SELECT * FROM memberships JOIN attributes USING (artist)),
        v AS (SELECT kind, community, value, sum(n) AS n FROM j GROUP BY 1, 2, 3), c AS (SELECT kind, community, max(n) AS top, sum(n) AS n FROM v GROUP BY 1, 2),
        p AS (SELECT kind, sum(top) / sum(n) AS purity FROM c GROUP BY 1), q AS (SELECT kind, count(DISTINCT artist) AS covered FROM j GROUP BY 1)
        SELECT kind, round(purity, 6) AS purity, round(covered / (SELECT count(*) FROM memberships), 6) AS coverage FROM p JOIN q USING (kind)""",
    "cluster_quality": f"""{with_views("edges", "memberships")}, {_PLACED}, m AS (SELECT sum(weight) AS m, count(*) AS num_edges FROM placed),
        i AS (SELECT sc AS community, sum(weight) AS inside FROM placed WHERE sc = dc GROUP BY 1),
        d AS (SELECT community, sum(weight) AS degree FROM (SELECT sc AS community, weight FROM placed UNION ALL SELECT dc, weight FROM placed) GROUP BY 1),
        q AS (SELECT sum(coalesce(inside, 0) / m - (degree / (2 * m)) ** 2) AS modularity, sum(coalesce(inside, 0)) AS internal_weight FROM d LEFT JOIN i USING (community), m),
        s AS (SELECT count(*) AS num_communities, sum(n)::BIGINT AS num_nodes, avg(n) AS avg_size, min(n) AS min_size, max(n) AS max_size FROM (SELECT count(*) AS n FROM memberships GROUP BY community))
        SELECT num_communities, num_nodes, num_edges, min_size, max_size, round(modularity, 6) AS modularity, round(avg_size, 6) AS avg_size, round(internal_weight, 6) AS internal_weight,
        round(m - internal_weight, 6) AS external_weight, round(internal_weight / m, 6) AS internal_share, round((m - internal_weight) / m, 6) AS external_share FROM q, m, s""",
    "cross_community_neighbors": f"""{with_views("edges", "memberships")}, {_PLACED}, x AS (SELECT community, neighbour, sum(weight) AS weight FROM (
        SELECT sc AS community, dc AS neighbour, weight FROM placed WHERE sc <> dc UNION ALL SELECT dc, sc, weight FROM placed WHERE sc <> dc) GROUP BY 1, 2)
        SELECT community, neighbour, place, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY round(weight, 9) DESC, neighbour) AS place FROM x) WHERE place <= 6""",
    "label_propagation": f"{with_views('edges', 'memberships')}, {_PROPAGATED} SELECT artist, community FROM labelled",
    "bfs_distances": f"{with_views('edges', 'memberships')}, {_BFS} SELECT * FROM hops",
    "community_distances": f"{with_views('edges', 'memberships')}, {_BFS} SELECT source, community, min(hops) AS min_hops, round(avg(hops), 6) AS mean_hops FROM hops JOIN memberships USING (artist) GROUP BY 1, 2",
    "community_distance_matrix": f"{with_views('edges', 'memberships')}, {_BFS} SELECT a.community, b.community AS neighbour, hops FROM centroids a, centroids b LEFT JOIN hops ON source = a.artist AND hops.artist = b.artist",
    "purity_summary": f"""{with_views("reviews", "metadata", "memberships")}, {_ATTRIBUTES}, j AS (SELECT * FROM memberships JOIN attributes USING (artist)), v AS (SELECT kind, community, value, sum(n) AS n FROM j GROUP BY 1, 2, 3),
        c AS (SELECT kind, community, max(n) AS top, sum(n) AS n FROM v GROUP BY 1, 2), p AS (SELECT kind, round(sum(top) / sum(n), 6) AS purity FROM c GROUP BY 1) SELECT round(avg(purity), 5) AS combined_purity FROM p""",
    "community_map": f"""{with_views("edges", "memberships")}, {_PLACED}, x AS (SELECT community, neighbour, sum(weight) AS weight FROM (SELECT sc AS community, dc AS neighbour, weight FROM placed WHERE sc <> dc UNION ALL SELECT dc, sc, weight FROM placed WHERE sc <> dc) GROUP BY 1, 2),
        t AS (SELECT community, neighbour, row_number() OVER (PARTITION BY community ORDER BY round(weight, 9) DESC, neighbour) AS place FROM x), l AS (SELECT community, string_agg(neighbour, ',' ORDER BY place) AS neighbours FROM t WHERE place <= 6 GROUP BY 1),
        s AS (SELECT community, count(*) AS size, 2 * pi() * (row_number() OVER (ORDER BY community) - 1) / count(*) OVER () AS a FROM memberships GROUP BY 1), p AS (SELECT community, size, cos(a) AS px, sin(a) AS py FROM s)
        SELECT community, size, coalesce(neighbours, '') AS neighbours, round(0.08 + 0.84 * (px - min(px) OVER ()) / (max(px) OVER () - min(px) OVER ()), 6) AS x, round(0.08 + 0.84 * (py - min(py) OVER ()) / (max(py) OVER () - min(py) OVER ()), 6) AS y FROM p LEFT JOIN l USING (community)""",
    "incremental_export": f"""{with_views("edges", "memberships")}, {_EXPORT}, {_DEGREES}, own AS (SELECT * FROM labelled WHERE artist IN (SELECT src FROM edges UNION SELECT dst FROM edges)),
        r AS (SELECT community, artist, row_number() OVER (PARTITION BY community ORDER BY round(coalesce(degree, 0), 9) DESC, artist) AS place FROM own LEFT JOIN degrees USING (artist))
        SELECT community, max(artist) FILTER (place = 1) AS centroid, count(*) AS size, string_agg(artist, ',' ORDER BY place) FILTER (place <= 3) AS top_artists FROM r GROUP BY 1""",
    "graph_document": f"{with_views('edges')} SELECT src, dst, round(weight, 6) AS weight FROM edges",
    "artist_genre_profiles": f"{with_views('metadata')}, {_PROFILES} SELECT artist_key, total_albums, main_genres FROM profiles JOIN (SELECT {_KEY} AS artist_key, count(DISTINCT review_id) AS total_albums FROM metadata GROUP BY 1) USING (artist_key)",
    "impute_same_artist": f"""{with_views("metadata")}, {_PROFILES} SELECT review_id, CASE WHEN len(genres) = 0 AND main_genres IS NOT NULL THEN main_genres ELSE array_to_string(genres, ',') END AS genres,
        len(genres) = 0 AND main_genres IS NOT NULL AS from_artist FROM (SELECT *, {_KEY} AS artist_key FROM metadata) LEFT JOIN profiles USING (artist_key)""",
    "impute_from_references": f"""{with_views("metadata", "refs")}, {_COUNTS}, names AS (SELECT artist, coalesce(max(artist_key) FILTER (artist_key LIKE 'mbid:%'), min(artist_key)) AS artist_key FROM (SELECT artist, {_KEY} AS artist_key FROM metadata) GROUP BY 1),
        usable AS (SELECT * FROM names WHERE artist_key IN (SELECT artist_key FROM counts)),
        used AS (SELECT * FROM (SELECT review_id, artist_key, row_number() OVER (PARTITION BY review_id ORDER BY pos) AS nth FROM refs JOIN usable USING (artist) WHERE review_id IN (SELECT review_id FROM metadata WHERE len(genres) = 0)) WHERE nth <= 3),
        summed AS (SELECT review_id, genre, sum(n) AS n FROM used JOIN counts USING (artist_key) GROUP BY 1, 2) SELECT review_id, genre, place FROM ({_main("summed", "review_id")})""",
}

QUERIES = {
    f.__name__: f
    for f in (
        position_weights, album_affinities, top_communities, artist_edges, undirected_edges, weighted_degree_centroid, artist_attribute_counts, attribute_purity, cluster_quality, cross_community_neighbors,
        label_propagation, bfs_distances, community_distances, community_distance_matrix, modular_communities, purity_summary, community_map, incremental_export, graph_document, artist_genre_profiles, impute_same_artist, impute_from_references,
    )
}
