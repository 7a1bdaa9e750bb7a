"""The directed graph of artists and those they are compared with, and its communities."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groovemill.functions.numbers import five_year_bucket, position_weight
from groovemill.sources.checkpoints import bucketed, stored
from groovemill.sources.parts import dealt, parts_of


def _mentions(reviews: DataFrame, refs: DataFrame) -> DataFrame:
    """src, dst, w, n_albums: the position weight of dst's first mention in each album of src, and how many albums src has."""
    firsts = refs.groupBy("review_id", F.col("artist").alias("dst")).agg(F.min("pos").alias("pos"), F.max("n_refs").alias("n_refs"))
    albums = reviews.groupBy("artist").agg(F.count("*").alias("n_albums"))
    # the number of albums goes along with each album, as there are fewer of these than of pairs
    counted = reviews.select("review_id", "artist").join(albums, "artist").select("review_id", F.col("artist").alias("src"), "n_albums")
    return firsts.join(counted, "review_id").select("src", "dst", position_weight(F.col("pos"), F.col("n_refs")).alias("w"), "n_albums")


def artist_edges(reviews: DataFrame, refs: DataFrame, parts: int = 0) -> DataFrame:
    """src, dst, weight: the position weights of dst's first mention in each album of src, over all albums of src.

    parts: partitions that the pairs of artists are dealt into, if more than Spark's own number.
    """
    mentions = _mentions(reviews, refs)
    return dealt(mentions, parts, "src", "dst").groupBy("src", "dst").agg((F.sum("w") / F.max("n_albums")).alias("weight"))


def artist_degrees(reviews: DataFrame, refs: DataFrame) -> DataFrame:
    """``weighted_degrees`` of ``artist_edges`` where nothing else needs the edges: mentions are summed by artist, without a row for each pair."""
    return weighted_degrees(_mentions(reviews, refs).select("src", "dst", (F.col("w") / F.col("n_albums")).alias("weight")))


def undirected_edges(edges: DataFrame, parts: int = 0) -> DataFrame:
    """a <= b, weight of both directions together."""
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight")
    return dealt(pairs, parts, "a", "b").groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def weighted_degrees(edges: DataFrame) -> DataFrame:
    """artist, degree: outgoing and incoming weight; a loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("artist"), "weight")
    return ends.groupBy("artist").agg(F.sum("weight").alias("degree"))


def community_centroids(degrees: DataFrame, memberships: DataFrame, k: int = 10) -> DataFrame:
    """The k members of largest degree of each community with their place; the first is its centroid. Ties go by name."""
    order = Window.partitionBy("community").orderBy(F.round("degree", 9).desc(), "artist")
    members = memberships.join(degrees, "artist", "left").withColumn("degree", F.coalesce("degree", F.lit(0.0)))
    return members.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)


def attribute_counts(reviews: DataFrame, genres: DataFrame) -> DataFrame:
    """artist, kind, value, n: how often an artist's albums have each genre, author, five-year bucket and record label.

    genres: review_id, genres (array).
    """
    year = F.coalesce("release_year", F.year("release_date"))
    pairs = [("author", F.col("author")), ("years", F.when(year.isNotNull(), five_year_bucket(year))), ("label", F.col("label"))]
    single = reviews.select("artist", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in pairs))).alias("x"))
    styles = reviews.select("review_id", "artist").join(genres, "review_id").select("artist", F.explode(F.transform("genres", lambda g: F.struct(F.lit("genre").alias("kind"), g.alias("value")))).alias("x"))
    return single.union(styles).where("x.value IS NOT NULL").groupBy("artist", "x.kind", "x.value").agg(F.count("*").alias("n"))


def attribute_purity(counts: DataFrame, memberships: DataFrame) -> DataFrame:
    """kind, purity (largest counts of the communities over all counts), coverage (share of members with a count)."""
    members = memberships.agg(F.count("*").alias("n_members"))
    joined = memberships.join(counts, "artist")
    per_value = joined.groupBy("kind", "community", "value").agg(F.sum("n").alias("n"))
    largest = per_value.groupBy("kind", "community").agg(F.max("n").alias("top"), F.sum("n").alias("n")).groupBy("kind").agg(F.sum("top").alias("top"), F.sum("n").alias("n"))
    covered = joined.select("kind", "artist").distinct().groupBy("kind").agg(F.count("*").alias("covered"))
    return largest.join(covered, "kind").crossJoin(F.broadcast(members)).select("kind", (F.col("top") / F.col("n")).alias("purity"), (F.col("covered") / F.col("n_members")).alias("coverage"))


def combined_purity(purity: DataFrame) -> DataFrame:
    """One row: the mean of the purities (kind, purity) that there are; null without any."""
    return purity.agg(F.avg("purity").alias("combined_purity"))


def cross_community_edges(edges: DataFrame, memberships: DataFrame) -> DataFrame:
    """community, neighbour, weight in both directions, between different communities."""
    at = lambda end: memberships.select(F.col("artist").alias(end), F.col("community").alias(f"{end}_community"))
    between = edges.join(at("src"), "src").join(at("dst"), "dst").where("src_community <> dst_community").groupBy("src_community", "dst_community").agg(F.sum("weight").alias("w"))
    both = between.union(between.select("dst_community", "src_community", "w")).toDF("community", "neighbour", "w")
    return both.groupBy("community", "neighbour").agg(F.sum("w").alias("weight"))


def top_neighbours(cross: DataFrame, k: int = 6) -> DataFrame:
    order = Window.partitionBy("community").orderBy(F.round("weight", 9).desc(), "neighbour")
    return cross.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)


def circular_layout(communities: DataFrame, margin: float = 0.08) -> DataFrame:
    """``communities`` (community; as many as a map can show) with x and y from 0 to 1: on a circle in the order of their names, scaled to the margins."""
    placed = communities.withColumn("q_nth", F.row_number().over(Window.orderBy("community")) - 1)
    angle = 2 * F.lit(math.pi) * F.col("q_nth") / F.col("q_n")
    counted = placed.crossJoin(F.broadcast(communities.agg(F.count("*").alias("q_n"))))  # one row, as below
    on_circle = counted.withColumn("q_x", F.when(F.col("q_n") == 1, 0.0).otherwise(F.cos(angle))).withColumn("q_y", F.when(F.col("q_n") == 1, 0.0).otherwise(F.sin(angle)))
    ends = on_circle.agg(*(f(c).alias(f"{n}_{c}") for c in ("q_x", "q_y") for f, n in ((F.min, "low"), (F.max, "high"))))
    scaled = lambda c: F.lit(margin) + F.lit(1 - 2 * margin) * (F.col(c) - F.col(f"low_{c}")) / F.greatest(F.col(f"high_{c}") - F.col(f"low_{c}"), F.lit(1e-6))
    return on_circle.crossJoin(F.broadcast(ends)).select(*communities.columns, scaled("q_x").alias("x"), scaled("q_y").alias("y"))


def cluster_quality(edges: DataFrame, memberships: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity (undirected), sizes of the communities, and weight inside and between them (directed).

    Only edges between members count.
    """
    at = lambda end: memberships.select(F.col("artist").alias(end), F.col("community").alias(f"{end}_community"))
    placed = edges.join(at("src"), "src").join(at("dst"), "dst")
    inside = placed.where("src_community = dst_community").groupBy(F.col("src_community").alias("community")).agg(F.sum("weight").alias("inside"))
    degree = placed.select(F.explode(F.array("src_community", "dst_community")).alias("community"), "weight").groupBy("community").agg(F.sum("weight").alias("degree"))
    total = placed.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("m"), F.count("*").alias("num_edges"))
    terms = degree.join(inside, "community", "left").crossJoin(F.broadcast(total)).agg(
        F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.lit(resolution) * F.pow(F.col("degree") / (2 * F.col("m")), F.lit(2.0))).alias("modularity"),
        F.sum(F.coalesce("inside", F.lit(0.0))).alias("internal_weight"),
        F.first("m").alias("m"),
        F.first("num_edges").alias("num_edges"),
    )
    sizes = memberships.groupBy("community").agg(F.count("*").alias("n")).agg(F.count("*").alias("num_communities"), F.sum("n").alias("num_nodes"), F.avg("n").alias("avg_size"), F.min("n").alias("min_size"), F.max("n").alias("max_size"))
    share = lambda x: F.when(F.col("m") > 0, x / F.col("m")).otherwise(F.lit(0.0))
    external = F.col("m") - F.col("internal_weight")
    return terms.crossJoin(sizes).select(F.coalesce("modularity", F.lit(0.0)).alias("modularity"), "num_communities", "num_nodes", "num_edges", "avg_size", "min_size", "max_size", F.coalesce("internal_weight", F.lit(0.0)).alias("internal_weight"), F.coalesce(external, F.lit(0.0)).alias("external_weight"), share(F.col("internal_weight")).alias("internal_share"), share(external).alias("external_share"))


def propagate_labels(edges: DataFrame, labels: DataFrame, parts: int = 0) -> DataFrame:
    """artist, community: artists without a label take that of most outgoing weight, round after round.

    Rounds are synchronous; equal weights go to the label that sorts last. Stops when a round labels nobody, so after as
    many rounds as the longest way to a labelled artist has steps. parts: as for ``artist_edges``.
    """
    labels = stored(labels.select("artist", "community"), "labels")
    front, open_ = labels, edges
    while True:
        # whoever has a labelled neighbour is labelled in the next round, so only the newest labels have votes left to give
        open_ = stored(dealt(open_, parts, "src").join(front.select(F.col("artist").alias("src")), "src", "left_anti"), "open-edges")
        votes = dealt(open_, parts, "dst").join(front.select(F.col("artist").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.round(F.sum("weight"), 9).alias("w"))
        won = votes.groupBy(F.col("src").alias("artist")).agg(F.max(F.struct("w", "community")).alias("best")).select("artist", F.col("best.community").alias("community"))
        front = stored(won, "labels")
        if front.isEmpty():
            return labels
        labels = labels.union(front)


def updated_memberships(edges: DataFrame, previous: DataFrame, parts: int = 0) -> DataFrame:
    """artist, community of all artists of the graph: if the previous ones (artist, community) have any community, these are kept
    and propagated to artists that are new; else communities are found anew."""
    from groovemill.operators import communities

    known = previous.where("trim(community) <> ''")
    if known.isEmpty():
        return communities.modular_communities(edges)
    own = edges.select("src").union(edges.select("dst")).distinct().withColumnRenamed("src", "artist")
    return propagate_labels(edges, known, parts).join(own, "artist", "left_semi")


def described_communities(edges: DataFrame, memberships: DataFrame, k: int = 10) -> DataFrame:
    """community, centroid, size, top_artists (the k of largest degree), as the export has them."""
    top = community_centroids(weighted_degrees(edges), memberships, k)
    listed = top.groupBy("community").agg(F.max(F.when(F.col("place") == 1, F.col("artist"))).alias("centroid"), F.transform(F.array_sort(F.collect_list(F.struct("place", "artist"))), lambda x: x["artist"]).alias("top_artists"))
    return listed.join(memberships.groupBy("community").agg(F.count("*").alias("size")), "community").select("community", "centroid", "size", "top_artists")


def reached_bits(edges: DataFrame, sources: DataFrame, cutoff: int = 10) -> DataFrame:
    """artist, word, bits, hops: which of the sources (nth from 0, artist) reach an artist first in so many steps over undirected edges.

    Bit i of word w stands for source 64 * w + i. All sources go at once: in each level an artist is a row for each word that any
    source is new in, and a step is one join and a bitwise sum, so a level keeps no more rows than artists times words,
    whatever the sources. The edges are dealt out once, into buckets by their first artist; a step deals out its front alone.
    """
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst")
    own, zero = F.expr("shiftleft(1L, CAST(nth % 64 AS INT))"), F.lit(0).cast("long")
    first = sources.groupBy("artist", F.floor(F.col("nth") / 64).cast("long").alias("word")).agg(F.bit_or(own).alias("bits"))
    with bucketed(both, 2 * parts_of(edges), "src") as near:
        state = stored(first.select("artist", "word", "bits", zero.alias("known")), "reached")
        levels = []
        for hop in range(cutoff + 1):
            if hop:
                # the front is the smaller side and is hashed, so that the edges need no sorting
                front = levels[-1].select(F.col("artist").alias("src"), "word", "bits").hint("shuffle_hash")
                sent = near.join(front, "src").select(F.col("dst").alias("artist"), "word", "bits", zero.alias("known"))
                before = state.select("artist", "word", zero.alias("bits"), F.col("bits").bitwiseOR(F.col("known")).alias("known"))
                reached = sent.union(before).groupBy("artist", "word").agg(F.bit_or("bits").alias("bits"), F.bit_or("known").alias("known"))
                state = stored(reached.withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not("known"))), "reached")
            front = state.where("bits <> 0").select("artist", "word", "bits", F.lit(hop).cast("long").alias("hops"))
            if front.isEmpty():
                break
            levels.append(front)
    if not levels:
        return state.select("artist", "word", "bits", zero.alias("hops"))  # without sources
    found = levels[0]
    for level in levels[1:]:
        found = found.union(level)
    return found


def _numbered(sources: DataFrame) -> DataFrame:
    return stored(sources.select("artist").distinct().withColumn("nth", (F.row_number().over(Window.orderBy("artist")) - 1).cast("long")), "sources")


def _each_source(reached: DataFrame) -> DataFrame:
    """``reached`` with a row and ``nth`` for each source in its bits."""
    set_ = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col("bits"), i) == 1)
    return reached.withColumn("bit", F.explode(set_)).withColumn("nth", F.col("word") * 64 + F.col("bit")).drop("word", "bits", "bit")


def hop_distances(edges: DataFrame, sources: DataFrame, cutoff: int = 10, among: DataFrame | None = None) -> DataFrame:
    """source, artist, hops over undirected edges, as far as ``cutoff``; sources (artist) are a stated, small set.

    among: artists (artist) that distances are asked for, if not for all.
    """
    named = _numbered(sources)
    reached = reached_bits(edges, named, cutoff)
    if among is not None:
        reached = reached.join(among.select("artist"), "artist", "left_semi")
    return _each_source(reached).join(named.select("nth", F.col("artist").alias("source")), "nth").select("source", "artist", "hops")


def community_distances(edges: DataFrame, sources: DataFrame, members: DataFrame, cutoff: int = 10) -> DataFrame:
    """source, community, least and mean hops to the community's reachable members; sources as for ``hop_distances``.

    Artists get their communities while all sources are bits of one row; counts of equal hops are what is dealt out by source.
    """
    named = _numbered(sources)
    placed = reached_bits(edges, named, cutoff).join(members, "artist").select("community", "hops", "word", "bits")
    counted = _each_source(placed).groupBy("nth", "community", "hops").agg(F.count("*").alias("n"))
    means = counted.groupBy("nth", "community").agg(F.min("hops").alias("min_hops"), (F.sum(F.col("hops") * F.col("n")) / F.sum("n")).alias("mean_hops"))
    return means.join(named.select("nth", F.col("artist").alias("source")), "nth").select("source", "community", "min_hops", "mean_hops")


def community_matrix(hops: DataFrame, centroids: DataFrame) -> DataFrame:
    """community, neighbour, hops between the centroids (community, artist) of each two communities; null: none found.

    hops: from each centroid, as ``hop_distances`` gives them.
    """
    here = centroids.select("community", F.col("artist").alias("source"))
    there = centroids.select(F.col("community").alias("neighbour"), "artist")
    return here.crossJoin(there).join(hops, ["source", "artist"], "left").select("community", "neighbour", "hops")


def ranked_communities(labels: DataFrame) -> DataFrame:
    """label, community of labels (artist, label): C001 is the largest, ties go by the first name.

    Places are counted within sizes and over the sizes, so that no task sees all communities.
    """
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"), F.min("artist").alias("first"))
    larger = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.groupBy("n").agg(F.count("*").alias("m")).select("n", F.coalesce(F.sum("m").over(larger), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("n").orderBy("first"))
    return sizes.join(before, "n").select("label", F.format_string("C%03d", F.col("before") + within).alias("community"))
