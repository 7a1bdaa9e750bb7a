"""Queries on selections, labels, categories, lists in their order, and display texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from groovemill.functions.numbers import KEY_DIGITS
from groovemill.operators import affinity, graph, recommend, scoring, taste
from groovemill.plans import graph_queries, ranking_queries
from groovemill.sources.checkpoints import checkpointed
from groovemill.sources.domain import Tables, with_views

LABELS = ("1-URGENT", "BUILDING")
SERENDIPITY, SEED = 0.4, 17
FIRST, PHOTOS = 40, 100


def _r(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


def _albums(t: Tables):
    """Reviews with their record labels as an array: none, one or two."""
    second = F.when(F.col("review_id") % 4 == 0, F.concat(F.lit(" "), F.col("author")))
    return t.reviews().withColumn("labels", F.array_compact(F.array("label", second)))


def _communities(t: Tables):
    top = graph.community_centroids(graph.artist_degrees(t.reviews(), t.refs()), t.memberships(), 8)
    return top.groupBy("community").agg(F.max(F.when(F.col("place") == 1, F.col("artist"))).alias("centroid"), F.transform(F.array_sort(F.collect_list(F.struct("place", "artist"))), lambda x: x["artist"]).alias("top_artists"))


def _community_labels(t: Tables):
    """community, label: the first type of a community's parts; each fourth community has none."""
    parts = t.read("part").select(F.concat(F.lit("C"), F.lpad(F.substring("p_brand", 7, 99), 3, "0")).alias("community"), F.lower("p_type").alias("label"))
    return parts.groupBy("community").agg(F.min("label").alias("label")).where("cast(substring(community, 2) as int) % 4 <> 0")


def _categories(t: Tables):
    """community, category: the first words of its parts' types; each fifth community has none."""
    parts = t.read("part").select(F.concat(F.lit("C"), F.lpad(F.substring("p_brand", 7, 99), 3, "0")).alias("community"), F.substring_index("p_type", " ", 1).alias("category"))
    return parts.where("cast(substring(community, 2) as int) % 5 <> 0").distinct()


def _owned(t: Tables):
    """owner, flow, community: what listeners picked, by the kinds of their events."""
    flow = F.when((F.col("event_type") == "click") & (F.col("user_id") % 3 == 0), "canonical").when(F.col("event_type") == "view", "artist").when(F.col("event_type") == "purchase", "genre")
    community = F.concat(F.lit("C"), F.lpad((F.floor("value") % 25 + 1).cast("string"), 3, "0"))
    return t.read("events").select(F.col("user_id").alias("owner"), flow.alias("flow"), community.alias("community"), "event_id", "value").where("flow IS NOT NULL")


def canonical_selection(spark, sf_dir):
    found = taste.canonical_selection(_owned(Tables(spark, sf_dir)))
    return found.select("owner", F.array_join("communities", ",").alias("communities"))


def selected_weights(spark, sf_dir):
    owned = _owned(Tables(spark, sf_dir))
    weights = owned.where("flow = 'genre'").groupBy("owner", "community").agg(F.max(F.when(F.col("owner") % 4 == 0, 1.0).otherwise(F.round(F.col("value") / 1000, 6))).alias("weight"))
    return taste.selected_weights(owned.where("flow <> 'genre' OR owner % 4 = 0"), weights)


def selection_in_categories(spark, sf_dir):
    t = Tables(spark, sf_dir)
    owned = _owned(t)
    chosen = owned.where("owner % 2 = 0").select("owner", F.when(F.col("event_id") % 2 == 0, "PROMO").otherwise(taste.OTHER).alias("category")).distinct()
    return taste.within_categories(owned.select("owner", "community").distinct(), _categories(t), chosen)


def selection_categories(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = taste.selection_categories(_owned(t).select("owner", "community").distinct(), _categories(t))
    return found.select("owner", F.array_join("categories", ",").alias("categories"))


def taste_communities(spark, sf_dir):
    t = Tables(spark, sf_dir)
    options = taste.taste_communities(_communities(t), _community_labels(t), _categories(t))
    return options.select("community", "label", F.array_join("categories", ",").alias("categories"), F.array_join("example_artists", ",").alias("example_artists"))


def category_index(spark, sf_dir):
    t = Tables(spark, sf_dir)
    communities = t.memberships().groupBy("community").agg(F.min("artist").alias("centroid"), F.array(F.min("artist")).alias("top_artists"))
    return taste.category_index(taste.taste_communities(communities, _community_labels(t), _categories(t)))


def choice_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    last = _owned(t).groupBy("owner", "community").agg(F.max_by("flow", "event_id").alias("flow"))
    choices = last.select("owner", "community", F.when(F.col("flow") == "artist", "liked").when(F.col("flow") == "genre", "disliked").otherwise("unset").alias("choice"))
    return taste.choice_counts(choices, t.memberships().where("community < 'C020'").select("community"))


def label_array_filter(spark, sf_dir):
    return taste.label_set_filter(_albums(Tables(spark, sf_dir)), LABELS).select("review_id", F.array_join("labels", ",").alias("labels"))


def label_counts(spark, sf_dir):
    each = _albums(Tables(spark, sf_dir)).select("review_id", F.explode(F.array_distinct(taste.clean(F.col("labels")))).alias("label"))
    return each.groupBy("label").agg(F.count("*").alias("n"))


def label_choice(spark, sf_dir):
    t = Tables(spark, sf_dir)
    frequent, rare = (F.array(*map(F.lit, x)) for x in (("1-URGENT", "2-HIGH", "3-MEDIUM"), ("4-NOT SPECIFIED", "5-LOW")))
    key = F.col("c_custkey")
    chosen = F.array(F.when(key % 2 == 0, " 2-HIGH ").otherwise("1-URGENT"), F.when(key % 3 == 0, F.lit(taste.OTHER)).otherwise(""), F.when(key % 5 == 0, "5-LOW").otherwise("2-HIGH"), F.when(key % 10 == 0, "4-NOT SPECIFIED").otherwise(" "))
    rows = t.read("customer").select("c_custkey", taste.expand_labels(chosen, rare).alias("picked"))
    return rows.select("c_custkey", F.array_join("picked", "|").alias("labels"), F.array_join(taste.collapse_labels(F.col("picked"), frequent, rare), "|").alias("choice"))


def label_text(spark, sf_dir):
    t = Tables(spark, sf_dir)
    text = F.when(F.col("review_id") % 6 == 0, F.concat(F.lit(" "), F.col("author"), F.lit(" "))).when(F.col("review_id") % 6 == 1, " ")
    listed = F.when(F.col("review_id") % 5 == 0, F.array(F.lit(" "), F.col("artist"))).when(F.col("review_id") % 5 == 1, F.array(F.lit(" ")))
    return _albums(t).select("review_id", taste.label_text(text, listed, F.col("labels")).alias("label_text"))


def top_labels(spark, sf_dir):
    """Labels of each album's three largest communities that have one, and the parts of its fit that they stand for."""
    t = Tables(spark, sf_dir)
    top = affinity.top_communities(ranking_queries._affinities(t), 3).join(_community_labels(t), "community")
    listed = top.groupBy("review_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]).alias("labels"))
    return listed.select("review_id", F.array_join("labels", "|").alias("labels"), F.size("labels").alias("n_labels"))


def visible_breadth(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return taste.visible_breadth(ranking_queries._affinities(t)).select("review_id", "tags", *_r("breadth"))


def _newest_rows(t: Tables):
    fresh = checkpointed(recommend.newest(t.reviews(), 200))
    return recommend.scored(fresh, recommend.corpus_scores(ranking_queries._affinities(t), ranking_queries.PROFILE, fresh), ranking_queries.PROFILE, "left")


def serendipity_order(spark, sf_dir):
    ranked = checkpointed(recommend.page(_newest_rows(Tables(spark, sf_dir)), 0, 200).select("rank", "review_id"))
    return taste.serendipity_order(ranked, SERENDIPITY, SEED).select("rank", "old_rank", "review_id", *_r("key"))


def newest_unranked(spark, sf_dir):
    """Without a selected community new reviews stay in their order, newest first, with scores of 0."""
    t = Tables(spark, sf_dir)
    return recommend.in_order(recommend.newest(t.reviews(), 200), ranking_queries._affinities(t), scoring.TasteProfile()).select("rank", "review_id", "artist", *_r("score", "overall_score"))


def newest_highlights(spark, sf_dir):
    return taste.newest_highlights(_newest_rows(Tables(spark, sf_dir))).select("kind", "place", "review_id", "artist", "album")


def without_affinity(spark, sf_dir):
    t = Tables(spark, sf_dir)
    fresh = recommend.newest(t.reviews(), 2000).select("review_id")
    return fresh.join(t.refs().join(t.memberships(), "artist").select("review_id").distinct(), "review_id", "left_anti").agg(F.count("*").alias("n_without"))


def _ranked(t: Tables, n: int):
    return checkpointed(recommend.page(ranking_queries._archive(t), 0, n))


def photo_ranks(spark, sf_dir):
    t = Tables(spark, sf_dir)
    order = F.row_number().over(Window.partitionBy("label").orderBy(F.col("rating").desc(), F.col("review_id").desc()))
    top = t.reviews().where("label IS NOT NULL AND rating IS NOT NULL").withColumn("rank", order.cast("long")).where(F.col("rank") <= PHOTOS)
    rows = top.join(t.metadata().select("review_id", "mbid"), "review_id").select(F.col("label").alias("list"), "rank", "artist", "mbid", (F.col("review_id") % 3 != 0).alias("has_photo"))
    return taste.photo_ranks(rows)


def first_artists(spark, sf_dir):
    t = Tables(spark, sf_dir)
    top = _ranked(t, 500).select("rank", "review_id", "artist")
    return taste.first_artists(top.join(t.metadata().select("review_id", "mbid"), "review_id"), FIRST)


def playlist_rows(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return taste.playlist_rows(_ranked(t, 300).select("rank", "review_id"), _albums(t), t.metadata())


def guest_favorites(spark, sf_dir):
    saved = Tables(spark, sf_dir).read("events").where("event_type = 'click'").select(F.col("user_id").alias("owner"), F.floor("value").cast("long").alias("review_id"), F.col("ts").alias("saved_at"))
    return taste.moved_favorites(saved)


def node_radius(spark, sf_dir):
    sizes = Tables(spark, sf_dir).memberships().groupBy("community").agg(F.count("*").alias("size"))
    return taste.node_radius(sizes).select("community", "size", *_r("radius"))


def weight_share(spark, sf_dir):
    shares = tuple(F.greatest(F.lit(0.0), F.col("c_acctbal") * s) for s in (0.5, -0.25, 0.125))
    moved = taste.redistributed(shares, 1, F.col("c_custkey") % 130)
    rows = Tables(spark, sf_dir).read("customer").select("c_custkey", *(F.round(m, 6).alias(n) for m, n in zip(moved, ("alpha", "beta", "gamma"), strict=True)))
    percents = taste.rounded_percents([F.col(n) for n in ("alpha", "beta", "gamma")])
    return rows.select("c_custkey", "alpha", "beta", "gamma", *(p.alias(f"pct_{n}") for p, n in zip(percents, ("alpha", "beta", "gamma"), strict=True)))


def card_texts(spark, sf_dir):
    rows = Tables(spark, sf_dir).reviews()
    date = F.when(F.col("review_id") % 3 != 0, F.col("release_date"))
    label = F.when(F.col("review_id") % 2 == 0, F.coalesce("label", F.lit(" "))).otherwise(F.lit(""))
    artists = F.array(F.col("artist"), F.lit(" "), F.when(F.col("review_id") % 2 == 0, F.col("author")), F.concat("author", F.repeat(F.lit("x"), (F.col("review_id") % 40).cast("int"))))
    low, high = (F.col("review_id") % 101) / 100, (F.col("review_id") % 37) / 36
    return rows.select("review_id", F.array_join(taste.card_parts(date, F.col("release_year"), F.col("rating"), F.round(high, 2), label), " | ").alias("card"), taste.caption(F.array_compact(artists)).alias("caption"), *(p.alias(n) for p, n in zip(taste.slider_percents(F.round(low, 2), F.round(high, 2)), ("low_pct", "high_pct"), strict=True)), taste.range_text(F.round(low, 2), F.round(high, 2)).alias("range_text"))


def memberships_usable(spark, sf_dir):
    return taste.usable_memberships(Tables(spark, sf_dir).memberships().select(F.lit(" ").alias("res_1"), F.col("community").alias("res_10")), ("res_1", "res_10"))


_LABELLED = """albums AS (SELECT *, list_filter([label, CASE WHEN review_id % 4 = 0 THEN ' ' || author END], lambda x: x IS NOT NULL) AS labels FROM reviews)"""
_CLEANED = "list_filter(list_transform(labels, lambda x: trim(x)), lambda x: x <> '')"
_COMMUNITY = "'C' || lpad(substr(p_brand, 7), 3, '0')"
_LABEL_SQL = f"own_labels AS (SELECT community, min(label) AS label FROM (SELECT {_COMMUNITY} AS community, lower(p_type) AS label FROM part) WHERE CAST(substr(community, 2) AS INT) % 4 <> 0 GROUP BY 1)"
_CATEGORY_SQL = f"categories AS (SELECT DISTINCT community, category FROM (SELECT {_COMMUNITY} AS community, split_part(p_type, ' ', 1) AS category FROM part) WHERE CAST(substr(community, 2) AS INT) % 5 <> 0)"
_OWNED = """owned AS (SELECT * FROM (SELECT user_id AS owner, CASE WHEN event_type = 'click' AND user_id % 3 = 0 THEN 'canonical' WHEN event_type = 'view' THEN 'artist' WHEN event_type = 'purchase' THEN 'genre' END AS flow,
    'C' || lpad(CAST(CAST(floor(value) AS BIGINT) % 25 + 1 AS VARCHAR), 3, '0') AS community, event_id, value FROM events) WHERE flow IS NOT NULL)"""
_NEWEST = f"""{ranking_queries._ALL}, {ranking_queries._CORPUS}, fresh AS (SELECT * FROM reviews ORDER BY review_id DESC LIMIT 200), {ranking_queries._scored("LEFT", "fresh")}"""
_TOP = "ranked AS (SELECT row_number() OVER (ORDER BY {order}) AS rank, * FROM archive QUALIFY rank <= {n})"
_PICK = "SELECT * FROM {source} WHERE {where} ORDER BY {order} LIMIT 1"


def _highlights() -> str:
    fit, newest = "round(overall_score, 9)", "review_id DESC"
    return f"""{_NEWEST}, p0 AS ({_PICK.format(source="scored", where="true", order=f"{fit} DESC, rating_effective DESC, {newest}")}),
        r1 AS (SELECT * FROM scored WHERE (artist, album) NOT IN (SELECT (artist, album) FROM p0)), p1 AS ({_PICK.format(source="r1", where="true", order=f"rating_effective DESC, {fit} DESC, {newest}")}),
        r2 AS (SELECT * FROM r1 WHERE (artist, album) NOT IN (SELECT (artist, album) FROM p1)), p2a AS ({_PICK.format(source="r2", where=f"{fit} < {taste.OUTSIDE_BELOW}", order=f"rating_effective DESC, {fit}, {newest}")}),
        p2b AS ({_PICK.format(source="r2", where="NOT EXISTS (SELECT 1 FROM p2a)", order=f"{fit}, rating_effective DESC, {newest}")})
        SELECT 'fit' AS kind, 0::BIGINT AS place, review_id, artist, album FROM p0 UNION ALL SELECT 'critic', 1, review_id, artist, album FROM p1
        UNION ALL SELECT 'outside', 2, review_id, artist, album FROM (SELECT * FROM p2a UNION ALL SELECT * FROM p2b)"""


def _weights_sql() -> str:
    raw = ", ".join(f"greatest(0.0::DOUBLE, c_acctbal * {s}::DOUBLE) AS s{i}" for i, s in enumerate((0.5, -0.25, 0.125)))
    norm = ", ".join(f"CASE WHEN s0 + s1 + s2 > 0 THEN s{i} / (s0 + s1 + s2) ELSE 1.0::DOUBLE / 3 END AS n{i}" for i in range(3))
    moved = ", ".join(f"round(CASE WHEN n0 + n2 > 0 THEN n{i} / (n0 + n2) * (1 - own) ELSE (1 - own) / 2 END, 6) AS {name}" for i, name in ((0, "alpha"), (2, "gamma")))
    whole = ", ".join(f"CAST(floor({n} * 100 + 0.5) AS BIGINT) AS w{i}" for i, n in enumerate(("alpha", "beta", "gamma")))
    top = "greatest(w0, w1, w2)"
    return f"""WITH a AS (SELECT c_custkey, {raw} FROM customer), b AS (SELECT c_custkey, least(100.0::DOUBLE, c_custkey % 130) / 100 AS own, {norm} FROM a),
        c AS (SELECT c_custkey, {moved}, round(own, 6) AS beta FROM b), d AS (SELECT *, {whole} FROM c), e AS (SELECT *, 100 - w0 - w1 - w2 AS drift FROM d)
        SELECT c_custkey, alpha, beta, gamma, w0 + CASE WHEN w0 = {top} THEN drift ELSE 0 END AS pct_alpha, w1 + CASE WHEN w1 = {top} AND w0 < {top} THEN drift ELSE 0 END AS pct_beta,
        w2 + CASE WHEN w2 = {top} AND w0 < {top} AND w1 < {top} THEN drift ELSE 0 END AS pct_gamma FROM e"""


_EXAMPLES = """tops AS (SELECT community, artist, row_number() OVER (PARTITION BY community ORDER BY round(coalesce(degree, 0), 9) DESC, artist) AS place FROM memberships LEFT JOIN degrees USING (artist)),
    communities AS (SELECT community, max(artist) FILTER (place = 1) AS centroid, string_agg(artist, ',' ORDER BY place) FILTER (place <= 6) AS example_artists FROM tops GROUP BY 1)"""
_PCT = "CAST(round_even({x} * 100, 0) AS BIGINT)"
_STEP = "CAST(round_even({x} / 5.0::DOUBLE, 0) * 5 AS BIGINT)"

SQL = {
    "canonical_selection": f"""WITH {_OWNED}, s AS (SELECT owner, list_sort(list(DISTINCT community) FILTER (flow = 'canonical')) AS own, list_sort(list(DISTINCT community) FILTER (flow <> 'canonical')) AS other FROM owned GROUP BY 1)
        SELECT owner, coalesce(array_to_string(CASE WHEN len(own) > 0 THEN own ELSE other END, ','), '') AS communities FROM s""",
    "selected_weights": f"""WITH {_OWNED}, w AS (SELECT owner, community, max(CASE WHEN owner % 4 = 0 THEN 1.0::DOUBLE ELSE round(value / 1000, 6) END) AS weight FROM owned WHERE flow = 'genre' GROUP BY 1, 2),
        s AS (SELECT DISTINCT owner, community FROM owned WHERE flow <> 'genre' OR owner % 4 = 0), j AS (SELECT owner, community, coalesce(weight, 0.5::DOUBLE) AS weight FROM s LEFT JOIN w USING (owner, community))
        SELECT owner, community, CASE WHEN min(weight) OVER (PARTITION BY owner) = 1 AND max(weight) OVER (PARTITION BY owner) = 1 THEN 0.5::DOUBLE ELSE weight END AS weight FROM j""",
    "selection_in_categories": f"""WITH {_OWNED}, {_CATEGORY_SQL}, s AS (SELECT DISTINCT owner, community FROM owned), chosen AS (SELECT DISTINCT owner, CASE WHEN event_id % 2 = 0 THEN 'PROMO' ELSE '{taste.OTHER}' END AS category FROM owned WHERE owner % 2 = 0),
        p AS (SELECT owner, community, coalesce(category, '{taste.OTHER}') AS category FROM s LEFT JOIN categories USING (community))
        SELECT DISTINCT owner, community FROM p WHERE owner NOT IN (SELECT owner FROM chosen) OR (owner, category) IN (SELECT (owner, category) FROM chosen)""",
    "selection_categories": f"""WITH {_OWNED}, {_CATEGORY_SQL} SELECT owner, coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS categories FROM owned LEFT JOIN categories USING (community) GROUP BY 1""",
    "taste_communities": f"""{with_views("edges", "memberships")}, {graph_queries._DEGREES}, {_LABEL_SQL}, {_CATEGORY_SQL}, {_EXAMPLES}, g AS (SELECT community, string_agg(category, ',' ORDER BY category) AS categories FROM categories GROUP BY 1)
        SELECT community, coalesce(label, centroid) AS label, coalesce(categories, '') AS categories, example_artists FROM communities LEFT JOIN own_labels USING (community) LEFT JOIN g USING (community)""",
    "category_index": f"""{with_views("memberships")}, {_LABEL_SQL}, {_CATEGORY_SQL}, c AS (SELECT community, min(artist) AS centroid FROM memberships GROUP BY 1),
        o AS (SELECT community, coalesce(label, centroid) AS label, coalesce(category, '{taste.OTHER}') AS category FROM c LEFT JOIN own_labels USING (community) LEFT JOIN categories USING (community))
        SELECT category, row_number() OVER (PARTITION BY category ORDER BY lower(label), community) AS place, community, label FROM o""",
    "choice_counts": f"""{with_views("memberships")}, {_OWNED}, v AS (SELECT DISTINCT community FROM memberships WHERE community < 'C020'), l AS (SELECT owner, community, arg_max(flow, event_id) AS flow FROM owned GROUP BY 1, 2),
        n AS (SELECT owner, count(*) FILTER (flow = 'artist' AND community IN (FROM v)) AS liked, count(*) FILTER (flow = 'genre' AND community IN (FROM v)) AS disliked FROM l GROUP BY 1), t AS (SELECT count(*) AS total FROM v)
        SELECT owner, liked, disliked, liked + disliked AS reviewed, total - liked - disliked AS unset, total FROM n, t""",
    "label_array_filter": f"""{with_views("reviews")}, {_LABELLED} SELECT review_id, array_to_string(labels, ',') AS labels FROM albums WHERE len(labels) = 0 OR list_has_any({_CLEANED}, {list(LABELS)})""",
    "label_counts": f"""{with_views("reviews")}, {_LABELLED} SELECT label, count(*) AS n FROM (SELECT review_id, unnest(list_distinct({_CLEANED})) AS label FROM albums) GROUP BY 1""",
    "label_choice": f"""WITH c AS (SELECT c_custkey, list_filter(list_transform([CASE WHEN c_custkey % 2 = 0 THEN ' 2-HIGH ' ELSE '1-URGENT' END, CASE WHEN c_custkey % 3 = 0 THEN '{taste.OTHER}' ELSE '' END,
        CASE WHEN c_custkey % 5 = 0 THEN '5-LOW' ELSE '2-HIGH' END, CASE WHEN c_custkey % 10 = 0 THEN '4-NOT SPECIFIED' ELSE ' ' END], lambda x: trim(x)), lambda x: x <> '') AS p FROM customer),
        e AS (SELECT c_custkey, list_sort(list_distinct(CASE WHEN list_contains(p, '{taste.OTHER}') THEN list_filter(p, lambda x: x <> '{taste.OTHER}') || ['4-NOT SPECIFIED', '5-LOW'] ELSE p END)) AS labels FROM c)
        SELECT c_custkey, array_to_string(labels, '|') AS labels, array_to_string(list_filter(['1-URGENT', '2-HIGH', '3-MEDIUM'], lambda x: list_contains(labels, x)) || CASE WHEN list_has_all(labels, ['4-NOT SPECIFIED', '5-LOW']) THEN ['{taste.OTHER}'] ELSE [] END, '|') AS choice FROM e""",
    "label_text": f"""{with_views("reviews")}, {_LABELLED} SELECT review_id, CASE WHEN review_id % 6 = 0 THEN author WHEN review_id % 5 = 0 THEN artist ELSE coalesce(array_to_string({_CLEANED}, ', '), '') END AS label_text FROM albums""",
    "top_labels": f"""{with_views("affinities")}, {_LABEL_SQL}, t AS (SELECT review_id, community, row_number() OVER (PARTITION BY review_id ORDER BY round(share, 9) DESC, community) AS place FROM affinities)
        SELECT review_id, string_agg(label, '|' ORDER BY place) AS labels, CAST(count(*) AS INT) AS n_labels FROM t JOIN own_labels USING (community) WHERE place <= 3 GROUP BY 1""",
    "visible_breadth": f"""{with_views("affinities")}, v AS (SELECT review_id, count(*) AS tags, sum(share) AS total FROM affinities WHERE round(share, 9) >= 0.1 GROUP BY 1),
        b AS (SELECT review_id, exp(-sum(share / total * ln(share / total))) AS b FROM affinities JOIN v USING (review_id) WHERE round(share, 9) >= 0.1 GROUP BY 1)
        SELECT review_id, coalesce(tags, 0) AS tags, round(CASE WHEN coalesce(tags, 0) <= 1 THEN 1.0::DOUBLE ELSE b END, 6) AS breadth FROM (SELECT DISTINCT review_id FROM affinities) LEFT JOIN v USING (review_id) LEFT JOIN b USING (review_id)""",
    "serendipity_order": f"""{_NEWEST}, r AS (SELECT row_number() OVER (ORDER BY {ranking_queries._ORDER}) AS old_rank, review_id FROM scored),
        k AS (SELECT *, round({1 - SERENDIPITY}::DOUBLE * (old_rank - 1) / ((SELECT count(*) FROM r) - 1) + {SERENDIPITY}::DOUBLE * ((((review_id % 1000003) * 2654435761 + {SEED}) % 1000003 + 0.5::DOUBLE) / 1000003), {KEY_DIGITS}) AS key FROM r)
        SELECT row_number() OVER (ORDER BY key, old_rank) AS rank, old_rank, review_id, round(key, 6) AS key FROM k""",
    "newest_unranked": f"{with_views('reviews')} SELECT row_number() OVER (ORDER BY review_id DESC) AS rank, review_id, artist, 0.0::DOUBLE AS score, 0.0::DOUBLE AS overall_score FROM (SELECT * FROM reviews ORDER BY review_id DESC LIMIT 200)",
    "newest_highlights": _highlights(),
    "without_affinity": f"{with_views('reviews', 'affinities')} SELECT count(*) AS n_without FROM (SELECT * FROM reviews ORDER BY review_id DESC LIMIT 2000) WHERE review_id NOT IN (SELECT review_id FROM affinities)",
    "first_artists": f"""{ranking_queries._ARCHIVE}, metadata AS (SELECT o_orderkey AS review_id, CASE WHEN o_custkey % 2 = 0 THEN 'mb' || o_custkey END AS mbid FROM orders), {_TOP.format(order=ranking_queries._ORDER, n=500)},
        k AS (SELECT rank, review_id, artist, coalesce(mbid, 'name:' || lower(artist)) AS key FROM ranked JOIN metadata USING (review_id))
        SELECT rank, review_id, artist, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank) AS nth FROM k) WHERE nth = 1 ORDER BY rank LIMIT {FIRST}""",
    "playlist_rows": f"""{ranking_queries._ARCHIVE}, metadata AS (SELECT o_orderkey AS review_id, CASE WHEN o_custkey % 2 = 0 THEN 'mb' || o_custkey END AS mbid FROM orders), {_TOP.format(order=ranking_queries._ORDER, n=300)}
        SELECT rank, review_id, artist, album, CASE WHEN label IS NOT NULL THEN label WHEN review_id % 4 = 0 THEN author END AS first_label, mbid FROM ranked JOIN metadata USING (review_id)""",
    "guest_favorites": """WITH s AS (SELECT user_id AS owner, CAST(floor(value) AS BIGINT) AS review_id, max(ts) AS saved_at FROM events WHERE event_type = 'click' GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY owner ORDER BY saved_at DESC, review_id DESC) AS place FROM s""",
    "node_radius": f"""{with_views("memberships")}, s AS (SELECT community, count(*) AS size FROM memberships GROUP BY 1)
        SELECT community, size, round(CASE WHEN max(size) OVER () = min(size) OVER () THEN 15.0::DOUBLE ELSE 8 + (size - min(size) OVER ()) / (max(size) OVER () - min(size) OVER ()) * 14.0::DOUBLE END, 6) AS radius FROM s""",
    "weight_share": _weights_sql(),
    "card_texts": f"""{with_views("reviews")}, v AS (SELECT *, round((review_id % 101) / 100.0::DOUBLE, 2) AS low, round((review_id % 37) / 36.0::DOUBLE, 2) AS high,
        CASE WHEN review_id % 3 <> 0 THEN strftime(release_date, '%d.%m.%Y') ELSE CAST(release_year AS VARCHAR) END AS day, trim(CASE WHEN review_id % 2 = 0 THEN coalesce(label, ' ') ELSE '' END) AS own,
        list_filter([artist, CASE WHEN review_id % 2 = 0 THEN author END, author || repeat('x', CAST(review_id % 40 AS INT))], lambda x: x IS NOT NULL) AS names FROM reviews),
        c AS (SELECT *, 'z. B. ' || array_to_string(names[1:3], ', ') AS c3, 'z. B. ' || array_to_string(names[1:2], ', ') AS c2, 'z. B. ' || names[1] AS c1 FROM v)
        SELECT review_id, array_to_string(list_filter([day, CASE WHEN rating IS NULL THEN 'Rating 5/10 (angenommen)' ELSE 'Rating ' || CAST(CAST(rating AS BIGINT) AS VARCHAR) || '/10' END, 'Score ' || printf('%.2f', high),
        CASE WHEN own <> '' THEN 'Plattenlabel: ' || own END], lambda x: x IS NOT NULL), ' | ') AS card, CASE WHEN length(c3) <= 55 THEN c3 WHEN length(c2) <= 55 THEN c2 ELSE c1 END AS caption,
        {_STEP.format(x="round_even(least(low, high) * 100, 0)")} AS low_pct, {_STEP.format(x="round_even(greatest(low, high) * 100, 0)")} AS high_pct,
        {_PCT.format(x="least(low, high)")} || ' % bis ' || {_PCT.format(x="greatest(low, high)")} || ' %' AS range_text FROM c""",
    "memberships_usable": f"{with_views('memberships')} SELECT count(*) > 0 AS usable FROM memberships WHERE trim(community) <> ''",
}

QUERIES = {
    f.__name__: f
    for f in (
        canonical_selection, selected_weights, selection_in_categories, selection_categories, taste_communities, category_index, choice_counts, label_array_filter, label_counts, label_choice, label_text, top_labels, visible_breadth,
        serendipity_order, newest_unranked, newest_highlights, without_affinity, photo_ranks, first_artists, playlist_rows, guest_favorites, node_radius, weight_share, card_texts, memberships_usable,
    )
}
