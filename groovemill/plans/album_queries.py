"""Queries on playlists, batches, data quality, tags, names and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from groovemill.functions.tags import GENRES, NO_STYLE_PARTS, NO_STYLES
from groovemill.functions.text import track_key
from groovemill.operators import batches, genres, lookups, name_index, names, pages, playlist, quality, recommend
from groovemill.plans import ranking_queries
from groovemill.sources.checkpoints import checkpointed
from groovemill.sources.domain import Tables, with_views

#: Tracks of a playlist, its exponent and seed.
TARGET, EXPONENT, SEED = 30, 2.0, 17
THIS_YEAR = 2026
#: Raw tags by the number of a part's brand.
TAGS = "Indie Rock|post-punk|Hip-Hop/Rap|2004|british|Drum and Bass|Singer/Songwriter|dream pop|concept album|R&B|alt-country|Electropop; synth-pop|Death Metal|chamber folk|dark|trip hop|Neo-Psychedelia|Latin + World|rock & roll|acid jazz|metalcore, hardcore|emo-folk|jazzrock|soundtrack|Art Pop|Techno|postrock".split("|")


def _pool(t: Tables):
    # all candidates; each step below uses its input twice, so the plan would double with each
    return playlist.album_weights(checkpointed(recommend.archive_pool(ranking_queries._archive(t))))


def album_weights(spark, sf_dir):
    pool = playlist.amplify(_pool(Tables(spark, sf_dir)), EXPONENT)
    return pool.select("place", "review_id", F.round("weight", 9).alias("weight"))


def stratified_slots(spark, sf_dir):
    pool = playlist.amplify(_pool(Tables(spark, sf_dir)), EXPONENT)
    return playlist.stratified_slots(pool, TARGET).select("place", "review_id", "floor_slots", "extra", "quota", F.round("ideal", 6).alias("ideal"))


def graduated_caps(spark, sf_dir):
    pool = _pool(Tables(spark, sf_dir)).withColumn("weight", F.round("weight", 9))
    caps = playlist.graduated_caps(pool, "deep").select("place", "review_id", F.col("cap").alias("deep"))
    return caps.join(playlist.graduated_caps(pool, "balanced").select("place", F.col("cap").alias("balanced")), "place")


def weighted_sample(spark, sf_dir):
    pool = _pool(Tables(spark, sf_dir)).withColumn("weight", F.round("weight", 9))
    return playlist.weighted_sample(pool, 10, SEED).select("nth", "review_id", F.round("draw", 6).alias("draw"))


def weighted_draws(spark, sf_dir):
    """More draws than albums with a weight: what is left is drawn with replacement."""
    orders = Tables(spark, sf_dir).read("orders").select(F.col("o_orderkey").alias("review_id"), F.round(F.when(F.col("o_orderkey") >= 60, -1.0).when(F.col("o_orderkey") % 5 == 0, 0.0).otherwise(F.col("o_orderkey") / 100), 6).alias("weight"))
    return playlist.weighted_sample(orders, 90, SEED).select("nth", "review_id", F.round("draw", 6).alias("draw"))


def track_candidates(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = playlist.track_candidates(t.tracks()).join(t.reviews().select("review_id", "artist"), "review_id")
    return found.select("review_id", "number", "source", track_key(F.col("artist"), F.col("title")).alias("key"))


def playlist_fill(spark, sf_dir):
    t = Tables(spark, sf_dir)
    slots = playlist.stratified_slots(playlist.amplify(_pool(t), EXPONENT), TARGET)
    capped = playlist.graduated_caps(slots, "balanced")
    return playlist.fill_playlist(capped.select("review_id", "artist", "place", "quota", "cap"), playlist.track_candidates(t.tracks()), TARGET, SEED)


def playlist_export(spark, sf_dir):
    t = Tables(spark, sf_dir)
    tracks = t.tracks().join(t.reviews().select("review_id", "artist"), "review_id")
    rows = tracks.select((F.col("review_id") * 1000 + F.col("number")).alias("position"), F.concat("artist", F.lit(', "live"')).alias("artist"), "title")
    return playlist.export_csv(rows)


def playlist_text(spark, sf_dir):
    t = Tables(spark, sf_dir)
    tracks = t.tracks().join(t.reviews().select("review_id", "artist"), "review_id")
    return playlist.export_text(tracks.select((F.col("review_id") * 1000 + F.col("number")).alias("position"), "artist", "title"))


def integer_percents(spark, sf_dir):
    counted = Tables(spark, sf_dir).read("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    place = F.ascii("c_mktsegment").cast("long") * 256 + F.length("c_mktsegment")
    rows = counted.crossJoin(F.broadcast(total)).select("c_mktsegment", place.alias("place"), (F.col("n") / F.col("total")).alias("share"))
    return playlist.integer_percents(rows, "share").select("c_mktsegment", "percent")


def _arrivals(t: Tables):
    return t.read("events").select("event_type", F.col("event_id").alias("id"), F.col("ts").alias("seen_at"))


def anchored_batches(spark, sf_dir):
    found = batches.anchored_batches(_arrivals(Tables(spark, sf_dir)), "event_type")
    return found.select("event_type", "batch", "run_at", "n", F.array_min("ids").alias("first_id"))


def batch_merge(spark, sf_dir):
    events = Tables(spark, sf_dir).read("events")
    by = lambda kind, shift: events.where(F.col("event_type") == kind).groupBy((F.col("user_id") + shift).alias("u")).agg(F.max("ts").alias("run_at"), F.array_sort(F.collect_set(F.floor("value"))).alias("review_ids")).drop("u")
    return batches.merge_batches(by("click", 0), by("view", 1)).select("run_at", F.array_join("review_ids", ",").alias("review_ids"))


def last_wins(spark, sf_dir):
    events = Tables(spark, sf_dir).read("events").select("user_id", "event_id", "event_type", "value")
    return batches.last_wins(events, "user_id", "event_id").select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


def upsert_reviews(spark, sf_dir):
    orders = Tables(spark, sf_dir).read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("first_seen"))
    old, new = orders.where("id % 3 <> 0"), orders.where("id % 2 = 0").withColumn("status", F.lit("new")).withColumn("first_seen", F.lit("2030-01-01").cast("timestamp_ntz"))
    return batches.upsert(old, new, "id", "first_seen")


def favorites_merge(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.read("events").select("user_id", F.floor("value").cast("long").alias("review_id"), F.col("ts").alias("saved_at"), "event_type")
    saved = batches.first_wins(rows.where("event_type = 'click'").drop("event_type"), ["user_id", "review_id"], "saved_at")
    merged = batches.merge_favorites(saved, rows.where("event_type = 'purchase'").drop("event_type"), t.reviews())
    return merged.select("user_id", "review_id", "saved_at")


def incremental_new_ids(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return batches.new_ids(t.read("orders").select(F.col("o_orderkey").alias("id")), t.read("lineitem").select(F.col("l_orderkey").alias("id")), "id", 10)


def missing_runs(spark, sf_dir):
    return batches.gap_runs(Tables(spark, sf_dir).read("lineitem").select(F.col("l_partkey").alias("id")).union(spark.range(3).select((F.col("id") * 100_000_000).alias("id"))), 3)


def _dq_rows(t: Tables):
    rows = t.read("documents").select((F.col("doc_id") - F.when(F.col("doc_id") % 50 == 0, F.col("doc_id") % 100).otherwise(0)).alias("id"), F.concat(F.lit("u"), "doc_id").alias("url"), F.when(F.col("doc_id") % 37 != 0, F.col("source")).alias("artist"), F.col("lang").alias("album"), F.when(F.col("doc_id") % 41 == 0, F.lit("  ")).otherwise(F.col("text")).alias("text"))
    return rows.withColumn("release_year", F.when(F.length("url") % 5 == 0, F.lit(1850)).otherwise(F.lit(1999))).withColumn("rating", (F.col("id") % 17).cast("double"))


def dq_review_stats(spark, sf_dir):
    return quality.review_stats(_dq_rows(Tables(spark, sf_dir)), THIS_YEAR)


def dq_findings(spark, sf_dir):
    return quality.findings(quality.review_stats(_dq_rows(Tables(spark, sf_dir)), THIS_YEAR))


def dq_severity(spark, sf_dir):
    return quality.severity_counts(dq_findings(spark, sf_dir), strict=True)


def dq_coverage(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return quality.coverage(t.read("documents"), t.read("labels"), "doc_id")


def label_buckets(spark, sf_dir):
    return quality.label_buckets(Tables(spark, sf_dir).reviews(), 350)


def tag_to_genre(spark, sf_dir):
    t = Tables(spark, sf_dir)
    tag = F.get(F.array(*map(F.lit, TAGS)), F.substring("p_brand", 7, 9).cast("int"))
    tags = t.read("lineitem").join(t.read("part").select("p_partkey", tag.alias("tag")), F.col("l_partkey") == F.col("p_partkey")).where("tag IS NOT NULL").select(F.col("l_orderkey").alias("review_id"), "tag")
    return genres.genres_from_tags(tags).select("review_id", F.array_join("genres", ",").alias("genres"))


def name_match(spark, sf_dir):
    rows = Tables(spark, sf_dir).read("supplier").select("s_suppkey", F.col("s_name").alias("asked"))
    found = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("The "), F.upper("asked"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.col("asked"), F.lit(" and Friends"))).otherwise(F.reverse("asked"))
    return lookups.matched(rows.withColumn("found", found), "asked", "found", "same").select("s_suppkey", "asked", "found", "same")


def _written_names(t: Tables):
    key, name = F.col("c_custkey"), F.col("c_name")
    return t.read("customer").select(F.when(key % 3 == 0, F.concat(F.lit("The "), F.upper(name))).when(key % 3 == 1, F.concat(name, F.lit(" and Friends"))).otherwise(F.reverse(name)).alias("text"))


def name_pairs(spark, sf_dir):
    """Customers' names and other ways in which they are written, met by an index of their words."""
    t = Tables(spark, sf_dir)
    return name_index.same_artists(t.read("customer").select(F.col("c_name").alias("name")), _written_names(t), "name", "text")


def names_in_texts(spark, sf_dir):
    """Nations' names that stand in names of suppliers' pictures."""
    t = Tables(spark, sf_dir)
    titles = t.read("supplier").join(t.read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat("s_name", F.lit(" "), F.when(F.col("s_suppkey") % 3 == 0, F.lower("n_name")).when(F.col("s_suppkey") % 3 == 1, F.col("n_name")).otherwise(F.reverse("n_name"))).alias("text"))
    return name_index.names_in_texts(t.read("nation").select(F.col("n_name").alias("name")), titles)


def _images(t: Tables):
    key = F.col("c_custkey")
    rows = t.read("customer").select("c_custkey", F.col("c_name").alias("artist"), F.when(key % 2 == 0, F.concat(F.lit("mb"), "c_custkey")).alias("mbid"), F.when(key % 3 == 0, "group").alias("artist_type"), F.get(F.array(*map(F.lit, ("wikidata_p18", "commons_search", "member_fallback"))), (key % 3).cast("int")).alias("source"))
    context = F.concat("artist", F.get(F.array(*map(F.lit, (" band on stage", " stadium", " at the arena, concert", " portrait", " of the Indie Duo, live music"))), (key % 5).cast("int")))
    return rows.withColumns({"file": F.concat(F.lit("File:"), "artist", F.lit(" live.jpg")), "context": context, "categories": F.when(key % 7 == 0, F.lit("Maps of towns")), "disambiguation": F.when(key % 4 == 0, "indie duo").when(key % 4 == 1, "folk trio")})


def image_confidence(spark, sf_dir):
    images = _images(Tables(spark, sf_dir)).withColumn("name_matches", names.picture_shows_udf("artist", "file", "context"))
    hinted = lookups.matched(images, "disambiguation", "context", "hint_matches", names.stands_in_udf)
    return names.image_confidence(hinted).select("c_custkey", "score", "threshold", "accepted")


def image_targets(spark, sf_dir):
    return names.image_targets(Tables(spark, sf_dir).metadata())


def html_pages(spark, sf_dir):
    return pages.page_headings(Tables(spark, sf_dir).read("pages"))


_POOL = f"""{ranking_queries._ARCHIVE}, top AS (SELECT *, row_number() OVER (ORDER BY {ranking_queries._ORDER}) - 1 AS place FROM archive),
    pool AS (SELECT *, CASE WHEN sum(greatest(0, overall_score)) OVER () > 0 THEN greatest(0, overall_score) / sum(greatest(0, overall_score)) OVER () ELSE 1.0::DOUBLE / count(*) OVER () END AS w1 FROM top),
    amplified AS (SELECT *, w1 ** {EXPONENT} / sum(w1 ** {EXPONENT}) OVER () AS weight FROM pool)"""
_SLOTS = f"""{_POOL}, cut AS (SELECT *, round({TARGET} * weight, 9) AS ideal, floor(round({TARGET} * weight, 9))::BIGINT AS floor_slots FROM amplified),
    slots AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY round(ideal - floor_slots, 9) DESC, place DESC) <= {TARGET} - (SELECT sum(floor_slots) FROM cut) THEN 1 ELSE 0 END::BIGINT AS extra FROM cut)"""
_CLEAN = r"trim(regexp_replace(regexp_replace(lower({}), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_KEY = f"{_CLEAN.format('artist')} || '::' || {_CLEAN.format('title')}"
_DQ = """rows AS (SELECT doc_id - CASE WHEN doc_id % 50 = 0 THEN doc_id % 100 ELSE 0 END AS id, 'u' || doc_id AS url, CASE WHEN doc_id % 37 <> 0 THEN source END AS artist, lang AS album,
    CASE WHEN doc_id % 41 = 0 THEN '  ' ELSE text END AS text, CASE WHEN length('u' || doc_id) % 5 = 0 THEN 1850 ELSE 1999 END AS release_year FROM documents),
    full_rows AS (SELECT *, (id % 17)::DOUBLE AS rating, length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS n FROM rows),
    stats AS (SELECT count(*) AS n_rows, count(id) AS n_valid, count(*) FILTER (id IS NOT NULL AND n = 0) AS n_empty_text, count(*) FILTER (id IS NOT NULL AND n > 0 AND n < 50) AS n_short_text,
    count(*) FILTER (release_year < 1900 OR release_year > 2027) AS n_year_outlier, count(*) FILTER (rating < 0 OR rating > 15) AS n_rating_outlier,
    count(*) FILTER (id IS NULL OR url IS NULL OR artist IS NULL OR trim(artist) = '' OR album IS NULL OR n = 0) AS n_missing_field,
    (SELECT count(*) FROM (SELECT id FROM rows GROUP BY 1 HAVING count(*) > 1)) AS n_duplicate_ids FROM full_rows)"""
_FOUND = """found AS (SELECT code, severity, n FROM (
    SELECT 'REVIEWS_DUPLICATE_ID' AS code, 'error' AS severity, n_duplicate_ids AS n, n_duplicate_ids > 0 AS fires FROM stats
    UNION ALL SELECT 'REVIEWS_ZERO_VALID', 'error', n_rows, n_rows > 0 AND n_valid = 0 FROM stats
    UNION ALL SELECT 'REVIEWS_EMPTY_TEXT_RATE', 'warning', n_empty_text, n_empty_text / greatest(n_valid, 1) > 0.01 FROM stats
    UNION ALL SELECT 'REVIEWS_SHORT_TEXT_RATE', 'warning', n_short_text, n_short_text / greatest(n_valid, 1) > 0.01 FROM stats
    UNION ALL SELECT 'REVIEWS_RELEASE_YEAR_OUTLIER', 'warning', n_year_outlier, n_year_outlier > 0 FROM stats
    UNION ALL SELECT 'REVIEWS_RATING_OUTLIER', 'warning', n_rating_outlier, n_rating_outlier > 0 FROM stats
    UNION ALL SELECT 'REVIEWS_MISSING_REQUIRED_FIELDS', 'warning', n_missing_field, n_missing_field > 0 FROM stats) WHERE fires)"""


def _tag_sql() -> str:
    token = r"trim(regexp_replace(replace(translate(lower(trim(tag)), '/;,+|&', '      '), ' and ', ' '), '\s+', ' ', 'g'))"
    style = " AND ".join([r"NOT regexp_matches(token, '\b(19|20)\d{2}\b')", f"token NOT IN ({', '.join(repr(x) for x in NO_STYLES)})", *(f"NOT contains(token, {x!r})" for x in NO_STYLE_PARTS)])
    found = ", ".join(f"CASE WHEN regexp_matches(token, '\\b(?:{form})\\b') THEN '{g}' END" for g, form in GENRES.items())
    tags = ", ".join(f"({i}, '{x}')" for i, x in enumerate(TAGS))
    return f"""WITH t(i, tag) AS (VALUES {tags}), k AS (SELECT i, {token} AS token FROM t), g AS (SELECT i, unnest([{found}]) AS genre FROM k WHERE {style}),
        a AS (SELECT DISTINCT l_orderkey AS review_id, CAST(substr(p_brand, 7) AS INT) AS i FROM lineitem JOIN part ON l_partkey = p_partkey)
        SELECT review_id, coalesce(string_agg(DISTINCT genre, ',' ORDER BY genre), '') AS genres FROM a JOIN t USING (i) LEFT JOIN g USING (i) GROUP BY 1"""


_U = "(((({x}) % 1000003) * 2654435761 + {s}) % 1000003 + 0.5::DOUBLE) / 1000003"
_CAPS = lambda steps: "CASE " + " ".join(f"WHEN nth <= {n} THEN {cap}" for n, cap in steps) + " ELSE 1 END::BIGINT"
_TRACKS = "listed AS (SELECT review_id * 1000 + number AS position, artist, title FROM tracks JOIN reviews USING (review_id))"

SQL = {
    "album_weights": f"{_POOL} SELECT place, review_id, round(weight, 9) AS weight FROM amplified",
    "stratified_slots": f"{_SLOTS} SELECT place, review_id, floor_slots, extra, floor_slots + extra AS quota, round(ideal, 6) AS ideal FROM slots",
    "graduated_caps": f"""{_POOL}, n AS (SELECT *, row_number() OVER (ORDER BY round(w1, 9) DESC, place) - 1 AS nth FROM pool)
        SELECT place, review_id, {_CAPS(((1, 4), (3, 3), (7, 2)))} AS deep, {_CAPS(((2, 3), (11, 2)))} AS balanced FROM n""",
    "weighted_sample": f"{_POOL} SELECT row_number() OVER (ORDER BY draw DESC, review_id) AS nth, review_id, round(draw, 6) AS draw FROM (SELECT review_id, ln({_U.format(x='review_id', s=SEED)}) / round(w1, 9) AS draw FROM pool WHERE round(w1, 9) > 0) QUALIFY nth <= 10",
    "weighted_draws": f"""WITH p AS (SELECT o_orderkey AS review_id, round(CASE WHEN o_orderkey >= 60 THEN -1 WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey / 100 END, 6)::DOUBLE AS w FROM orders), v AS (SELECT * FROM p WHERE w > 0 OR (SELECT max(w) FROM p) = 0),
        f AS (SELECT row_number() OVER (ORDER BY ln({_U.format(x="review_id", s=SEED)}) / w DESC, review_id) AS nth, review_id, round(ln({_U.format(x="review_id", s=SEED)}) / w, 6) AS draw FROM v QUALIFY nth <= 90),
        c AS (SELECT review_id, sum(w) OVER (ORDER BY review_id) AS high, sum(w) OVER (ORDER BY review_id) - w AS low, sum(w) OVER () AS total FROM v), n AS (SELECT count(*) AS n FROM v),
        e AS (SELECT nth, {_U.format(x="nth", s=SEED + 1)} AS u FROM n, range(1, 91) r(nth) WHERE nth > n)
        SELECT * FROM f UNION ALL SELECT nth, review_id, NULL FROM e JOIN c ON u * total >= low AND u * total < high""",
    "track_candidates": f"{with_views('tracks', 'reviews')} SELECT review_id, number, CASE WHEN is_highlight THEN 'highlight' ELSE 'fallback' END AS source, {_KEY} AS key FROM tracks JOIN reviews USING (review_id)",
    "playlist_export": f'''{with_views("tracks", "reviews")}, {_TRACKS} SELECT position, '"' || artist || ', ""live""",' || title AS line FROM listed''',
    "playlist_text": f"{with_views('tracks', 'reviews')}, {_TRACKS} SELECT position, artist || ' - ' || title AS line FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY position) AS nth FROM listed) WHERE nth = 1",
    "integer_percents": """WITH c AS (SELECT c_mktsegment, round(100 * (count(*) / sum(count(*)) OVER ()), 9) AS ideal, ascii(c_mktsegment) * 256 + length(c_mktsegment) AS place FROM customer GROUP BY 1)
        SELECT c_mktsegment, floor(ideal)::BIGINT + CASE WHEN row_number() OVER (ORDER BY round(ideal - floor(ideal), 9) DESC, place DESC) <= 100 - (SELECT sum(floor(ideal)) FROM c) THEN 1 ELSE 0 END AS percent FROM c""",
    "anchored_batches": """WITH RECURSIVE e AS (SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
        b(event_type, k, start, batch) AS (SELECT event_type, k, ts, 0::BIGINT FROM e WHERE k = 1 UNION ALL SELECT e.event_type, e.k, CASE WHEN e.ts - b.start > INTERVAL 3 HOUR THEN e.ts ELSE b.start END,
        b.batch + CASE WHEN e.ts - b.start > INTERVAL 3 HOUR THEN 1 ELSE 0 END FROM b JOIN e ON e.event_type = b.event_type AND e.k = b.k + 1)
        SELECT event_type, batch, max(ts) AS run_at, count(*) AS n, min(event_id) AS first_id FROM b JOIN e USING (event_type, k) GROUP BY 1, 2""",
    "batch_merge": """WITH s AS (SELECT event_type, user_id, max(ts) AS run_at, string_agg(DISTINCT floor(value)::BIGINT::VARCHAR, ',' ORDER BY floor(value)::BIGINT::VARCHAR) AS t, list_sort(list(DISTINCT floor(value)::BIGINT)) AS ids
        FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2) SELECT run_at, array_to_string(ids, ',') AS review_ids FROM s WHERE event_type = 'click' OR ids NOT IN (SELECT ids FROM s WHERE event_type = 'click')""",
    "last_wins": "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "upsert_reviews": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS status,
        CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate ELSE TIMESTAMP '2030-01-01' END AS first_seen FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0""",
    "favorites_merge": """WITH r AS (SELECT user_id, floor(value)::BIGINT AS review_id, ts AS saved_at, event_type FROM events), s AS (SELECT user_id, review_id, min(saved_at) AS saved_at FROM r WHERE event_type = 'click' GROUP BY 1, 2)
        SELECT * FROM s UNION ALL SELECT user_id, review_id, min(saved_at) FROM r WHERE event_type = 'purchase' AND review_id IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)
        AND (user_id, review_id) NOT IN (SELECT (user_id, review_id) FROM s) GROUP BY 1, 2""",
    "incremental_new_ids": "SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey >= 10 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "missing_runs": """SELECT p + 1 AS first, id - 1 AS last, id - p - 1 AS missing FROM (SELECT id, lag(id) OVER (ORDER BY id) AS p FROM (SELECT DISTINCT l_partkey AS id FROM lineitem UNION SELECT range * 100000000 FROM range(3))) WHERE id - p - 1 >= 3""",
    "dq_review_stats": f"WITH {_DQ} SELECT * FROM stats",
    "dq_findings": f"WITH {_DQ}, {_FOUND} SELECT * FROM found",
    "dq_severity": f"WITH {_DQ}, {_FOUND} SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS exit_code FROM found",
    "dq_coverage": """WITH m AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), c AS (SELECT count(DISTINCT doc_id) AS n_reviews, (SELECT count(*) FROM m) AS n_missing FROM documents)
        SELECT n_reviews, n_missing, n_missing / greatest(n_reviews, 1) AS rate, n_missing / greatest(n_reviews, 1) > 0.5 AS too_low, (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM m ORDER BY doc_id LIMIT 15)) AS sample_ids FROM c""",
    "label_buckets": f"{with_views('reviews')} SELECT label, count(*) AS n, count(*) > 350 AS frequent FROM reviews WHERE label IS NOT NULL GROUP BY 1",
    "tag_to_genre": _tag_sql(),
    "name_pairs": "SELECT c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'The ' || upper(c_name) ELSE c_name || ' and Friends' END AS text FROM customer WHERE c_custkey % 3 < 2",
    "image_targets": f"""{with_views("metadata")}, k AS (SELECT coalesce(nullif(trim(mbid), ''), 'name:' || lower(trim(artist))) AS lookup_key, * FROM metadata),
        n AS (SELECT lookup_key, arg_min(trim(artist), review_id) AS artist, count(*) AS review_count FROM k GROUP BY 1), g AS (SELECT lookup_key, string_agg(DISTINCT genre, ',' ORDER BY genre) AS genres FROM (SELECT lookup_key, unnest(genres) AS genre FROM k) GROUP BY 1)
        SELECT lookup_key, artist, coalesce(genres, '') AS genres, review_count FROM n LEFT JOIN g USING (lookup_key)""",
}

QUERIES = {
    f.__name__: f
    for f in (
        album_weights, stratified_slots, graduated_caps, weighted_sample, weighted_draws, track_candidates, playlist_fill, playlist_export, playlist_text, integer_percents, anchored_batches, batch_merge, last_wins, upsert_reviews,
        favorites_merge, incremental_new_ids, missing_runs, dq_review_stats, dq_findings, dq_severity, dq_coverage, label_buckets, tag_to_genre, name_match, name_pairs, names_in_texts, image_confidence, image_targets, html_pages,
    )
}
