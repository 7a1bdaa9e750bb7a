"""Queries that write domain documents, logs and pages to the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from groovemill.operators import batches, genres, pages, quality
from groovemill.plans import album_queries, graph_queries, taste_queries
from groovemill.sources import documents, jsonl, sample_corpus, versions
from groovemill.sources.checkpoints import checkpointed, shared_folder
from groovemill.sources.domain import Tables, with_views

NOW = "2030-01-01 00:00:00"


def _path(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def memberships_document(spark, sf_dir):
    path = _path(spark, "memberships")
    documents.write_memberships(Tables(spark, sf_dir).memberships(), path)
    return documents.read_memberships(spark, path)


def affinities_document(spark, sf_dir):
    path = _path(spark, "affinities")
    documents.write_affinities(graph_queries._affinities(Tables(spark, sf_dir)), path)
    return documents.read_affinities(spark, path).select("review_id", "community", F.round("share", 6).alias("share"))


def communities_document(spark, sf_dir):
    t, path = Tables(spark, sf_dir), _path(spark, documents.res_file(10))
    sizes = t.memberships().groupBy("community").agg(F.count("*").alias("size"))
    documents.write_communities(taste_queries._communities(t).join(sizes, "community"), path, 10)
    return documents.read_communities(spark, path, strict=True).select("community", "centroid", "size", F.array_join("top_artists", ",").alias("top_artists"), "resolution")


def labels_document(spark, sf_dir):
    path = _path(spark, "labels")
    documents.write_labels(taste_queries._community_labels(Tables(spark, sf_dir)), path)
    return documents.read_labels(spark, path)


def categories_document(spark, sf_dir):
    path = _path(spark, "categories")
    documents.write_categories(taste_queries._categories(Tables(spark, sf_dir)), path)
    return documents.read_categories(spark, path)


def profiles_document(spark, sf_dir):
    path, metadata = _path(spark, "profiles"), Tables(spark, sf_dir).metadata()
    counts = genres.genre_counts(metadata).groupBy("artist_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("genre", "n")))).alias("genre_counts"))
    documents.write_profiles(genres.artist_profiles(metadata).join(counts, "artist_key"), path)
    read = documents.read_profiles(spark, path)
    return read.select("artist_key", "total_albums", F.array_join("main_genres", ",").alias("main_genres"), F.aggregate(F.map_values("genre_counts"), F.lit(0).cast("long"), lambda a, n: a + n).alias("n_genres"))


def metadata_document(spark, sf_dir):
    imputed, raw = _path(spark, "imputed"), _path(spark, "raw")
    rows = Tables(spark, sf_dir).metadata().select("review_id", "artist", F.col("mbid").alias("artist_mbid"), "genres")
    jsonl.write_jsonl(rows.withColumn("genres", F.array(F.lit("raw"))), raw)
    jsonl.write_jsonl(rows.where("review_id % 2 = 0"), imputed)
    jsonl.write_jsonl(rows.where("review_id % 4 = 0"), imputed, append=True)
    return documents.read_metadata(spark, imputed, raw).select("review_id", "artist_mbid", F.array_join("genres", ",").alias("genres"))


def images_document(spark, sf_dir):
    path, events = _path(spark, "images"), Tables(spark, sf_dir).read("events")
    rows = lambda kind: events.where(F.col("event_type") == kind).select(F.concat(F.lit("mb"), F.col("user_id").cast("string")).alias("artist_mbid"), F.concat(F.lit("Artist "), (F.col("user_id") % 7).cast("string")).alias("artist_name"), F.col("event_type").alias("status"), F.col("ts").alias("fetched_at"))
    old = batches.last_wins(rows("view"), "artist_mbid", "fetched_at").select("artist_mbid", "artist_name", "status", "fetched_at")
    jsonl.write_jsonl(documents.upsert_images(old, rows("click")), path)
    return documents.read_images(spark, path).select("artist_mbid", "artist_name", "status")


def review_documents(spark, sf_dir):
    """Texts in which a decoder has left C1 controls, some blank, one line broken; written as lines and read as typed reviews."""
    path = _path(spark, "reviews")
    rows = Tables(spark, sf_dir).read("documents")
    text = F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.concat(F.lit("\x93"), F.coalesce("text", F.lit(""))))
    lines = F.to_json(F.struct(F.col("doc_id").alias("id"), F.lit("u").alias("url"), F.coalesce("source", F.lit("x")).alias("artist"), F.col("lang").alias("album"), text.alias("text"), F.array(F.col("lang")).alias("labels"), (F.col("doc_id") % 11).alias("rating"), F.array(F.struct(F.lit(1).alias("number"), F.lit("t").alias("title"))).alias("tracklist"), F.create_map(F.lit("k"), F.col("source")).alias("extra")))
    rows.select(F.when(F.col("doc_id") % 13 == 0, "{broken").otherwise(lines).alias("value")).write.text(path)
    return jsonl.read_reviews(spark, path).select("id", "album", "text", "rating", F.size("labels").alias("n_labels"), F.size("tracklist").alias("n_tracks"))


def reviews_saved(spark, sf_dir):
    """Reviews saved as typed lines and read again."""
    path = _path(spark, "saved")
    rows = Tables(spark, sf_dir).read("documents")
    reviews = rows.select(F.col("doc_id").alias("id"), F.concat(F.lit("u"), "doc_id").alias("url"), F.col("source").alias("artist"), F.col("lang").alias("album"), "text", F.when(F.col("doc_id") % 2 == 0, F.array("lang")).alias("labels"), (F.col("n_chars") / 8).alias("rating"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("doc_id") % 9000).cast("int")).alias("release_date"))
    jsonl.write_reviews(reviews, path)
    return jsonl.read_reviews(spark, path).select("id", "url", "artist", "album", F.sha2("text", 256).alias("text_sha256"), F.size("labels").alias("n_labels"), "rating", F.col("release_date").cast("string").alias("release_date"))


def versioned_upsert(spark, sf_dir):
    """Orders committed as a table in versions: those that aren't a third, then an upsert of every second, and a batch that is delivered twice."""
    path = _path(spark, "versioned")
    orders = Tables(spark, sf_dir).read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("first_seen"))
    new = orders.where("id % 2 = 0").withColumn("status", F.lit("new")).withColumn("first_seen", F.lit("2030-01-01").cast("timestamp_ntz"))
    for _ in range(2):
        versions.append(orders.where("id % 3 <> 0"), path, batch=("orders", 0))
    versions.replace(spark, path, lambda known: batches.upsert(known, new, "id", "first_seen"))
    return versions.read(spark, path)


def sample_reviews(spark, sf_dir):
    """The sample corpus as large as the table of orders' keys, read by their bounds, beside each order."""
    orders = Tables(spark, sf_dir).read("orders").select((F.col("o_orderkey") + 1).alias("order_id"), F.col("o_totalprice").alias("price"))
    ends = orders.agg(F.min("order_id").alias("low"), F.max("order_id").alias("high")).first()
    corpus = sample_corpus.read(spark, "reviews", ends["high"] or 0, 8).where(F.col("id") >= (ends["low"] or 0))
    best = sample_corpus.read(spark, "affinities", ends["high"] or 0, 8).where("share > 0.5").select("id", "community")
    return orders.join(corpus, F.col("order_id") == F.col("id")).join(best, "id").select("id", "artist", "album", "release_year", "rating", "community", F.round("price", 2).alias("price"))


def review_ids(spark, sf_dir):
    path = _path(spark, "ids")
    rows = Tables(spark, sf_dir).read("orders").select(F.when(F.col("o_orderkey") % 5 == 0, "[1, 2]").when(F.col("o_orderkey") % 7 == 0, "  ").otherwise(F.format_string('{"id": %d}', F.col("o_orderkey") % 1000)).alias("value"))
    rows.write.text(path)
    return jsonl.read_ids(spark, path, "id")


def log_batches(spark, sf_dir):
    """Log lines of each order month, some without milliseconds, one range reversed."""
    path, t = _path(spark, "log"), Tables(spark, sf_dir)
    months = t.read("orders").groupBy(F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("m")).agg(F.min("o_orderkey").alias("low"), (F.min("o_orderkey") + 40).alias("high"))
    stamp = F.concat(F.date_format("m", "yyyy-MM-dd HH:mm:ss"), F.when(F.month("m") % 2 == 0, ",678").otherwise(""))
    low, high = (F.when(F.month("m") == 5, F.col(a)).otherwise(F.col(b)) for a, b in (("high", "low"), ("low", "high")))
    said = F.concat(stamp, F.lit(" INFO Found 3 new reviews ("), low.cast("string"), F.lit("-"), high.cast("string"), F.lit("). Continuing with enrichment."))
    months.select(F.explode(F.array(said, F.concat(stamp, F.lit(" INFO nothing new")))).alias("value")).write.text(path)
    found = jsonl.read_log_batches(spark, path, t.reviews().where("review_id % 3 <> 0"), F.lit(NOW).cast("timestamp"))
    return found.select(F.date_format("run_at", "yyyy-MM-dd HH:mm:ss.SSS").alias("run_at"), F.array_join("review_ids", ",").alias("review_ids"))


def log_fallback(spark, sf_dir):
    """A log of lines without times: two ranges in one line."""
    path, t = _path(spark, "log"), Tables(spark, sf_dir)
    spark.range(1).select(F.lit("x Found 2 new reviews (1-40). Continuing with enrichment. y Found 1 new reviews (50-45). Continuing with enrichment. Found 3 new reviews (60-90). Continuing with enrichment.").alias("value")).write.text(path)
    found = jsonl.read_log_batches(spark, path, t.reviews(), F.lit(NOW).cast("timestamp"))
    return found.select(F.date_format("run_at", "yyyy-MM-dd HH:mm:ss").alias("run_at"), F.array_join("review_ids", ",").alias("review_ids"))


def batch_append(spark, sf_dir):
    """Batches of each order day written and read in order; the last one again, with ids repeated and turned around, adds none, another one does."""
    path, t = _path(spark, "batches"), Tables(spark, sf_dir)
    days = t.read("orders").groupBy(F.to_date("o_orderdate").cast("timestamp").alias("run_at")).agg(F.array_sort(F.collect_set("o_orderkey")).alias("review_ids"))
    jsonl.write_jsonl(days, path)
    stored = jsonl.read_batches(spark, path)
    latest = checkpointed(stored.orderBy(F.col("run_at").desc()).limit(1))
    again = latest.select(F.lit(NOW).cast("timestamp").alias("run_at"), F.concat(F.reverse("review_ids"), F.col("review_ids")).alias("review_ids"))
    other = latest.select(F.lit(NOW).cast("timestamp").alias("run_at"), F.array(F.lit(3), F.lit(1), F.lit(3)).cast("array<long>").alias("review_ids"))
    appended = batches.append_batch(batches.append_batch(stored, again), other)
    return appended.select(F.date_format("run_at", "yyyy-MM-dd").alias("day"), F.array_join("review_ids", ",").alias("review_ids"))


def favorites_list(spark, sf_dir):
    rows = Tables(spark, sf_dir).read("events").select("user_id", F.floor("value").cast("long").alias("review_id"), F.col("ts").alias("saved_at"), "event_type")
    saved = batches.first_wins(rows.where("event_type = 'click'").drop("event_type"), ["user_id", "review_id"], "saved_at")
    left = batches.remove_favorites(saved, rows.where("event_type = 'view'"))
    return batches.listed_favorites(left).select("user_id", "review_id", "place")


def favorites_inserted(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.read("events").select("user_id", F.floor("value").cast("long").alias("review_id"), F.col("ts").alias("saved_at"), "event_type")
    saved = batches.first_wins(rows.where("event_type = 'click'").drop("event_type"), ["user_id", "review_id"], "saved_at")
    return batches.inserted_counts(saved, batches.merge_favorites(saved, rows.where("event_type = 'purchase'").drop("event_type"), t.reviews()))


def next_ids(spark, sf_dir):
    existing = Tables(spark, sf_dir).read("lineitem").select(F.col("l_partkey").alias("id"))
    top = existing.agg(F.max("id")).first()[0]
    return batches.next_ids(existing, "id", 1, top + 50).withColumn("mode", F.lit("range")).union(batches.next_ids(existing, "id", None, top + 5).withColumn("mode", F.lit("resume")))


def metadata_modes(spark, sf_dir):
    rows = Tables(spark, sf_dir).metadata().select("review_id", "mbid")
    old, new = rows.where("review_id % 2 = 0").withColumn("mbid", F.lit("old")), rows.where("review_id % 3 = 0")
    new = new.union(new.where("review_id % 5 = 0"))
    modes = [batches.written(old, new, "review_id", m).withColumn("mode", F.lit(m)) for m in ("overwrite", "update", "append")]
    return modes[0].union(modes[1]).union(modes[2])


def _dq_files(spark, sf_dir):
    """Reviews and metadata as lines, some of them broken, and exports of which one is missing and one has no line."""
    t = Tables(spark, sf_dir)
    reviews, metadata, empty = _path(spark, "dq-reviews"), _path(spark, "dq-metadata"), _path(spark, "dq-empty")
    rows = album_queries._dq_rows(t)
    rows.select(F.when(F.col("url") == "u13", "[]").otherwise(F.to_json(F.struct("id", "url", "artist", "album", "text", "release_year", "rating"))).alias("value")).write.text(reviews)
    labels = t.read("labels").select(F.when(F.col("doc_id") % 17 == 0, '{"review_id": "x"}').otherwise(F.format_string('{"review_id": %d}', F.col("doc_id") - F.when(F.col("doc_id") % 100 == 0, 1).otherwise(0))).alias("value"))
    labels.write.text(metadata)
    spark.createDataFrame([], "value string").write.text(empty)
    return reviews, metadata, empty


def _dq_all(spark, sf_dir):
    reviews, metadata, empty = _dq_files(spark, sf_dir)
    lines = checkpointed(jsonl.read_jsonl(spark, reviews, "id long, url string, artist string, album string, text string, release_year string, rating string"))
    rows = jsonl.valid(lines)
    missing = jsonl.count_lines(spark, metadata) < 0
    meta = checkpointed(jsonl.read_jsonl(spark, metadata, "review_id long"))
    return (
        quality.findings(quality.review_stats(rows, album_queries.THIS_YEAR))
        .union(quality.findings(quality.file_stats(lines, F.col(jsonl.CORRUPT).isNull(), False), quality.REVIEW_FILE_RULES))
        .union(quality.findings(quality.metadata_stats(meta, rows, missing), quality.METADATA_RULES))
        .union(quality.artifact_findings({"community_memberships": jsonl.count_lines(spark, empty), "album_community_affinities": jsonl.count_lines(spark, f"{empty}-none")}, spark))
    )


def dq_all(spark, sf_dir):
    return _dq_all(spark, sf_dir)


def dq_report(spark, sf_dir):
    path = _path(spark, "report")
    documents.write_report(_dq_all(spark, sf_dir), path, {"strict": "true"})
    return documents.read_report(spark, path)


#: A review page in the layout of saved pages, with places for a document's fields.
_PAGE = (
    '<html><body><div id="rezension"><div class="headerbox"><p>nothing</p></div><div class="headerbox"><h1>{artist} - {album}</h1><p>{labels}<br>VÖ: {day}</p>'
    '<p class="bewertung b8">Unsere Bewertung: <strong>{rating}/10</strong></p><p class="bewertung b7">Eure Ø-Bewertung: <strong>7/10</strong></p></div>'
    '<div id="rezitext"><h2>{title}</h2><p class="autor">(<a href="#">{author}</a>)</p><p>First <b>paragraph</b></p><p> </p><p>{body}</p></div>'
    '<div id="rezihighlights"><ul><li>song two</li><li>Song 3</li></ul></div>'
    '<div id="rezitracklist"><p>Gesamtspielzeit: 45:00 min.</p><ul><li>CD 1<ol><li>Song One</li><li>Song Two</li></ol></li><li><ol><li>Song 3</li></ol></li></ul></div>'
    '<div id="reziref"><h4>Referenzen</h4><p><a href="#">{ref}</a>; <a href="#">Wilco</a>; <a href="#">WILCO</a>;</p></div></div></body></html>'
)


def _words(text: str):
    """The letters and digits of a whole text, one space between runs of them."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", " "))


def _pages(t: Tables):
    d = F.col("doc_id")
    day = F.when(d % 3 == 0, F.format_string("%02d.%02d.%d", d % 28 + 1, d % 12 + 1, d % 30 + 1990)).when(d % 3 == 1, (d % 30 + 1990).cast("string")).otherwise("31.02.2001")
    fields = {
        "artist": F.when(d % 10 == 7, "").otherwise(F.concat(F.lit("Band "), (d % 50).cast("string"))),
        "album": F.concat(F.when(d % 10 == 7, "Record ").otherwise("Record - "), d.cast("string")),
        "labels": F.when(d % 2 == 0, "Sony / Sub Label, Partner; Other").otherwise("Own"),
        "day": day,
        "rating": F.when(d % 2 == 0, "7,5").otherwise((d % 10).cast("string")),
        "title": F.concat(F.lit("Title "), d.cast("string")),
        "author": F.concat(F.lit("Author "), (d % 7).cast("string")),
        "body": F.concat(F.lit("Body "), d.cast("string"), F.lit(" "), _words("text")),
        "ref": F.when(d % 4 == 0, "wilco").otherwise(F.concat(F.lit("Ref "), (d % 5).cast("string"))),
    }
    parts, rest = [], _PAGE
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), fields[name]]
    html = F.concat(*parts, F.lit(rest))
    return t.read("documents").select(d.alias("page_id"), F.when(d % 11 == 5, "<html><body>no review</body></html>").otherwise(html).alias("html"))


def html_reviews(spark, sf_dir):
    found = pages.parse_reviews(_pages(Tables(spark, sf_dir)))
    tracks = F.array_join(F.transform("tracks", lambda x: F.concat_ws(":", x["number"], x["title"], x["is_highlight"])), "|")
    listed = [F.array_join(c, "|").alias(c) for c in ("labels", "highlights", "refs")]
    return found.select("page_id", "artist", "album", *listed, F.col("release_date").cast("string").alias("release_date"), "release_year", "rating", "user_rating", "title", "author", "text", tracks.alias("tracks"), "total_duration")


_META_LINES = """ml AS (SELECT CASE WHEN doc_id % 17 <> 0 THEN doc_id - CASE WHEN doc_id % 100 = 0 THEN 1 ELSE 0 END END AS review_id FROM labels)"""


def _dq_sql() -> str:
    dq = album_queries._DQ.replace("FROM documents)", "FROM documents WHERE doc_id <> 13)")
    return f"""{dq}, {album_queries._FOUND}, {_META_LINES}, ids AS (SELECT DISTINCT id FROM rows WHERE id IS NOT NULL), m AS (SELECT (SELECT count(*) FROM ml WHERE review_id IS NULL) AS n_invalid,
        (SELECT count(*) FROM (SELECT review_id FROM ml WHERE review_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS n_twice, (SELECT count(*) FROM ids) AS n_reviews, (SELECT count(*) FROM ids WHERE id NOT IN (SELECT review_id FROM ml WHERE review_id IS NOT NULL)) AS n_missing),
        every AS (SELECT * FROM found UNION ALL SELECT 'REVIEWS_INVALID_JSON_LINES', 'warning', count(*) FROM documents WHERE doc_id = 13 HAVING count(*) > 0
        UNION ALL SELECT 'METADATA_DUPLICATE_REVIEW_ID', 'error', n_twice FROM m WHERE n_twice > 0 UNION ALL SELECT 'METADATA_INVALID_LINES', 'warning', n_invalid FROM m WHERE n_invalid > 0
        UNION ALL SELECT 'METADATA_COVERAGE_LOW', 'warning', n_missing FROM m WHERE n_missing / greatest(n_reviews, 1) > 0.5
        UNION ALL VALUES ('ARTIFACT_COMMUNITY_MEMBERSHIPS_EMPTY', 'error', 0), ('ARTIFACT_ALBUM_COMMUNITY_AFFINITIES_MISSING', 'error', 0))"""


_FAVORITES = """r AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS review_id, ts AS saved_at, event_type FROM events), s AS (SELECT user_id, review_id, min(saved_at) AS saved_at FROM r WHERE event_type = 'click' GROUP BY 1, 2)"""
_MONTHS = """months AS (SELECT date_trunc('month', o_orderdate) AS m, min(o_orderkey) AS low, min(o_orderkey) + 40 AS high FROM orders GROUP BY 1)"""

SQL = {
    "memberships_document": f"{with_views('memberships')} SELECT artist, community FROM memberships",
    "affinities_document": f"{with_views('affinities')} SELECT review_id, community, round(share, 6) AS share FROM affinities",
    "communities_document": f"""{with_views("edges", "memberships")}, {graph_queries._DEGREES}, tops AS (SELECT community, artist, row_number() OVER (PARTITION BY community ORDER BY round(coalesce(degree, 0), 9) DESC, artist) AS place FROM memberships LEFT JOIN degrees USING (artist))
        SELECT community, max(artist) FILTER (place = 1) AS centroid, count(*) AS size, string_agg(artist, ',' ORDER BY place) FILTER (place <= 8) AS top_artists, 10.0::DOUBLE AS resolution FROM tops GROUP BY 1""",
    "labels_document": f"WITH {taste_queries._LABEL_SQL} SELECT community, label FROM own_labels",
    "categories_document": f"WITH {taste_queries._CATEGORY_SQL} SELECT community, category FROM categories",
    "profiles_document": f"""{with_views("metadata")}, {graph_queries._PROFILES}, n AS (SELECT artist_key, CAST(sum(n) AS BIGINT) AS n_genres FROM counts GROUP BY 1)
        SELECT artist_key, total_albums, main_genres, n_genres FROM profiles JOIN n USING (artist_key) JOIN (SELECT {graph_queries._KEY} AS artist_key, count(DISTINCT review_id) AS total_albums FROM metadata GROUP BY 1) USING (artist_key)""",
    "metadata_document": f"{with_views('metadata')} SELECT review_id, mbid AS artist_mbid, array_to_string(genres, ',') AS genres FROM metadata WHERE review_id % 2 = 0",
    "images_document": """WITH l AS (SELECT user_id, arg_max(event_type, (event_type = 'click', ts)) AS status FROM events WHERE event_type IN ('view', 'click') GROUP BY 1) SELECT 'mb' || user_id AS artist_mbid, 'Artist ' || user_id % 7 AS artist_name, status FROM l""",
    "review_documents": """SELECT doc_id AS id, lang AS album, '“' || translate(coalesce(text, ''), chr(146), '’') AS text, (doc_id % 11)::DOUBLE AS rating, 1 AS n_labels, 1 AS n_tracks FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 13 <> 0""",
    "reviews_saved": """SELECT doc_id AS id, 'u' || doc_id AS url, source AS artist, lang AS album, sha256(text) AS text_sha256, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS n_labels, n_chars / 8 AS rating,
        CAST(DATE '2000-01-01' + (doc_id % 9000)::INT AS DATE)::VARCHAR AS release_date FROM documents WHERE regexp_matches(coalesce(text, ''), '[^\\s]')""",
    "sample_reviews": """WITH o AS (SELECT o_orderkey + 1 AS id, o_totalprice FROM orders) SELECT id, printf('Sample Artist %02d', id * 31 % 97) AS artist, 'Album ' || id AS album, (1997 + id * 7 % 27)::INT AS release_year, 5 + (id % 11) / 2 AS rating,
        printf('C%03d', id % 4 + 1) AS community, round(o_totalprice, 2) AS price FROM o""",
    "versioned_upsert": album_queries.SQL["upsert_reviews"],
    "review_ids": "SELECT DISTINCT o_orderkey % 1000 AS id FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0",
    "log_batches": f"""{with_views("reviews")}, {_MONTHS} SELECT strftime(m, '%Y-%m-%d %H:%M:%S') || CASE WHEN month(m) % 2 = 0 THEN '.678' ELSE '.000' END AS run_at, string_agg(DISTINCT review_id, ',' ORDER BY review_id) AS review_ids
        FROM months JOIN reviews ON review_id BETWEEN low AND high WHERE month(m) <> 5 AND review_id % 3 <> 0 GROUP BY m""",
    "log_fallback": f"""{with_views("reviews")} SELECT '{NOW}' AS run_at, string_agg(DISTINCT review_id, ',' ORDER BY review_id) AS review_ids FROM (VALUES (1, 40), (60, 90)) v(low, high) JOIN reviews ON review_id BETWEEN low AND high GROUP BY low""",
    "batch_append": f"""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey FROM orders) SELECT strftime(day, '%Y-%m-%d') AS day, string_agg(DISTINCT o_orderkey, ',' ORDER BY o_orderkey) AS review_ids FROM d GROUP BY d.day
        UNION ALL SELECT '{NOW[:10]}', '3,1'""",
    "favorites_list": f"""WITH {_FAVORITES} SELECT user_id, review_id, row_number() OVER (PARTITION BY user_id ORDER BY saved_at DESC, review_id DESC) AS place FROM s WHERE (user_id, review_id) NOT IN (SELECT (user_id, review_id) FROM r WHERE event_type = 'view')""",
    "favorites_inserted": f"""{with_views("reviews")}, {_FAVORITES} SELECT user_id, count(DISTINCT review_id) AS inserted FROM r WHERE event_type = 'purchase' AND review_id IN (SELECT review_id FROM reviews) AND (user_id, review_id) NOT IN (SELECT (user_id, review_id) FROM s) GROUP BY 1""",
    "next_ids": """WITH e AS (SELECT DISTINCT l_partkey AS id FROM lineitem), t AS (SELECT max(id) AS top FROM e) SELECT id, 'range' AS mode FROM t, range(1, top + 51) r(id) WHERE id NOT IN (SELECT id FROM e) UNION ALL SELECT top + k, 'resume' FROM t, range(1, 6) r(k)""",
    "metadata_modes": f"""{with_views("metadata")}, n AS (SELECT review_id, mbid FROM metadata WHERE review_id % 3 = 0), o AS (SELECT review_id, 'old' AS mbid FROM metadata WHERE review_id % 2 = 0) SELECT *, 'overwrite' AS mode FROM n
        UNION ALL SELECT *, 'update' FROM n UNION ALL SELECT *, 'update' FROM o WHERE review_id % 3 <> 0 UNION ALL SELECT *, 'append' FROM o UNION ALL SELECT *, 'append' FROM n WHERE review_id % 2 <> 0""",
    "dq_all": f"WITH {_dq_sql()} SELECT code, severity, n FROM every",
    "dq_report": f"WITH {_dq_sql()} SELECT code, severity, n, count(*) FILTER (severity = 'error') OVER () AS error_count, count(*) FILTER (severity = 'warning') OVER () AS warning_count FROM every",
    "html_reviews": """SELECT doc_id AS page_id, 'Band ' || doc_id % 50 AS artist, 'Record - ' || doc_id AS album, CASE WHEN doc_id % 2 = 0 THEN 'Sony|Sub Label|Partner|Other' ELSE 'Own' END AS labels, 'song two|Song 3' AS highlights,
        CASE WHEN doc_id % 4 = 0 THEN 'wilco' ELSE 'Ref ' || doc_id % 5 || '|Wilco' END AS refs, CASE WHEN doc_id % 3 = 0 THEN printf('%04d-%02d-%02d', doc_id % 30 + 1990, doc_id % 12 + 1, doc_id % 28 + 1) END AS release_date,
        CAST(CASE WHEN doc_id % 3 = 2 THEN 2001 ELSE doc_id % 30 + 1990 END AS INT) AS release_year, CASE WHEN doc_id % 2 = 0 THEN 7.5 ELSE doc_id % 10 END::DOUBLE AS rating, 7.0::DOUBLE AS user_rating, 'Title ' || doc_id AS title, 'Author ' || doc_id % 7 AS author,
        'First paragraph' || chr(10) || chr(10) || trim('Body ' || doc_id || ' ' || trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'))) AS text, '1:Song One:false|2:Song Two:true|3:Song 3:true' AS tracks, '45:00' AS total_duration FROM documents WHERE doc_id % 11 <> 5 AND doc_id % 10 <> 7""",
}

QUERIES = {
    f.__name__: f
    for f in (
        memberships_document, affinities_document, communities_document, labels_document, categories_document, profiles_document, metadata_document, images_document, review_documents, reviews_saved, versioned_upsert, sample_reviews, review_ids,
        log_batches, log_fallback, batch_append, favorites_list, favorites_inserted, next_ids, metadata_modes, dq_all, dq_report, html_reviews,
    )
}
