"""Queries on catalogues' answers: candidates, fields, hit scores, licences, models' answers and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from groovemill.operators import lookups
from groovemill.sources.parts import parts_of
from groovemill.sources.domain import Tables, with_views

TAGS = ("Indie Rock", "hip-hop ", "Electronica", "polka", "post rock", "POP", "shoegaze", "electronic", "black metal", "synthpop", "skiffle")
LICENCES = ("CC BY-SA 4.0", "cc-by 2.0", "CC0", "Public  Domain", "PD-US", "CC BY-NC 2.0", "CC BY-ND 3.0", "All rights reserved", "GFDL", " ", "cc by 3.0, no derivatives")
ANSWERS = (
    'Sure: ["Rock", " pop ", 5, ""]',
    "[]",
    "none",
    'x [\n"Electronic",\n"ROCK"] y',
    '["Jazz"',
    '"Dream Pop"\nand more',
    "  ",
)
CATEGORIES = ("Rock", "Pop", "Electronic")
NOW = "2024-02-15 00:00:00"


def _pick(values, at):
    return F.get(F.array(*map(F.lit, values)), (at % len(values)).cast("int"))


def dict_genres(spark, sf_dir):
    key = F.col("p_partkey")
    tags = F.array(_pick(TAGS, key), F.concat(F.lit(" "), F.upper(_pick(TAGS, key * 7 + 3))), _pick(TAGS, key + 1))
    return Tables(spark, sf_dir).read("part").select("p_partkey", F.array_join(lookups.dict_genres(tags), ",").alias("genres"))


def title_variants(spark, sf_dir):
    title = F.concat(F.lit(" Album...  "), F.col("c_custkey").cast("string"), _pick(("", " (Deluxe) [x]", ": Live  at home", " - Part 2", " (a): b - c", "..."), F.col("c_custkey")))
    return Tables(spark, sf_dir).read("customer").select("c_custkey", F.array_join(lookups.title_variants(title), "|").alias("variants"))


def search_names(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("The "), "c_name")).otherwise(F.col("c_name"))
    aliases = F.when(F.col("c_custkey") % 4 != 0, F.array(F.lit(" "), F.upper("c_name"), F.concat(F.col("c_mktsegment"), F.lit(" "))))
    return Tables(spark, sf_dir).read("customer").select("c_custkey", F.array_join(lookups.search_names(name, aliases), "|").alias("names"))


def _planned(spark, sf_dir):
    artists = Tables(spark, sf_dir).read("supplier").select(
        F.col("s_suppkey").alias("key"),
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("The "), "s_name")).otherwise(F.col("s_name")).alias("artist"),
        F.when(F.col("s_suppkey") % 4 != 0, F.array(F.lit(" "), F.upper("s_name"), F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string"), F.lit(" ")))).alias("aliases"),
        F.when(F.col("s_suppkey") % 5 == 0, " ").when(F.col("s_suppkey") % 5 < 3, F.concat(F.lit(" trio of "), F.col("s_nationkey").cast("string"))).when(F.col("s_suppkey") % 5 == 3, "BAND").alias("disambiguation"),
    )
    return lookups.search_plan(artists)


def search_plan(spark, sf_dir):
    return _planned(spark, sf_dir).select("key", F.col("place").cast("long").alias("place"), "query")


def shared_queries(spark, sf_dir):
    return lookups.shared_queries(_planned(spark, sf_dir)).select("query_key", "query", "n_keys", F.col("first_place").cast("long").alias("first_place"))


def _entities(t: Tables):
    name = lambda c: F.struct(F.col(c).alias("name"))
    even = F.col("c_custkey") % 2 == 0
    relation = lambda kind, target, way, who, url: F.struct(kind.alias("type"), target.alias("target-type"), way.alias("direction"), F.struct(who.alias("name")).alias("artist"), F.struct(url.alias("resource")).alias("url"))
    none = F.lit(None).cast("string")
    relations = F.array(
        relation(F.lit("member of band"), F.lit("artist"), F.when(even, "backward").otherwise("forward"), F.col("c_mktsegment"), none),
        relation(F.lit("member of band"), F.lit("artist"), none, F.col("c_name"), none),
        relation(F.lit("member of band"), F.lit("label"), none, F.lit("no artist"), none),
        relation(F.lit("wikidata"), F.lit("url"), none, none, F.when(even, F.concat(F.lit("https://www.wikidata.org/wiki/q"), F.col("c_custkey").cast("string"))).otherwise("nothing")),
    )
    body = F.struct(F.col("c_name").alias("name"), F.when(even, F.concat(F.lit(" "), "c_mktsegment")).alias("disambiguation"), F.array(F.struct(F.lit(" ").alias("name")), name("c_phone")).alias("aliases"), F.array(F.struct(F.concat(F.lit(" "), "c_mktsegment").alias("name")), F.struct(F.lit("").alias("name"))).alias("tags"), relations.alias("relations"))
    return t.read("customer").withColumn("c_phone", F.concat(F.lit("alias "), F.col("c_custkey").cast("string"))).select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 10 == 9, "{broken").otherwise(F.to_json(body)).alias("json"))


def entity_fields(spark, sf_dir):
    found = lookups.entity_fields(_entities(Tables(spark, sf_dir)))
    return found.select("key", *(F.array_join(c, "|").alias(c) for c in ("aliases", "tags", "members")), "wikidata_id", "disambiguation")


def best_release_groups(spark, sf_dir):
    customers = Tables(spark, sf_dir).read("customer")
    rows = customers.select("c_name", "c_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seq"))
    fits = (F.col("c_custkey") + F.col("seq")) % 3 == 0
    credit = F.struct(F.when(F.col("seq") % 2 == 0, "").otherwise(F.when(fits, F.upper("c_name")).otherwise("somebody")).alias("name"), F.struct(F.concat(F.lit("mb"), F.col("seq").cast("string")).alias("id"), F.when(fits, F.concat(F.lit("The "), "c_name")).otherwise("nobody").alias("name")).alias("artist"))
    body = F.struct(F.concat_ws("-", F.lit("g"), "c_custkey", "seq").alias("id"), F.lit("title").alias("title"), ((F.col("c_custkey") * 7 + F.col("seq") * 11) % 4).cast("int").alias("score"), F.when(F.col("seq") < 2, "Album").otherwise("Single").alias("primary-type"), F.array(credit).alias("artist-credit"))
    hits = rows.select(F.col("c_name").alias("asked"), "seq", F.to_json(body).alias("json"))
    return lookups.best_release_groups(hits, 4 * parts_of(customers)).select("asked", "id", "artist_mbid", "artist_name", "score")


def validated_mbids(spark, sf_dir):
    key = F.col("c_custkey")
    found = F.when(key % 4 == 0, F.col("c_name")).when(key % 4 == 1, F.concat(F.lit("THE "), F.upper("c_name"))).when(key % 4 == 2, "Nobody At All")
    rows = Tables(spark, sf_dir).read("customer").select("c_custkey", F.col("c_name").alias("asked"), found.alias("name"), F.concat(F.lit("mb"), key.cast("string")).alias("mbid"))
    return lookups.validated_mbids(rows).select("c_custkey", "mbid")


def file_hit_scores(spark, sf_dir):
    key = F.col("c_custkey")
    file = F.concat(F.lit("File:"), F.when(key % 3 == 0, F.replace("c_name", F.lit("#"), F.lit("_"))).when(key % 3 == 1, "Customer").otherwise("Other"), _pick(("_live.jpg", "_logo.png", ".jpg", "_at_the_festival.jpg"), key))
    rows = Tables(spark, sf_dir).read("customer").select("c_custkey", F.when(key % 11 == 0, " ").otherwise(F.col("c_name")).alias("artist"), file.alias("file"))
    return lookups.file_hit_scores(rows).select("c_custkey", F.col("score").cast("long").alias("score"))


def page_hit_scores(spark, sf_dir):
    key = F.col("c_custkey")
    title = F.when(key % 3 == 0, F.col("c_name")).when(key % 3 == 1, "Customer relations").otherwise("Something else")
    snippet = _pick(("an <b>indie band</b> from Ulm", "the stadium of a town", "a disambiguation page", "customer of a band at an arena", "quiet village"), key)
    rows = Tables(spark, sf_dir).read("customer").select("c_custkey", F.array("c_name", F.concat(F.lit("The "), "c_name")).alias("names"), title.alias("title"), snippet.alias("snippet"), F.when(key % 4 == 0, "indie").when(key % 4 == 1, "folk trio").alias("disambiguation"))
    return lookups.page_hit_scores(rows).select("c_custkey", F.col("score").cast("long").alias("score"))


def merged_hits(spark, sf_dir):
    events = Tables(spark, sf_dir).read("events")
    hits = events.select(F.col("user_id").alias("request"), (F.col("event_id") % 8).alias("batch"), F.col("event_id").alias("seq"), F.floor("value").cast("string").alias("title"))
    return lookups.merged_hits(hits)


def licence_texts(spark, sf_dir):
    key = F.col("c_custkey")
    licence = _pick(LICENCES, key)
    return Tables(spark, sf_dir).read("customer").select("c_custkey", lookups.license_is_open(licence).alias("open"), lookups.attribution_text(F.when(key % 2 == 0, " ").otherwise(F.col("c_name")), F.when(key % 3 == 0, F.col("c_mktsegment")), licence, F.concat(F.lit("u"), key.cast("string"))).alias("line"))


def answer_texts(spark, sf_dir):
    answer = _pick(ANSWERS, F.col("c_custkey"))
    rows = Tables(spark, sf_dir).read("customer")
    return rows.select("c_custkey", F.array_join(lookups.answered_list(answer), "|").alias("listed"), F.array_join(lookups.answered_categories(answer, CATEGORIES), "|").alias("categories"), lookups.answered_label(answer).alias("label"))


def _targets(t: Tables):
    key = F.col("review_id")
    rows = t.metadata().select(key.alias("seq"), "artist", "mbid", F.when(key % 3 == 0, "group").when(key % 3 == 1, " ").alias("artist_type"), F.when(key % 5 == 0, F.concat(F.lit(" DE"), (key % 2).cast("string"))).alias("country"), F.when(key % 4 == 0, F.array(F.concat(F.lit("m"), (key % 7).cast("string")), F.lit(" "))).alias("members"))
    return lookups.image_targets(rows)


def image_queue(spark, sf_dir):
    queue = lookups.image_queue(_targets(Tables(spark, sf_dir)), "name", 5, 50)
    return queue.select("place", "lookup_key", "artist", "artist_type", "country", F.array_join("members", ",").alias("members"), "review_count")


def image_queue_all(spark, sf_dir):
    return lookups.image_queue(_targets(Tables(spark, sf_dir)), "all", 0, None).select("place", "lookup_key", "review_count")


def blocked_lookups(spark, sf_dir):
    cache = Tables(spark, sf_dir).read("events").select("event_id", F.when(F.col("event_type") == "view", "not_found").otherwise("ok").alias("status"), F.col("ts").cast("timestamp_ntz").alias("fetched_at"))
    return lookups.still_blocked(cache, F.lit(NOW).cast("timestamp_ntz")).select("event_id")


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


def _at(values, at: str) -> str:
    return f"({_sql_list(values)})[CAST({at} AS BIGINT) % {len(values)} + 1]"


_MAP = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in lookups.TAG_GENRES.items()) + "}"
_ANSWER = _at(ANSWERS, "c_custkey")
_WORDS = "list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > {n} AND w <> 'the')"
_FIRST = "list_filter({x}, lambda v, i: list_position(list_transform({x}, lambda y: lower(y)), lower(v)) = i)"

_PLAN = f"""t AS (SELECT s_suppkey AS key, list_filter([CASE WHEN s_suppkey % 3 = 0 THEN 'The ' || s_name ELSE s_name END] || CASE WHEN s_suppkey % 4 <> 0 THEN ['', upper(s_name), 'Nation ' || s_nationkey] ELSE [] END, lambda x: x <> '') AS n,
        CASE WHEN s_suppkey % 5 IN (1, 2) THEN 'trio of ' || s_nationkey WHEN s_suppkey % 5 = 3 THEN 'BAND' END AS hint FROM supplier),
        g AS (SELECT key, hint, {_FIRST.format(x="n")} AS g FROM t), a AS (SELECT key, hint, g || list_transform(list_filter(g, lambda x: NOT starts_with(lower(x), 'the ')), lambda x: 'The ' || x) AS a FROM g),
        n AS (SELECT key, hint, {_FIRST.format(x="a")} AS names FROM a), e AS (SELECT key, hint, unnest(names) AS name, unnest(range(len(names))) AS i FROM n),
        q AS (SELECT key, i * 6 + j AS seq, CASE WHEN j % 2 = 0 THEN '"' || name || '"' ELSE name END || CASE WHEN j < 2 THEN ' ' || hint WHEN j < 4 THEN ' band' ELSE '' END AS query FROM e, range(6) r(j)),
        d AS (SELECT key, min(seq) AS seq, arg_min(query, seq) AS query FROM q WHERE query IS NOT NULL GROUP BY key, lower(query)), p AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY seq) AS place, query FROM d)"""

SQL = {
    "search_plan": f"WITH {_PLAN} SELECT key, place, query FROM p",
    "shared_queries": f"""WITH {_PLAN}, o AS (SELECT *, row_number() OVER (PARTITION BY lower(query) ORDER BY key, place) AS o FROM p)
        SELECT lower(query) AS query_key, max(query) FILTER (o = 1) AS query, count(*) AS n_keys, min(place) AS first_place FROM o GROUP BY 1""",
    "dict_genres": f"""WITH t AS (SELECT p_partkey, [{_at(TAGS, "p_partkey")}, ' ' || upper({_at(TAGS, "p_partkey * 7 + 3")}), {_at(TAGS, "p_partkey + 1")}] AS tags FROM part),
        g AS (SELECT p_partkey, list_filter(list_transform(tags, lambda x: {_MAP}[lower(trim(x))]), lambda x: x IS NOT NULL) AS g FROM t)
        SELECT p_partkey, coalesce(array_to_string(list_filter(g, lambda x, i: list_position(g, x) = i), ','), '') AS genres FROM g""",
    "title_variants": f"""WITH t AS (SELECT c_custkey, trim(regexp_replace(regexp_replace(trim(' Album...  ' || c_custkey || {_at(("", " (Deluxe) [x]", ": Live  at home", " - Part 2", " (a): b - c", "..."), "c_custkey")}), '\\.{{2,}}', '', 'g'), '\\s+', ' ', 'g')) AS b FROM customer),
        v AS (SELECT c_custkey, list_filter([b, trim(regexp_replace(b, '\\s*\\([^)]*\\)', '', 'g')), CASE WHEN contains(b, ':') THEN trim(split_part(b, ':', 1)) END, CASE WHEN contains(b, ' - ') THEN trim(split_part(b, ' - ', 1)) END], lambda x: x <> '') AS v FROM t)
        SELECT c_custkey, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), '|') AS variants FROM v""",
    "search_names": f"""WITH t AS (SELECT c_custkey, list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'The ' || c_name ELSE c_name END] || CASE WHEN c_custkey % 4 <> 0 THEN ['', upper(c_name), c_mktsegment] ELSE [] END, lambda x: x <> '') AS n FROM customer),
        g AS (SELECT c_custkey, {_FIRST.format(x="n")} AS g FROM t), a AS (SELECT c_custkey, g || list_transform(list_filter(g, lambda x: NOT starts_with(lower(x), 'the ')), lambda x: 'The ' || x) AS a FROM g)
        SELECT c_custkey, array_to_string({_FIRST.format(x="a")}, '|') AS names FROM a""",
    "entity_fields": """SELECT c_custkey AS key, CASE WHEN c_custkey % 10 = 9 THEN '' ELSE 'alias ' || c_custkey END AS aliases, CASE WHEN c_custkey % 10 = 9 THEN '' ELSE lower(c_mktsegment) END AS tags,
        CASE WHEN c_custkey % 10 = 9 THEN '' WHEN c_custkey % 2 = 0 THEN array_to_string(list_sort([c_mktsegment, c_name]), '|') ELSE c_name END AS members,
        CASE WHEN c_custkey % 10 <> 9 AND c_custkey % 2 = 0 THEN 'Q' || c_custkey END AS wikidata_id, CASE WHEN c_custkey % 10 <> 9 AND c_custkey % 2 = 0 THEN c_mktsegment END AS disambiguation FROM customer""",
    "best_release_groups": """WITH h AS (SELECT c_name AS asked, seq, (c_custkey + seq) % 3 = 0 AS fits, (c_custkey * 7 + seq * 11) % 4 AS score, 'g-' || c_custkey || '-' || seq AS id, c_name FROM customer, range(4) r(seq))
        SELECT asked, id, 'mb' || seq AS artist_mbid, CASE WHEN seq % 2 = 1 THEN CASE WHEN fits THEN upper(c_name) ELSE 'somebody' END WHEN fits THEN 'The ' || c_name ELSE 'nobody' END AS artist_name, CAST(score AS INT) AS score
        FROM h QUALIFY row_number() OVER (PARTITION BY asked ORDER BY fits DESC, (seq < 2) DESC, score DESC, seq) = 1""",
    "validated_mbids": "SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN 'mb' || c_custkey END AS mbid FROM customer",
    "file_hit_scores": f"""WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN replace(c_name, '#', '_') WHEN c_custkey % 3 = 1 THEN 'Customer' ELSE 'Other' END || {_at(("_live.jpg", "_logo.png", ".jpg", "_at_the_festival.jpg"), "c_custkey")} AS file FROM customer)
        SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN -100 ELSE CASE c_custkey % 3 WHEN 0 THEN 70 WHEN 1 THEN 10 ELSE 0 END - CASE WHEN contains(file, '_logo') THEN 100 ELSE 0 END
        + CASE WHEN regexp_matches(file, 'live|festival') THEN 5 ELSE 0 END END::BIGINT AS score FROM f""",
    "page_hit_scores": f"""WITH h AS (SELECT c_custkey, lower(c_name) AS n, lower(CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN 'Customer relations' ELSE 'Something else' END) AS title,
        CASE WHEN c_custkey % 4 = 0 THEN ['indie'] WHEN c_custkey % 4 = 1 THEN ['folk', 'trio'] ELSE [] END AS hints, {_at(("an indie band from ulm", "the stadium of a town", "a disambiguation page", "customer of a band at an arena", "quiet village"), "c_custkey")} AS snippet FROM customer),
        w AS (SELECT *, title || ' ' || snippet AS t, {_WORDS.format(x="n", n=2)} AS words FROM h),
        c AS (SELECT *, len(list_filter(words, lambda x: contains(title, x))) AS in_title, len(list_filter(words, lambda x: contains(t, x))) AS in_all, len(list_filter(hints, lambda x: contains(t, x))) AS hinted, regexp_matches(t, '\\bband\\b') AS music FROM w)
        SELECT c_custkey, (CASE WHEN music THEN 25 ELSE 0 END - CASE WHEN NOT music AND regexp_matches(t, '\\b(stadium|arena)\\b') THEN 50 ELSE 0 END - CASE WHEN contains(t, 'disambiguation') THEN 30 ELSE 0 END
        + CASE WHEN in_title = 0 THEN CASE WHEN in_all > 0 THEN -15 ELSE -40 END WHEN in_title = len(words) THEN 35 ELSE 15 END + CASE WHEN contains(title, n) THEN 45 ELSE 0 END
        + CASE WHEN len(hints) = 0 THEN 0 WHEN hinted > 0 THEN hinted * 15 ELSE -45 END)::BIGINT AS score FROM c""",
    "merged_hits": """SELECT user_id AS request, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS title, event_id % 8 AS batch, event_id AS seq FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, floor(value) ORDER BY event_id % 8, event_id) = 1""",
    "licence_texts": f"""WITH l AS (SELECT *, {_at(LICENCES, "c_custkey")} AS licence FROM customer), n AS (SELECT *, regexp_replace(lower(trim(licence)), '\\s+', ' ', 'g') AS n FROM l)
        SELECT c_custkey, n <> '' AND NOT regexp_matches(n, 'non-?commercial|by-nc|by-nd|no ?derivatives|all rights reserved') AND (contains(n, 'cc0') OR contains(n, 'public domain') OR regexp_matches(n, '^(pd-|cc[ -]by)')) AS open,
        '„' || CASE WHEN c_custkey % 2 = 0 THEN 'Künstlerfoto' ELSE c_name END || '“ von ' || CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'unbekannt' END || ', ' || coalesce(nullif(trim(licence), ''), 'Lizenz unbekannt') || ' via Wikimedia Commons (u' || c_custkey || ')' AS line FROM n""",
    "answer_texts": f"""SELECT c_custkey, {_at(("Rock|pop", "", "", "Electronic|ROCK", "", "", ""), "c_custkey")} AS listed, {_at(("Rock|Pop", "", "", "Electronic|Rock", "", "", ""), "c_custkey")} AS categories,
        {_at(('Sure: ["Rock", " pop ", 5, ""]', "[]", "none", "x [", '["Jazz', "Dream Pop", "Unbekannt"), "c_custkey")} AS label FROM customer""",
    "image_queue": f"""{with_views("metadata")}, m AS (SELECT review_id AS seq, artist, 'name:' || lower(artist) AS lookup_key FROM metadata WHERE mbid IS NULL),
        t AS (SELECT lookup_key, arg_min(artist, seq) AS artist, CASE WHEN count(*) FILTER (seq % 3 = 0) > 0 THEN 'group' END AS artist_type, 'DE' || arg_min(seq % 2, seq) FILTER (seq % 5 = 0) AS country,
        coalesce(string_agg(DISTINCT 'm' || seq % 7, ',' ORDER BY 'm' || seq % 7) FILTER (seq % 4 = 0), '') AS members, count(*) AS review_count FROM m GROUP BY 1)
        SELECT * FROM (SELECT row_number() OVER (ORDER BY review_count DESC, lower(artist), lookup_key) AS place, * FROM t) WHERE place > 5 AND place <= 55""",
    "image_queue_all": f"""{with_views("metadata")}, t AS (SELECT coalesce(mbid, 'name:' || lower(artist)) AS lookup_key, lower(min(artist)) AS a, count(*) AS review_count FROM metadata GROUP BY 1)
        SELECT row_number() OVER (ORDER BY review_count DESC, a, lookup_key) AS place, lookup_key, review_count FROM t""",
    "blocked_lookups": f"SELECT event_id FROM events WHERE event_type = 'view' AND ts > TIMESTAMP '{NOW}' - INTERVAL {lookups.NEGATIVE_DAYS} DAY",
}

QUERIES = {
    f.__name__: f
    for f in (
        dict_genres, title_variants, search_names, search_plan, shared_queries, entity_fields, best_release_groups, validated_mbids, file_hit_scores, page_hit_scores, merged_hits, licence_texts, answer_texts, image_queue, image_queue_all, blocked_lookups,
    )
}
