"""Answers of catalogues and searches: fields of their JSON, the best of several candidates, scores of hits, and queues of what is still to ask."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groovemill.functions.text import casefold, strip
from groovemill.operators.names import PREFERRED, in_text, same_artist
from groovemill.operators.taste import lookup_key
from groovemill.sources.parts import dealt

#: Genres by tag of the plain mapping.
TAG_GENRES = {
    "indie rock": "indie_rock", "indie": "indie_rock", "alternative rock": "alternative_rock", "alternative": "alternative_rock", "electronic": "electronic", "electronica": "electronic",
    "hip hop": "hip_hop", "hip-hop": "hip_hop", "metal": "metal", "black metal": "black_metal", "death metal": "death_metal", "pop": "pop", "synthpop": "synth_pop", "synth pop": "synth_pop",
    "post-rock": "post_rock", "post rock": "post_rock", "shoegaze": "shoegaze", "dream pop": "dream_pop",
}
#: Parts of a licence's name that rule it out.
REJECTED_LICENCES = ("non-commercial", "noncommercial", "by-nc", "by-nd", "no derivatives", "noderivatives", "all rights reserved")
#: Words in a file name that rule a picture out of a search, and words of pages on music and on venues.
EXCLUDED_FILES = r"(?:^|[\s_\-])(?:logo|icon|flag|map|chart|diagram|discography|signature|locator|ticket|screenshot|music.?video|official.?video|album.?cover|single.?cover|war.?memorial)(?:[\s_\-]|$)"
MUSIC_PAGE = r"\b(?:band|musician|singer|rapper|group|dj|orchestra|ensemble)\b"
VENUE_PAGE = r"\b(?:seaworld|theme park|amusement park|aquarium|zoo|stadium|arena|before the show|opening ceremony|pre-show|preshow|venue|theatre|theater|television show|tv show|geographical feature)\b"
#: Days for which nothing is asked again after nothing was found.
NEGATIVE_DAYS = 30

ENTITY = (
    "id string, name string, disambiguation string, aliases array<struct<name:string>>, tags array<struct<name:string>>, "
    "relations array<struct<type:string,`target-type`:string,direction:string,artist:struct<name:string>,url:struct<resource:string>>>"
)
RELEASE_GROUP = "id string, title string, score int, `primary-type` string, `artist-credit` array<struct<name:string,artist:struct<id:string,name:string>>>"


def dict_genres(tags: Column) -> Column:
    """Genres of tags by TAG_GENRES, in the tags' order, each once."""
    known = F.create_map(*(F.lit(x) for pair in TAG_GENRES.items() for x in pair))
    return F.array_distinct(F.array_compact(F.transform(tags, lambda t: F.try_element_at(known, F.lower(F.trim(t))))))


def search_phrase(text: Column) -> Column:
    """Stripped, without runs of dots, white space as single spaces."""
    return F.regexp_replace(F.regexp_replace(strip(text), r"\.{2,}", ""), r"(?U)\s+", " ")


def title_variants(album: Column) -> Column:
    """A title as it is searched for: whole, without brackets, before a colon, before a dash; each once, none blank."""
    base = search_phrase(album)
    parts = [base, strip(F.regexp_replace(base, r"(?U)\s*\([^)]*\)", "")), F.when(F.instr(base, ":") > 0, strip(F.substring_index(base, ":", 1))), F.when(F.instr(base, " - ") > 0, strip(F.substring_index(base, " - ", 1)))]
    return F.array_distinct(F.filter(F.array_compact(F.array(*parts)), lambda x: x != ""))


def _first_of(values: Column) -> Column:
    """The strings without white space around them, none blank, each the first of those that differ only in case.

    One fold over the array: its expression, which may be a long one, is there once.
    """
    keyed = F.filter(F.transform(values, lambda x: F.struct(strip(x).alias("text"), casefold(strip(x)).alias("key"))), lambda x: x["key"] != "")
    none = F.array().cast("array<struct<text:string,key:string>>")
    return F.aggregate(keyed, none, lambda kept, x: F.when(F.array_contains(kept["key"], x["key"]), kept).otherwise(F.array_append(kept, x)), lambda kept: kept["text"])


def search_names(artist: Column, aliases: Column) -> Column:
    """Distinct names to search for, whatever their case: the artist, the aliases, then each with ``The`` if it has none."""
    given = _first_of(F.concat(F.array(artist), F.coalesce(aliases, F.array().cast("array<string>"))))
    the = F.transform(F.filter(given, lambda x: ~F.lower(x).startswith("the ")), lambda x: F.concat(F.lit("The "), x))
    return _first_of(F.concat(given, the))


def search_queries(names: Column, disambiguation: Column) -> Column:
    """What to ask a search for artists of these names, most telling first: each name as a phrase and as words, with the
    disambiguation (if there is one), with ``band``, alone; none blank, none twice whatever its case."""
    hint = F.nullif(strip(disambiguation), F.lit(""))
    ways = lambda name: [F.concat(F.lit('"'), name, F.lit('"')), name]
    after = lambda name, more: [F.concat_ws(" ", way, more) for way in ways(name)]

    def asked(name: Column) -> Column:
        plain = after(name, F.lit("band")) + ways(name)
        return F.when(hint.isNull(), F.array(*plain)).otherwise(F.array(*after(name, hint), *plain))

    return _first_of(F.flatten(F.transform(F.coalesce(F.array_compact(names), F.array().cast("array<string>")), asked)))


def search_plan(artists: DataFrame) -> DataFrame:
    """One row for each query of each artist: key, place (from 1, the order of asking) and query.

    artists: key, artist, aliases (array of strings), disambiguation; the last two may be null. An artist without a name has no rows.
    """
    named = artists.select("key", search_names(F.col("artist"), F.col("aliases")).alias("names"), "disambiguation")
    listed = named.select("key", F.posexplode(search_queries(F.col("names"), F.col("disambiguation"))).alias("place", "query"))
    return listed.withColumn("place", F.col("place") + 1)


def shared_queries(plan: DataFrame) -> DataFrame:
    """The distinct queries of a ``search_plan`` (whatever their case), so that each is asked once: query_key, query (of the smallest
    key), n_keys (artists that wait for it) and first_place (the earliest place that any of them gives it)."""
    keyed = plan.withColumn("query_key", casefold(F.col("query")))
    return keyed.groupBy("query_key").agg(F.min_by("query", F.struct("key", "place")).alias("query"), F.count("*").alias("n_keys"), F.min("place").alias("first_place"))


def entity_fields(rows: DataFrame) -> DataFrame:
    """key and the fields of an artist's JSON (key, json): aliases, tags (stripped, lower case), members of the band (sorted),
    wikidata_id (of the first link that has one), disambiguation. JSON that can't be read gives nulls and empty arrays."""
    e = F.from_json("json", ENTITY)
    none = F.array().cast("array<string>")
    relations = F.col("e.relations")
    member = lambda r: (r["type"] == "member of band") & (r["target-type"] == "artist") & (F.coalesce(r["direction"], F.lit("")).isin("", "backward"))
    links = F.filter(F.transform(F.filter(relations, lambda r: r["type"] == "wikidata"), lambda r: F.regexp_extract(F.coalesce(strip(r["url"]["resource"]), F.lit("")), r"(?i)q(\d+)", 1)), lambda x: x != "")
    return rows.select("key", e.alias("e")).select(
        "key",
        F.coalesce(F.filter(F.transform("e.aliases", lambda a: strip(a["name"])), lambda x: x.isNotNull() & (x != "")), none).alias("aliases"),
        F.coalesce(F.transform(F.filter("e.tags", lambda t: F.coalesce(t["name"], F.lit("")) != ""), lambda t: F.lower(strip(t["name"]))), none).alias("tags"),
        F.coalesce(F.array_sort(F.array_distinct(F.filter(F.transform(F.filter(relations, member), lambda r: r["artist"]["name"]), lambda x: F.coalesce(x, F.lit("")) != ""))), none).alias("members"),
        F.concat(F.lit("Q"), F.get(links, F.lit(0))).alias("wikidata_id"),
        F.nullif(strip(F.col("e.disambiguation")), F.lit("")).alias("disambiguation"),
    )


def credited(group: Column) -> tuple[Column, Column]:
    """The mbid and the name of a release group's first credit; null where blank."""
    first = F.get(group["artist-credit"], F.lit(0))
    name = F.coalesce(F.nullif(strip(first["name"]), F.lit("")), F.nullif(strip(first["artist"]["name"]), F.lit("")))
    return F.nullif(strip(first["artist"]["id"]), F.lit("")), name


@F.pandas_udf(T.BooleanType())
def _same(asked: pd.Series, found: pd.Series) -> pd.Series:
    return pd.Series([a is not None and b is not None and same_artist(a, b) for a, b in zip(asked, found, strict=True)], dtype=bool)


@F.pandas_udf(T.BooleanType())
def _within(name: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([in_text(n or "", t or "") for n, t in zip(name, text, strict=True)], dtype=bool)


def matched(rows: DataFrame, asked: str, found: str, out: str, test=_same) -> DataFrame:
    """``rows`` with ``out``: whether two names fit. Each distinct pair is compared once."""
    pairs = rows.select(F.col(asked).alias("q_asked"), F.col(found).alias("q_found")).distinct()
    known = pairs.withColumn(out, test("q_asked", "q_found"))
    return rows.join(known, rows[asked].eqNullSafe(known["q_asked"]) & rows[found].eqNullSafe(known["q_found"]), "left").drop("q_asked", "q_found")


def best_release_groups(hits: DataFrame, parts: int = 0) -> DataFrame:
    """asked, id, title, artist_mbid, artist_name, score of the best hit of each request.

    hits: asked (the artist), seq (the hit's place), json. A hit whose credited artist fits goes first, then an album, then
    the larger score, then the earlier hit. parts: partitions that hits are dealt into, if more than Spark's own number; a
    request's hits are compared where they are ranked, so that wide rows move once.
    """
    dealt_hits = dealt(hits.select("asked", "seq", "json").repartition("asked"), parts, "asked")
    rows = dealt_hits.select("asked", "seq", F.from_json("json", RELEASE_GROUP).alias("g")).where("g IS NOT NULL")
    mbid, name = credited(F.col("g"))
    score = F.coalesce("g.score", F.lit(0))
    album = (F.lower(F.coalesce("g.primary-type", F.lit(""))) == "album").cast("int")
    narrow = rows.select("asked", "seq", "g.id", "g.title", mbid.alias("artist_mbid"), name.alias("artist_name"), score.alias("score"), album.alias("album"))
    rank = F.struct(_same("asked", "artist_name").cast("int").alias("f"), F.col("album").alias("a"), F.col("score").alias("s"), (-F.col("seq")).alias("q"))
    best = narrow.withColumn("rank", rank).groupBy("asked").agg(F.max_by(F.struct("id", "title", "artist_mbid", "artist_name", "score"), "rank").alias("r"))
    return best.select("asked", "r.*")


def validated_mbids(rows: DataFrame) -> DataFrame:
    """``rows`` (asked, name, mbid) with the mbid only where the found name fits the one asked for."""
    fits = matched(rows, "asked", "name", "q_fits")
    return fits.withColumn("mbid", F.when(F.col("q_fits"), F.col("mbid"))).drop("q_fits")


def file_hit_scores(hits: DataFrame) -> DataFrame:
    """``hits`` (artist, file) with ``score``: 50 for the name as a phrase in the file's name, 10 for each of its words, 5 for a
    preferred word, less 100 for an excluded one; -100 if either name is empty."""
    text = F.btrim(F.regexp_replace(casefold(F.regexp_replace(F.regexp_replace("file", "(?i)^file:", ""), "_", " ")), "[^a-z0-9]+", " "))
    rows = matched(hits.withColumn("q_text", text).withColumn("q_name", F.btrim(F.regexp_replace(casefold(F.col("artist")), "[^a-z0-9]+", " "))), "artist", "q_text", "q_within", _within)
    words = F.filter(F.split("q_name", " "), lambda w: F.length(w) > 2)
    padded = F.concat(F.lit(" "), F.col("q_text"), F.lit(" "))
    each = F.size(F.filter(words, lambda w: F.contains(padded, F.concat(F.lit(" "), w, F.lit(" "))))) * 10
    score = F.when(F.col("q_within"), 50).otherwise(0) + each - F.when(F.replace("q_text", F.lit(" "), F.lit("_")).rlike(EXCLUDED_FILES), 100).otherwise(0) + F.when(F.col("q_text").rlike(f"(?i){PREFERRED}"), 5).otherwise(0)
    return rows.withColumn("score", F.when((F.col("q_name") == "") | (F.col("q_text") == ""), -100).otherwise(score)).drop("q_text", "q_name", "q_within")


def telling_words(text: Column, longer_than: int) -> Column:
    """Words of a-z and 0-9 of more letters than that, other than ``the``."""
    return F.filter(F.split(F.btrim(F.regexp_replace(casefold(text), "[^a-z0-9]+", " ")), " "), lambda w: (F.length(w) > longer_than) & (w != "the"))


def page_hit_scores(hits: DataFrame) -> DataFrame:
    """``hits`` (names: search names, title, snippet, disambiguation) with ``score``, how likely the page is about the artist.

    The words that all names share (else those of the first) count by how many the title has; whole names, words about
    music and venues, and words of the disambiguation count as well.
    """
    title = casefold(F.coalesce("title", F.lit("")))
    combined = F.concat(title, F.lit(" "), casefold(F.regexp_replace(F.coalesce("snippet", F.lit("")), "<[^>]+>", "")))
    each = F.transform(F.filter("names", lambda n: strip(n) != ""), lambda n: telling_words(n, 2))
    shared = F.aggregate(F.slice(each, 2, F.greatest(F.size(each) - 1, F.lit(0))), F.coalesce(F.get(each, F.lit(0)), F.array().cast("array<string>")), F.array_intersect)
    words = F.array_distinct(F.when(F.size(shared) > 0, shared).otherwise(F.coalesce(F.get(each, F.lit(0)), F.array().cast("array<string>"))))
    music = combined.rlike(MUSIC_PAGE)
    hinted = F.filter(telling_words(F.coalesce("disambiguation", F.lit("")), 3), lambda w: w != "the")
    rows = hits.withColumns({"q_title": title, "q_all": combined, "q_words": words, "q_hints": hinted})
    n_title = F.size(F.filter("q_words", lambda w: F.contains("q_title", w)))
    by_words = F.when(F.size("q_words") == 0, 0).when(n_title == 0, F.when(F.exists("q_words", lambda w: F.contains("q_all", w)), -15).otherwise(-40)).when(n_title == F.size("q_words"), 35).otherwise(15)
    lowered = F.filter(F.transform("names", lambda n: casefold(strip(n))), lambda n: n != "")
    # names count one after another, up to the first that the title has
    place = F.array_position(F.transform(lowered, lambda n: F.contains("q_title", n)), F.lit(True)).cast("int")
    tried = F.when(place > 0, F.slice(lowered, 1, F.greatest(place, F.lit(1)))).otherwise(lowered)
    by_names = F.size(F.filter(tried, lambda n: F.contains("q_all", n))) * 20 + F.when(place > 0, 25).otherwise(0)
    n_hints = F.size(F.filter("q_hints", lambda w: F.contains("q_all", w)))
    by_hints = F.when(F.size("q_hints") == 0, 0).when(n_hints > 0, n_hints * 15).otherwise(-45)
    score = F.when(music, 25).otherwise(0) - F.when(combined.rlike(VENUE_PAGE) & ~music, 50).otherwise(0) - F.when(F.contains("q_all", F.lit("disambiguation")), 30).otherwise(0) + by_words + by_names + by_hints
    return rows.withColumn("score", score).drop("q_title", "q_all", "q_words", "q_hints")


def merged_hits(batches: DataFrame) -> DataFrame:
    """title, batch, seq of the first hit of each title for each request (request, batch, seq, title): batches go before each other by number."""
    return batches.groupBy("request", "title").agg(F.min(F.struct("batch", "seq")).alias("r")).select("request", "title", "r.*")


def license_is_open(text: Column) -> Column:
    """Whether a licence's short name allows showing a picture: public domain, CC0 or CC BY, without further limits."""
    name = F.regexp_replace(casefold(strip(F.coalesce(text, F.lit("")))), r"(?U)\s+", " ")
    rejected = F.lit(False)
    for part in REJECTED_LICENCES:
        rejected = rejected | name.contains(part)
    return (name != "") & ~rejected & (name.contains("cc0") | name.contains("public domain") | name.rlike("^(pd-|cc[ -]by)"))


def attribution_text(title: Column, author: Column, licence: Column, url: Column) -> Column:
    """A line that names a picture's title, author, licence and address."""
    given = lambda c, d: F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(d))
    return F.concat(F.lit("„"), given(title, "Künstlerfoto"), F.lit("“ von "), given(author, "unbekannt"), F.lit(", "), given(licence, "Lizenz unbekannt"), F.lit(" via Wikimedia Commons ("), url, F.lit(")"))


def answered_list(text: Column) -> Column:
    """The strings of the JSON array in a model's answer, stripped; none if there is no such array."""
    found = F.try_variant_get(F.try_parse_json(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\[.*\]", 0)), "$", "array<variant>")
    strings = F.transform(F.filter(found, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: strip(F.try_variant_get(v, "$", "string")))
    return F.coalesce(F.filter(strings, lambda x: x != ""), F.array().cast("array<string>"))


def answered_categories(text: Column, valid: Sequence[str]) -> Column:
    """Of the answer's strings those that are valid, whatever their case, as they are written in ``valid``."""
    known = F.create_map(*(F.lit(x) for v in valid for x in (v.lower(), v)))
    return F.array_compact(F.transform(answered_list(text), lambda x: F.try_element_at(known, F.lower(x))))


def answered_label(text: Column) -> Column:
    """The first line of an answer without quotes around it; ``Unbekannt`` if it is blank."""
    line = strip(F.substring_index(strip(F.coalesce(text, F.lit(""))), "\n", 1))
    return F.coalesce(F.nullif(F.regexp_replace(line, "^[\"']|[\"']$", ""), F.lit("")), F.lit("Unbekannt"))


def prompt_artists(top: Column, every: Column, most: int = 15) -> Column:
    """Artists for a prompt: the top ones, then others, each once."""
    return F.slice(F.array_distinct(F.filter(F.transform(F.concat(top, every), strip), lambda x: x != "")), 1, most)


def image_targets(metadata: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """One target for each artist (by ``lookup_key``) with a name: lookup_key, artist, mbid, artist_type, country, members, genres, review_count.

    metadata: seq, artist, mbid, artist_type, country, members (array). Name and hints are the first there are, by seq;
    members are collected, and genres (from profiles: lookup_key, genres) as well.
    """
    rows = metadata.where(strip(F.col("artist")) != "").withColumn("lookup_key", lookup_key(F.col("mbid"), F.col("artist")))
    first = lambda c: F.min_by(strip(F.col(c)), F.when(F.coalesce(strip(F.col(c)), F.lit("")) != "", F.col("seq"))).alias(c)
    members = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.transform(F.coalesce("members", F.array().cast("array<string>")), strip), lambda x: x != "")))))
    found = rows.groupBy("lookup_key").agg(first("artist"), first("mbid"), first("artist_type"), first("country"), members.alias("members"), F.count("*").alias("review_count"))
    if profiles is None:
        return found
    return found.join(profiles.select("lookup_key", F.array_sort("genres").alias("genres")), "lookup_key", "left")


def image_queue(targets: DataFrame, kind: str, offset: int, limit: int | None) -> DataFrame:
    """``targets`` of a kind (mbid, name, all) with their place: most reviews first, then by name; from ``offset`` on, at most ``limit``.

    Spark keeps only ``offset + limit`` rows in each task; without a limit places are numbered within ranges of counts.
    """
    rows = targets if kind == "all" else targets.where(F.col("mbid").isNotNull() if kind == "mbid" else F.col("mbid").isNull())
    order = [F.col("review_count").desc(), casefold(F.col("artist")), F.col("lookup_key")]
    if limit is not None:
        top = rows.orderBy(*order).limit(max(0, offset) + max(1, limit))
        return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).where(F.col("place") > max(0, offset))
    sizes = rows.groupBy("review_count").agg(F.count("*").alias("n"))
    before = sizes.select("review_count", F.coalesce(F.sum("n").over(Window.orderBy(F.col("review_count").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("review_count").orderBy(*order[1:]))
    return rows.join(before, "review_count").withColumn("place", (F.col("before") + within).cast("long")).drop("before").where(F.col("place") > max(0, offset))


def still_blocked(cache: DataFrame, now: Column, days: int = NEGATIVE_DAYS) -> DataFrame:
    """Rows of the cache (status, fetched_at) that say that nothing was found less than ``days`` before ``now``."""
    return cache.where((F.col("status") == "not_found") & (F.col("fetched_at") > now - F.make_dt_interval(F.lit(days))))

