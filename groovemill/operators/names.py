"""Whether two artist names, or a name and a picture's description, mean the same artist."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groovemill.functions.text import casefold, strip

#: Letters that Unicode doesn't take apart, words that don't tell artists apart, words before a name that
#: don't make it another one.
FOLDS = str.maketrans({"ı": "i", "İ": "i", "ï": "i", "ö": "o", "ü": "u", "ä": "a", "å": "a", "æ": "ae", "ø": "o", "ß": "ss", "ł": "l", "ñ": "n", "ç": "c"})
CONNECTORS = frozenset("a an and at of the &".split())
NEUTRAL = frozenset("album band concert cover disc festival file image jpeg jpg live photo picture png portrait press single svg tour wiki org https http www upload wikipedia wikimedia commons".split())
SHORT_NAME = 4


def plain(name: str) -> str:
    """Lower case, only a-z and 0-9, single spaces."""
    return " ".join(re.findall("[a-z0-9]+", name.casefold()))


def folded(name: str) -> str:
    """``plain`` after accents are dropped and signs for ``and`` are spelt out."""
    letters = unicodedata.normalize("NFKD", name.casefold().translate(FOLDS))
    letters = "".join(c for c in letters if not unicodedata.combining(c))
    return plain(re.sub("[&+/]", " and ", letters))


def bare(name: str) -> str:
    """A plain name without a leading article."""
    return re.sub("^the +", "", name)


def variants(name: str) -> set[str]:
    """Plain phrases that stand for a plain name."""
    return {name, bare(name), f"the {bare(name)}"} if name else set()


def _other_bearer(text: list[str], name: list[str], own: set[str], multi: bool) -> bool:
    """Whether up to three words before the last word of the name make it somebody else's name."""
    for end, word in enumerate(text):
        if word != name[-1]:
            continue
        before = text[max(0, end - 3) : end]
        if not before:
            continue
        phrase = bare(" ".join([*before, word]))
        if phrase in own:
            continue
        lead = phrase.split()[:-1]
        if multi:
            numbered = any(c.isdigit() for w in phrase.split() for c in w)
            rest = iter(phrase.split())
            if not numbered and not all(w in rest for w in name):
                return True
        elif any(w not in NEUTRAL for w in lead):
            return True
    return False


def in_text(name: str, text: str) -> bool:
    """Whether the name stands in the text as a whole phrase, and not as a part of another artist's name."""
    own, words = variants(plain(name)), plain(text).split()
    if not own or not words:
        return False
    short = bare(plain(name)).split()
    there = any(f" {v} " in f" {' '.join(words)} " for v in own)
    if len(short) == 1:
        return there and not _other_bearer(words, short, own, multi=False)
    telling = [w for w in short if w not in CONNECTORS and len(w) > 2]
    return there and not (len(telling) > 1 and _other_bearer(words, telling, own, multi=True))


def same_artist(asked: str, found: str) -> bool:
    """Whether a name that was found fits the one asked for."""

    def forms(name: str) -> set[str]:
        phrases = variants(name)
        return {x for p in phrases for x in (p, " ".join(w for w in p.split() if w not in CONNECTORS)) if x}

    one, two = folded(asked), folded(found)
    if not one or not two:
        return False
    return bool(forms(one) & forms(two)) or in_text(asked, found) or in_text(found, asked)


def picture_shows(name: str, file: str, context: str) -> bool:
    """Whether a picture's file name and description fit the artist; a very short name has to lead the file name."""
    short, title = bare(plain(name)), plain(re.sub("^file:", "", file, flags=re.IGNORECASE).replace("_", " "))
    if " " not in short and len(short) <= SHORT_NAME and not (bare(title) + " ").startswith(f"{short} "):
        return False
    return in_text(name, f"{title} {context}")


@F.pandas_udf(T.BooleanType())
def same_artist_udf(asked: pd.Series, found: pd.Series) -> pd.Series:
    return pd.Series([a is not None and b is not None and same_artist(a, b) for a, b in zip(asked, found, strict=True)])


@F.pandas_udf(T.BooleanType())
def picture_shows_udf(name: pd.Series, file: pd.Series, context: pd.Series) -> pd.Series:
    return pd.Series([picture_shows(n or "", f or "", c or "") for n, f, c in zip(name, file, context, strict=True)])


@F.pandas_udf(T.BooleanType())
def stands_in_udf(name: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([in_text(n or "", t or "") for n, t in zip(name, text, strict=True)], dtype=bool)


def distinctive_member(name: str) -> bool:
    """Whether a member's name may stand for the band: not a single word of up to four letters."""
    words = plain(name).split()
    return bool(words) and not (len(words) == 1 and len(words[0]) <= SHORT_NAME)


def best_artist(candidates: DataFrame) -> DataFrame:
    """request, name, mbid, score: for each request (asked, name, mbid, score) the equal name first, then the best score."""
    equal = (casefold(strip(F.col("asked"))) == casefold(strip(F.col("name")))).cast("int")
    return candidates.groupBy("asked").agg(F.max_by(F.struct("name", "mbid", "score"), F.struct(equal.alias("e"), F.col("score"), F.col("mbid"))).alias("r")).select("asked", "r.*")


#: Words in a picture's description that rule it out, or that need or give a musical context.
EXCLUDED = r"(?i)\b(?:map|flag|logo|icon|diagram|locator|province|region|coat of arms|seal|stadium|venue|aquarium|theme park|seaworld|zoo|airport|university|album cover|single cover|screenshot|music video|official video|discography|signature|war memorial|geography|geographic|administrative|territory|municipality|county|district|national park)\b"
PLACES = r"(?i)\b(?:maps of|locator maps|geography of|regions of|provinces of|administrative divisions|coat of arms of)\b"
MUSIC = r"(?i)\b(?:band|musician|singer|rapper|musical group|dj|orchestra|ensemble|concert|festival|performance|on stage|onstage|tour|live music|rock band|indie band|pop band|punk band)\b"
VENUES = r"(?i)\b(?:seaworld|theme park|amusement park|aquarium|zoo|stadium|arena|before the show|opening ceremony|pre-show|preshow|venue|theatre|theater|television show|tv show|geographical feature|province of|region of|map of)\b"
PREFERRED = r"(live|concert|perform|press|portrait|band|festival|on.?stage|tour)"
REJECTED = -10_000
THRESHOLD_MBID, THRESHOLD_NAME, THRESHOLD_MEMBER = 70, 85, 90


def image_confidence(images: DataFrame) -> DataFrame:
    """``images`` with score, threshold and accepted.

    images: artist, mbid, artist_type, source (wikidata_p18, commons_search, member_fallback), file, context, categories,
    name_matches (from ``picture_shows_udf``, of the depicted member's name where there is one) and hint_matches (whether the
    artist's disambiguation stands in the context).
    """
    music, text = F.col("context").rlike(MUSIC), F.col("context")
    place = F.coalesce(F.col("categories").rlike(PLACES), F.lit(False))
    venue = text.rlike(VENUES)
    rejected = (F.btrim("artist") == "") | text.rlike(EXCLUDED) | ~F.col("name_matches") | ((place | venue) & ~music)
    has_id = F.coalesce(F.col("mbid"), F.lit("")) != ""
    member = F.col("source") == "member_fallback"
    points = lambda when, n: F.when(when, n).otherwise(0)
    score = (
        F.lit(40)
        - points(place, 15)
        - points(venue, 20)
        + points(music, 25)
        + points(F.lower("file").rlike(PREFERRED), 10)
        + F.when(has_id & (F.col("source") == "wikidata_p18"), 35).when(has_id, 10).otherwise(0)
        + points(F.coalesce("hint_matches", F.lit(False)), 15)
        + points(F.lower("artist_type").isin("group", "person", "orchestra"), 5)
        - points(member, 10)
    )
    threshold = F.when(member, THRESHOLD_MEMBER).when(has_id, THRESHOLD_MBID).otherwise(THRESHOLD_NAME)
    scored = images.withColumn("score", F.when(rejected, REJECTED).otherwise(score)).withColumn("threshold", threshold)
    return scored.withColumn("accepted", F.col("score") >= F.col("threshold"))


def image_targets(metadata: DataFrame) -> DataFrame:
    """lookup_key, artist, genres, review_count: one target per mbid, or per name where there is none.

    metadata: review_id, artist, mbid, genres; the artist's name is that of the smallest review_id.
    """
    key = F.coalesce(F.nullif(F.btrim("mbid"), F.lit("")), F.concat(F.lit("name:"), F.lower(F.btrim("artist"))))
    rows = metadata.where("trim(artist) <> ''").select(key.alias("lookup_key"), "review_id", F.btrim("artist").alias("artist"), "genres")
    names = rows.groupBy("lookup_key").agg(F.min_by("artist", "review_id").alias("artist"), F.count("*").alias("review_count"))
    genres = rows.select("lookup_key", F.explode("genres").alias("genre")).groupBy("lookup_key").agg(F.array_join(F.array_sort(F.collect_set("genre")), ",").alias("genres"))
    return names.join(genres, "lookup_key", "left").select("lookup_key", "artist", F.coalesce("genres", F.lit("")).alias("genres"), "review_count")

