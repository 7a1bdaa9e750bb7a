"""Free-form tags as canonical genres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The genres, in their order, and the forms that a tag of each has between word borders.
GENRES = {
    "rock": r"(?:blues|jazz)?rock|rockand[-\s]?indie",
    "alternative_rock": r"alternative\s+rock|alt[-\s]?rock|alternrock|post[-\s]?grunge|american\s+trad\s+rock",
    "indie_rock": r"alt\s+rock|indie|indietronica|garage\s+rock\s+revival|post[-\s]?britpop|post[-\s]?punk\s+revival",
    "punk": r"punk|punkpop|punkmetal|skatepunk|anarchopunk|postpunk",
    "metal": r"(?:alt|rap)?metal|metalcore",
    "pop": r"(?:dance)?pop|popmetal|popfolk",
    "synth_pop": r"synth[-\s]?pop|electro\s*pop|synth\s+funk|new\s+wave",
    "art_pop": r"(?:art|avant[-\s]?garde|chamber|baroque)\s+pop|chamber\s+folk",
    "electronic": r"electronica?|club/dance|non-music",
    "house": r"(?:tech|club)?house",
    "techno": r"techno|acid\s+(?:house|jazz)",
    "trance": r"trance",
    "ambient": r"ambient|drone",
    "idm": r"idm|electroclash|futurepop|glitch",
    "drum_and_bass": r"drum\s+and\s+bass|breakbeat|big\s+beat|breaks",
    "trip_hop": r"trip[-\s]?hop|downtempo|lounge",
    "hip_hop": r"hip[-\s]?hop|rap|raprock|rapcore",
    "rnb_soul": r"r[&\s]?b|r\s*n\s*b|soul",
    "funk": r"funk|funky\s+house",
    "folk": r"(?:anti|neo)?folk|folkrock",
    "country": r"(?:alt)?country|countryrock",
    "americana": r"americana",
    "singer_songwriter": r"singer[-/\s]?songwriter",
    "acoustic": r"acoustic|emo[-\s]?folk",
    "emo": r"emo|emofolk|screamo",
    "hardcore": r"(?:post)?hardcore|mathcore",
    "post_rock": r"post[-\s]?(?:rock|metal|industrial)",
    "shoegaze": r"shoegazer?|dream\s+pop|neo[-\s]?psychedelia|psychedelic",
    "jazz": r"jazz|jazzrock|big\s+band",
    "classical": r"(?:neo)?classical|orchestral",
    "world": r"world|chanson|reggae|reggaepop|ragga\s*hiphop|latin|bossa\s+nova|bluegrass|humppa",
}

#: Tags that are no styles.
NO_STYLES = (
    "5+ wochen|1-4 wochen|2000|2001|2002|2003|2004|2005|2006|80s|00s"
    "|english|deutsch|german|american|usa|sweden|swedish|france|french|français|canada|canadian|canadien|iceland|british|britannique|scandinavia|scandinave|scandinavie"
    "|melancholic|bittersweet|dark|dense|energetic|passionate|anxious|mellow|romantic|aggressive|uplifting|sad|winter|summer|warm|cold|futuristic|noisy|ominous|playful|political|complex|depressive|existential|atmospheric|cryptic|lonely|surreal|sexual|optimistic|serious|triumphant|raw|heavy"
    "|music|genre|vocal|male vocalist|female vocalist|male vocalists|female vocalists|family|live|soundtrack|non-music"
).split("|")
#: A tag with one of these in it is no style.
NO_STYLE_PARTS = "wochen|charts|plattentests.de|q recommends|ph_temp_checken|pkg-jewel case|cd extra|drm|self-titled|concept album|hidden track|pregaptrack".split("|")


def tag_token(tag: Column) -> Column:
    """A tag in lower case, its separators and ``and`` as single spaces; empty if nothing is left."""
    spaced = F.replace(F.translate(F.lower(F.regexp_replace(tag, r"(?U)^\s+|\s+$", "")), "/;,+|&", "      "), F.lit(" and "), F.lit(" "))
    return F.btrim(F.regexp_replace(spaced, r"(?U)\s+", " "))


def is_style(token: Column) -> Column:
    """False for years, charts, moods, countries and the like."""
    parts = F.lit(False)
    for part in NO_STYLE_PARTS:
        parts = parts | token.contains(part)
    return (token != "") & ~token.rlike(r"(?U)\b(19|20)\d{2}\b") & ~parts & ~token.isin(NO_STYLES)


def genres_of(token: Column) -> Column:
    """All genres whose forms occur in a token, in the order of GENRES; none if it is no style."""
    found = F.array_compact(F.array(*(F.when(token.rlike(rf"(?U)\b(?:{form})\b"), F.lit(genre)) for genre, form in GENRES.items())))
    return F.when(is_style(token), found).otherwise(F.array().cast("array<string>"))
