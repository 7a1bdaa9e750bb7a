"""Text functions with the semantics of Python's string methods where Spark's differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Windows-1252 characters by the C1 control that stands for them after a wrong decoding.
C1_CONTROLS = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
CP1252_CHARACTERS = "€‚ƒ„…†‡ˆ‰š‹Œž‘’“”•–—˜™š›œžŸ"

EXCERPT_LIMIT = 300


def strip(text: Column) -> Column:
    """Without white space (Unicode's, not only spaces) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def name_key(name: Column) -> Column:
    """A name as it is compared: stripped, lower case."""
    return F.lower(strip(name))


def casefold(text: Column) -> Column:
    """Lower case for comparisons without case: ß and ẞ are ss, ligatures their letters, a final sigma a sigma, as ``str.casefold`` has it.

    The way leads over upper case, which has the expansions. Unlike ``str.casefold``, dotless i becomes i and Cherokee lower
    case; strings that are equal there are equal here.
    """
    upper = F.replace(F.upper(text), F.lit("ẞ"), F.lit("SS"))  # without a step between, Spark drops upper() below lower()
    return F.translate(F.lower(upper), "ς", "σ")


def repair_cp1252(text: Column) -> Column:
    """C1 controls replaced by the characters that they stand for."""
    return F.translate(text, C1_CONTROLS, CP1252_CHARACTERS)


def excerpt(text: Column, limit: int = EXCERPT_LIMIT) -> Column:
    """A struct of the text's beginning and whether more follows.

    Up to ``limit`` characters; a longer text is cut at the last space, if that lies in the second half.
    """
    whole = strip(repair_cp1252(F.coalesce(text, F.lit(""))))
    head = F.substring(whole, 1, limit)
    last = F.lit(limit) - F.instr(F.reverse(head), " ")  # characters before the last space
    cut = F.when((F.instr(head, " ") > 0) & (last > limit // 2), F.left(head, last)).otherwise(head)
    return F.when(F.length(whole) <= limit, F.struct(whole.alias("excerpt"), F.lit(False).alias("continues"))).otherwise(F.struct(F.regexp_replace(cut, r"(?U)\s+$", "").alias("excerpt"), F.lit(True).alias("continues")))


def title_norm(text: Column) -> Column:
    """Without case, anything but word characters a space, single spaces."""
    return F.btrim(F.regexp_replace(F.regexp_replace(casefold(text), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def track_key(artist: Column, title: Column) -> Column:
    """Key of a track for finding it twice in a playlist."""
    return F.concat(title_norm(artist), F.lit("::"), title_norm(title))


def rating_from_text(text: Column) -> Column:
    """The number that a text such as ``7,5/10`` starts with, else null."""
    found = F.regexp_extract(text, r"^(\d+(?:[.,]\d+)?)", 1)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit(".")).cast("double"))


def split_labels(text: Column) -> Column:
    """Record labels between slashes, commas and semicolons."""
    return F.filter(F.transform(F.split(text, "[/,;]"), strip), lambda x: x != "")


def csv_field(text: Column) -> Column:
    """Quoted where a field has a comma, quote or line break."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)


def file_name(text: Column) -> Column:
    """Letters, digits, dots, dashes and underscores; ``playlist`` if nothing is left."""
    safe = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.when(safe != "", safe).otherwise(F.lit("playlist"))
