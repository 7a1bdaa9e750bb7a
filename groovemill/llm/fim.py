"""Operator 13: fill-in-middle by lookaround splitting.

A unit grammar names the classes of characters that stand on both sides of a boundary between units. It becomes a regex
that matches nothing but the place between two such characters, so that Spark's split keeps every character of the text.
All of it is one projection of Spark's own functions; no rows are moved.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"\x20\x09-\x0D"


class Edge(NamedTuple):
    """A boundary between a character of class ``before`` and one of class ``after``; both are bodies of a character class."""

    before: str
    after: str


#: Grammars of units by name. ``word``: white space belongs to the word after it, and white space at the end is a unit.
UNITS = {
    "word": (Edge(f"^{_SPACE}", _SPACE),),
    "line": (Edge(r"\n", r"\x{0}-\x{10FFFF}"),),
    "sentence": (Edge(".!?", _SPACE),),
    "run": (Edge(r"\p{L}", r"^\p{L}"), Edge(r"^\p{L}", r"\p{L}")),
    "character": (Edge(r"\x{0}-\x{10FFFF}", r"\x{0}-\x{10FFFF}"),),
}
#: Marks of the three parts in the output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Plan(NamedTuple):
    """Seed of the hashes; of 100 texts ``changed`` are changed, and of 100 changed ones ``spm`` have their suffix first."""

    seed: int = 42
    changed: int = 50
    spm: int = 80


def boundary(edges: tuple[Edge, ...]) -> str:
    """The zero-width regex of a grammar."""
    return "|".join(f"(?<=[{e.before}])(?=[{e.after}])" for e in edges)


def units(text: Column, grammar: str = "word") -> Column:
    """The units of ``text`` in order; joined they are the text again. An empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(UNITS[grammar]), -1))


def _joined(pieces: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(pieces, start + 1, length), "")


def transform(docs: DataFrame, grammar: str = "word", plan: Plan = Plan()) -> DataFrame:
    """doc_id, n (units), form, output, prefix_chars and middle_chars of each row.

    h1 to h4 are the first groups of eight hex digits of the sha256 of ``seed:doc_id``. The prefix ends after the smaller of
    h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. A text that is empty or has a mark in it stays as it is
    (form ``plain``), as does one with h3 % 100 at ``plan.changed`` or above; the others are ``spm`` if h4 % 100 lies below
    ``plan.spm``, else ``psm``. A null text counts as empty, a null doc_id as an empty number. Rows stay as they are,
    repeated ones as well; further columns of ``docs`` are ignored.
    """
    digest = F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(F.col("digest"), 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    text, n = F.col("text"), F.col("n")
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (text == "") | marked | (h[2] % 100 >= plan.changed)
    cut = (
        docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), digest.alias("digest"))
        .withColumn("pieces", units(text, grammar))
        .withColumn("n", F.size("pieces").cast("long"))
        .withColumns({"a": F.least(h[0] % (n + 1), h[1] % (n + 1)).cast("int"), "b": F.greatest(h[0] % (n + 1), h[1] % (n + 1)).cast("int")})
        .withColumn("form", F.when(plain, "plain").when(h[3] % 100 < plan.spm, "spm").otherwise("psm"))
    )
    pieces, a, b, changed = F.col("pieces"), F.col("a"), F.col("b"), F.col("form") != "plain"
    parts = F.struct(_joined(pieces, F.lit(0), a).alias("prefix"), _joined(pieces, a, b - a).alias("middle"), _joined(pieces, b, F.size(pieces) - b).alias("suffix"))
    prefix, middle, suffix = (F.col(f"parts.{x}") for x in ("prefix", "middle", "suffix"))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(text)
    )
    split = cut.withColumn("parts", F.when(changed, parts))
    return split.select("doc_id", "n", "form", output.alias("output"), F.length(prefix).cast("long").alias("prefix_chars"), F.length(middle).cast("long").alias("middle_chars"))


def restored(output: Column, form: Column) -> Column:
    """The exact text that ``output`` was made of. It has each mark just once, since marked texts stay plain."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def digests(transformed: DataFrame) -> DataFrame:
    """The rows of ``transform`` with the lowercase hex sha256 of the output and of the text rebuilt from it."""
    back = restored(F.col("output"), F.col("form"))
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
