"""Reviews and headings from saved HTML pages.

A page becomes two arrays, its elements with the range of the page that each covers, and its pieces of text. What stands where
is then asked by Spark's own functions: an element is in another if it starts within its range.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groovemill.functions.text import strip

ELEMENTS = "array<struct<at: int, end: int, above: int, tag: string, id: string, classes: array<string>>>"
STRINGS = "array<struct<at: int, text: string>>"
#: Pages that are held parsed at once.
PAGES = 64
_EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Parts(HTMLParser):
    """Numbers elements and pieces of text as they come; an element ends where the next thing outside of it starts."""

    def __init__(self):
        super().__init__()
        self.at, self.elements, self.strings, self.open = 0, [], [], []

    def _next(self) -> int:
        self.at += 1
        return self.at

    def _close(self, depth: int) -> None:
        for element in self.open[depth:]:
            element["end"] = self.at + 1
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li") and self.open and self.open[-1]["tag"] == tag:
            self._close(-1)
        known = dict(reversed(attrs))
        above = self.open[-1]["at"] if self.open else 0
        element = {"at": self._next(), "end": None, "above": above, "tag": tag, "id": known.get("id"), "classes": (known.get("class") or "").split()}
        self.elements.append(element)
        self.open.append(element)
        if tag in _EMPTY:
            self._close(-1)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth]["tag"] == tag:
                self._close(depth)
                break

    def handle_data(self, data):
        at = self._next()
        if text := data.strip():
            self.strings.append({"at": at, "text": text})


def page_parts(page: str | None) -> tuple[list[dict], list[dict]]:
    """Elements and pieces of text of a page in their order."""
    parts = _Parts()
    parts.feed(page or "")
    parts.close()
    parts._close(0)
    return parts.elements, parts.strings


def few_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut into ones of PAGES rows at most, as parsed pages take many times their size."""
    return (batch.slice(at, PAGES) for batch in batches for at in range(0, batch.num_rows, PAGES))


def with_parts(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, elements and strings of pages (page_id, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        element = pa.struct([("at", pa.int32()), ("end", pa.int32()), ("above", pa.int32()), ("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string()))])
        for batch in few_at_once(batches):
            found = [page_parts(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e for e, _ in found], pa.list_(element)), pa.array([s for _, s in found], pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string())])))], names=["page_id", "elements", "strings"])

    return pages.select("page_id", html).mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, elements {ELEMENTS}, strings {STRINGS}")


def _all(tag: str, box: Column | None = None, name: str | None = None, kind: str | None = None, not_kind: str | None = None) -> Column:
    """The elements of a tag within a box, in their order."""

    def fits(x: Column) -> Column:
        found = x["tag"] == tag
        if box is not None:
            found &= (x["at"] > box["at"]) & (x["at"] < box["end"])
        if name is not None:
            found &= F.coalesce(x["id"] == name, F.lit(False))
        if kind is not None:
            found &= F.array_contains(x["classes"], kind)
        return found & ~F.array_contains(x["classes"], not_kind) if not_kind is not None else found

    return F.filter("elements", fits)


def _first(tag: str, box: Column | None = None, **having) -> Column:
    return F.get(_all(tag, box, **having), F.lit(0))


def _strings(box: Column) -> Column:
    return F.transform(F.filter("strings", lambda s: (s["at"] > box["at"]) & (s["at"] < box["end"])), lambda s: s["text"])


def _text(box: Column, between: str = "") -> Column:
    return F.array_join(_strings(box), between)


def _texts(boxes: Column, between: str = "") -> Column:
    return F.filter(F.transform(boxes, lambda b: _text(b, between)), lambda t: t != "")


def _last(values: Column) -> Column:
    return F.element_at(F.concat(F.array(F.lit(None)), F.array_compact(values)), -1)


def parse_reviews(pages: DataFrame) -> DataFrame:
    """page_id and the review's fields of pages (page_id, html) that have a review's container, artist, album and text."""
    c = F.col
    # elements that others are looked up in are columns first, as an expression would be evaluated for each element again; for the
    # same reason no filter on what was looked up stands over these columns: Spark would take it below them, with all of their lookups
    # nested in it. A page without a head or body has no artist or text in the end
    none = F.array().cast("array<string>")
    box = with_parts(pages).withColumn("page", _first("div", name="rezension")).where("page IS NOT NULL")
    heads = F.filter(_all("div", c("page"), kind="headerbox"), lambda b: F.size(_all("h1", b)) > 0)
    parts = {"body": "rezitext", "list": "rezitracklist", "likes": "rezihighlights", "names": "reziref"}
    box = box.withColumns({"head": F.get(heads, F.lit(0)), **{to: _first("div", c("page"), name=name) for to, name in parts.items()}})
    marks = F.transform(_all("p", c("head"), kind="bewertung"), lambda p: F.struct(p.alias("p"), _first("strong", p).alias("strong")))
    box = box.withColumns(
        {
            "h1": _first("h1", c("head")), "fact": _first("p", c("head"), not_kind="bewertung"), "marked": marks, "h2": _first("h2", c("body")), "by": _first("p", c("body"), kind="autor"),
            "discs": _first("ul", c("list")), "ol": _first("ol", c("list")), "length": _first("p", c("list")),
        }
    )
    own = F.filter("elements", lambda x: (x["tag"] == "li") & (x["above"] == c("discs")["at"]))
    lists = F.when(c("discs").isNull(), F.array("ol")).otherwise(F.transform(own, lambda li: _first("ol", li)))
    read = box.withColumn("lists", F.array_compact(lists)).withColumns(
        {
            "heading": _text(c("h1")),
            "text": F.array_join(_texts(_all("p", c("body"), not_kind="autor"), " "), "\n\n"),
            "facts": F.coalesce(_strings(c("fact")), none),
            "marks": F.transform("marked", lambda m: F.struct(_text(m["p"], " ").alias("says"), F.replace(F.nullif(F.regexp_extract(_text(m["strong"]), r"^\d+(?:[.,]\d+)?", 0), F.lit("")), F.lit(","), F.lit(".")).cast("double").alias("value"))),
            "title": F.when(c("h2").isNotNull(), _text(c("h2"))),
            "author": F.nullif(strip(F.btrim(_text(c("by")), F.lit("() "))), F.lit("")),
            "highlights": F.coalesce(_texts(_all("li", c("likes"))), none),
            "named": F.coalesce(_texts(_all("a", c("names"))), none),
            "titles": F.coalesce(F.flatten(F.transform("lists", lambda ol: _texts(_all("li", ol), " "))), none),
            "total_duration": F.nullif(F.regexp_extract(_text(c("length"), " "), r"\d{1,3}:\d{2}", 0), F.lit("")),
        }
    )
    later = F.slice(c("facts"), 2, F.greatest(F.size("facts") - 1, F.lit(0)))
    dmy = lambda x, i: F.nullif(F.regexp_extract(x, r"(\d{1,2})\.(\d{1,2})\.(\d{4})", i), F.lit(""))
    day = lambda x: F.concat_ws("-", dmy(x, 3), F.lpad(dmy(x, 2), 2, "0"), F.lpad(dmy(x, 1), 2, "0")).try_cast("date")
    year = lambda x: F.coalesce(dmy(x, 3), F.nullif(F.regexp_extract(x, r"\b(\d{4})\b", 1), F.lit(""))).cast("int")
    mark = lambda whose: _last(F.transform(F.filter("marks", whose), lambda m: m["value"]))
    loud, lower = F.col("loud"), F.col("lower")
    fields = [
        c("page_id"),
        strip(F.substring_index("heading", " - ", 1)).alias("artist"),
        F.when(F.contains("heading", F.lit(" - ")), strip(F.expr("substring(heading, instr(heading, ' - ') + 3)"))).alias("album"),
        F.when(F.size("facts") > 0, F.filter(F.transform(F.split(F.get("facts", F.lit(0)), "[/,;]"), strip), lambda x: x != "")).otherwise(F.array().cast("array<string>")).alias("labels"),
        _last(F.transform(later, day)).alias("release_date"),
        _last(F.transform(later, year)).alias("release_year"),
        mark(lambda m: F.contains(m["says"], F.lit("Unsere"))).alias("rating"),
        mark(lambda m: F.contains(m["says"], F.lit("Eure")) & ~F.contains(m["says"], F.lit("Unsere"))).alias("user_rating"),
        c("title"),
        c("author"),
        c("text"),
        F.transform("titles", lambda t, i: F.struct((i + 1).alias("number"), t.alias("title"), F.array_contains(loud, F.lower(t)).alias("is_highlight"))).alias("tracks"),
        c("highlights"),
        c("total_duration"),
        F.filter("named", lambda x, i: F.array_position(lower, F.lower(x)) == i + 1).alias("refs"),
    ]
    whole = lambda r: (r["artist"] != "") & (r["album"] != "") & (r["text"] != "")
    found = read.withColumns({"loud": F.transform("highlights", F.lower), "lower": F.transform("named", F.lower)})
    return found.select(F.inline(F.filter(F.array(F.struct(*fields)), whole)))


def page_headings(pages: DataFrame) -> DataFrame:
    """page_id, title, n_paragraphs, n_links of any page."""
    title = _first("title")
    return with_parts(pages).select("page_id", F.when(title.isNotNull(), _text(title)).alias("title"), F.size(_all("p")).cast("long").alias("n_paragraphs"), F.size(_all("a")).cast("long").alias("n_links"))
