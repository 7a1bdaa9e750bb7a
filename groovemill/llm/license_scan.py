"""Operator 1: licence notices in whole texts, exact and with a few errors.

A notice that may have k errors is split into k + 1 seeds: wherever it occurs, at least one seed occurs exactly. Seeds
are searched as plain strings; around each, the regex library matches the whole notice with at most k insertions,
deletions and substitutions, and gives the span. Base phrases are notices without errors.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices, text_bytes


class Notice(NamedTuple):
    """Words of a notice, separated by single spaces, its label, and how many errors (characters) are let pass."""

    label: str
    words: str
    errors: int


#: Phrases that count exactly.
BASE = (
    Notice("gpl", "gnu general public license", 0),
    Notice("apache", "apache license", 0),
    Notice("cc-by", "cc by", 0),
    Notice("mit", "mit license", 0),
)
#: Short notices from the licences' own texts.
FUZZY = (
    Notice("gpl", "gnu general public license", 3),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("agpl", "gnu affero general public license", 3),
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("mit", "released under the mit license", 2),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 6),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 6),
    Notice("mpl", "mozilla public license", 2),
    Notice("epl", "eclipse public license", 2),
    Notice("cc-by", "creative commons attribution", 3),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 5),
)

#: Upper case to lower case, and all that isn't part of a word to a space.
_NORMAL = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
_SPAN = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()), ("errors", pa.int32()), ("score", pa.float64())])


@functools.lru_cache(maxsize=None)
def _matcher(notice: Notice):
    import regex

    return regex.compile(rf"(?e)(?<![^ ])(?:{notice.words}){{e<={notice.errors}}}(?![^ ])")


@functools.lru_cache(maxsize=None)
def seeds(notice: Notice) -> tuple[tuple[int, str], ...]:
    """errors + 1 parts of the notice that cover it, with their places in it."""
    cuts = [len(notice.words) * i // (notice.errors + 1) for i in range(notice.errors + 2)]
    return tuple((a, notice.words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))


def _windows(text: str, notice: Notice) -> list[tuple[int, int]]:
    """Stretches of the text around seeds that hold every match; overlapping ones are joined."""
    found = []
    for place, seed in seeds(notice):
        at = text.find(seed)
        while at >= 0:
            start = at - place - notice.errors
            found.append((max(0, start), at - place + len(notice.words) + notice.errors + 1))
            at = text.find(seed, at + 1)
    joined: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if joined and a <= joined[-1][1]:
            joined[-1] = joined[-1][0], max(b, joined[-1][1])
        else:
            joined.append((a, b))
    return joined


def find_spans(text: str, base: tuple[Notice, ...] = BASE, fuzzy: tuple[Notice, ...] = FUZZY) -> list[dict]:
    """Spans (numbers of the first and last word) in a normalised text: words with a space before, between and after."""
    spans, spaces = [], None

    def add(notice: Notice, exact: bool, a: int, b: int, errors: int) -> None:
        nonlocal spaces
        if spaces is None:  # once for a text that has any hit
            spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
        first, last = (np.searchsorted(spaces, (a, b)) - 1).tolist()
        spans.append({"label": notice.label, "base": exact, "first": first, "last": last, "errors": errors, "score": 1.0 - errors / len(notice.words)})

    for notice in base:
        wanted = f" {notice.words} "
        at = text.find(wanted)
        while at >= 0:
            add(notice, True, at + 1, at + len(wanted) - 1, 0)
            at = text.find(wanted, at + 1)
    for notice in fuzzy:
        for a, b in _windows(text, notice):
            for m in _matcher(notice).finditer(text, a, b):
                add(notice, False, m.start(), m.end(), sum(m.fuzzy_counts))
    return spans


def scan(docs: DataFrame, base: tuple[Notice, ...] = BASE, fuzzy: tuple[Notice, ...] = FUZZY) -> DataFrame:
    """doc_id, n_words and spans of each row's whole ``text``.

    spans: array of (label, base, first, last, errors, score), first and last being word numbers from 0; empty where
    nothing is found. A null or empty text has no words. Rows stay as they are, repeated ones as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, ends = text_bytes(batch.column(1))
            n_words, spans = [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                found = data[a:b].tobytes().translate(_NORMAL).split(b" ")
                found = [w for w in found if w]
                n_words.append(len(found))
                spans.append(find_spans((b" " + b" ".join(found) + b" ").decode("utf-8", "replace"), base, fuzzy))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "n_words", "spans"])

    schema = "doc_id long, n_words long, spans array<struct<label:string,base:boolean,first:long,last:long,errors:int,score:double>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def summarise(scanned: DataFrame) -> DataFrame:
    """One row of figures for each scanned row: the base phrases' places and labels, and all labels with the best score."""
    base = F.filter("spans", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["first"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
        F.size("spans").cast("long").alias("n_spans"),
    )
