"""Operator 5: language-model scores by prediction by partial matching, beside a unigram base score.

The model is a trie of byte contexts up to ORDER bytes, learnt from all training documents. A byte's probability comes
from the longest context that has seen it; each context that hasn't passes on an escape probability (method C: distinct
followers over occurrences and distinct followers), and followers that were passed over are excluded from the shorter
contexts. A document's score is the sum over its bytes and an end mark.

Neither the trie nor the vocabulary has a useful size bound, so nothing of them is broadcast. Documents are dealt
into blocks; a block sends its distinct words and grams, sorted into slices by hash, and gets their counts and
log-probabilities back in the same order:

1. ``extracted``: block -> (block, slice, words and their training counts, grams and theirs)
2. ``gathered``: slice -> summed gram counts, by two-byte context, of which each has at most 65536 grams
3. ``_modelled``: two-byte context -> log-probabilities, by slice; orders 1 and 0 are a table of 65536 counts
4. ``valued``: slice -> (block, slice, word counts, log-probabilities)
5. ``scored``: block -> documents

A hot word or gram is one entry in each block that has it, however often it occurs. Rows that repeat one another are
dealt over all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored
from .text import bounds_of, lowered, sums, text_bytes, words

ORDER = 3
#: Bytes of text in a block, about, and the fewest blocks.
BLOCK_BYTES, LEAST_BLOCKS = 16 << 20, 64
#: Groups of two-byte contexts.
CONTEXTS = 1024
#: Bytes that UTF-8 never has: before a document's first byte and after its last.
BEFORE, AFTER = 0xFE, 0xFF
#: Cells of a table from grams to their numbers; rarer texts with more contexts are searched instead.
CELLS = 1 << 25
#: Bytes of text that are scored at once.
AT_ONCE = 2 << 20

_WEIGHTS = np.random.default_rng(5).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(strings: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each string: sums of its bytes with weights by place, mixed with the length."""
    data, ends = text_bytes(strings)
    lengths = np.diff(ends)
    place = (np.arange(len(data)) - np.repeat(ends[:-1], lengths)) % 256
    out = []
    for weights in _WEIGHTS:
        h = sums((data.astype(np.uint64) + np.uint64(1)) * weights[place], ends) + lengths.astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        out.append(h ^ (h >> np.uint64(29)))
    return out[0], out[1]


def _slice_of(hashes: np.ndarray, n_slices: int) -> np.ndarray:
    """Slices are ranges of hashes, so that order by hash is order by slice."""
    return ((hashes >> np.uint64(32)) * np.uint64(n_slices) >> np.uint64(32)).astype(np.int64)


def _gram_hashes(grams: np.ndarray) -> np.ndarray:
    h = (grams.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def grams_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram (ORDER bytes of context and a byte, as one number) of each byte and end mark, and where rows start."""
    n, lengths = len(ends) - 1, np.diff(ends)
    starts = ends[:-1] + (ORDER + 1) * np.arange(n)
    framed = np.full(len(data) + (ORDER + 1) * n, BEFORE, np.uint8)
    framed[np.arange(len(data)) + np.repeat((ORDER + 1) * np.arange(n) + ORDER, lengths)] = data
    framed[starts + ORDER + lengths] = AFTER
    real = np.ones(len(framed), bool)
    for k in range(ORDER):
        real[starts + k] = False
    code = np.zeros(len(framed), np.uint32)
    for back in range(ORDER + 1):
        code[back:] |= framed[: len(framed) - back].astype(np.uint32) << np.uint32(8 * back)
    return code[real], bounds_of(lengths + 1)


class Terms(NamedTuple):
    """A block's distinct words and grams in the order of their hashes, which is that of their slices."""

    words: pa.BinaryArray
    word_slices: np.ndarray
    grams: np.ndarray
    gram_slices: np.ndarray


def _terms(distinct: pa.BinaryArray, grams: np.ndarray, n_slices: int) -> tuple[Terms, np.ndarray, np.ndarray]:
    """Sorted terms, and where each given word and gram now stands."""
    one, two = _hashes(distinct)
    order = np.lexsort((two, one))
    hashed = _gram_hashes(grams)
    by_hash = np.argsort(hashed)  # the hash is one to one
    places = []
    for o in (order, by_hash):
        place = np.empty(len(o), np.int64)
        place[o] = np.arange(len(o))
        places.append(place)
    return Terms(distinct.take(pa.array(order)), _slice_of(one[order], n_slices), grams[by_hash], _slice_of(hashed[by_hash], n_slices)), *places


def _texts(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(table.column(column))


def _distinct_grams(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(grams):
        return grams, np.zeros(0, np.int64)
    ordered = np.sort(grams)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.diff(np.append(first, len(ordered)))


def _lists(values: pa.Array, slices: np.ndarray, wanted: np.ndarray) -> pa.Array:
    """Values (in order of their slices) as one list for each wanted slice."""
    bounds = np.append(np.searchsorted(slices, wanted), len(values)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), values)


def _extract(table: pa.Table, n_slices: int) -> pa.Table:
    data, ends = _texts(table, "text")
    train = table.column("train").to_numpy()
    tokens, firsts = words(lowered(data), ends)
    coded = tokens.dictionary_encode()
    learnt = np.repeat(train, np.diff(firsts))
    counts = np.bincount(coded.indices.to_numpy(zero_copy_only=False)[learnt], minlength=len(coded.dictionary))
    found, times = [], []
    at = 0
    while at < len(train):  # grams of a part of the rows at once
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + 2 * AT_ONCE, side="right")) - 1)
        codes, bounds = grams_of(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
        marked = codes.astype(np.uint64) << np.uint64(1) | np.repeat(train[at:to], np.diff(bounds)).astype(np.uint64)
        keys, n = _distinct_grams(marked)
        found.append(keys)
        times.append(n)
        at = to
    keys, where = np.unique(np.concatenate(found), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate(times)).astype(np.int64)
    grams, own = np.unique(keys >> np.uint64(1), return_inverse=True)
    seen = np.bincount(own, weights=total * (keys & np.uint64(1)).astype(np.int64)).astype(np.int64)
    terms, word_at, gram_at = _terms(coded.dictionary, grams.astype(np.uint32), n_slices)
    word_counts, gram_counts = np.empty(len(word_at), np.int64), np.empty(len(gram_at), np.int64)
    word_counts[word_at], gram_counts[gram_at] = counts, seen
    wanted = np.union1d(terms.word_slices, terms.gram_slices)
    rows = [
        pa.array(np.full(len(wanted), table.column("block")[0].as_py())),
        pa.array(wanted),
        *(_lists(v, s, wanted) for v, s in ((terms.words, terms.word_slices), (pa.array(word_counts), terms.word_slices), (pa.array(terms.grams.astype(np.int64)), terms.gram_slices), (pa.array(gram_counts), terms.gram_slices))),
    ]
    return pa.Table.from_arrays(rows, names=["block", "slice", "words", "word_counts", "grams", "gram_counts"])


EXTRACTED = "block long, slice long, words array<binary>, word_counts array<long>, grams array<long>, gram_counts array<long>"


def extracted(blocks: DataFrame, n_slices: int) -> DataFrame:
    """Distinct words and grams of each block's documents with their counts in training documents, by slice."""
    return blocks.select("block", "train", "text").groupBy("block").applyInArrow(lambda t: _extract(t, n_slices), EXTRACTED)


def _flat(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def gathered(terms: DataFrame) -> DataFrame:
    """All distinct grams with their training counts: context (a group of two-byte contexts), slice, grams, counts."""

    def add(table: pa.Table) -> pa.Table:
        grams, where = np.unique(_flat(table, "grams"), return_inverse=True)
        counts = np.bincount(where, weights=_flat(table, "gram_counts"), minlength=len(grams)).astype(np.int64)
        group = (grams >> 8 & 0xFFFF) * 40503 % 65536 % CONTEXTS
        order = np.argsort(group, kind="stable")
        wanted = np.unique(group)
        rows = [pa.array(wanted), pa.array(np.full(len(wanted), table.column("slice")[0].as_py())), *(_lists(pa.array(x[order]), group[order], wanted) for x in (grams, counts))]
        return pa.Table.from_arrays(rows, names=["context", "slice", "grams", "counts"])

    return terms.select("slice", "grams", "gram_counts").groupBy("slice").applyInArrow(add, "context long, slice long, grams array<long>, counts array<long>")


def first_orders(grams: DataFrame) -> np.ndarray:
    """Training counts of byte pairs: 256 by 256, whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, np.int64)
        for batch in batches:
            np.add.at(total, batch.column(0).flatten().to_numpy() & 0xFFFF, batch.column(1).flatten().to_numpy())
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], names=["pair", "n"])

    out = np.zeros(65536, np.int64)
    for pair, n in grams.select("grams", "counts").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():  # at most 65536 rows
        out[pair] = n
    return out.reshape(256, 256)


def log_probabilities(grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each gram after its context.

    grams: distinct; with a two-byte context all its grams have to be there. counts: in training, 0 where unseen.
    """
    seen, byte, before = counts > 0, grams & 255, grams >> 8 & 255
    # order 3, by context
    _, long = np.unique(grams >> 8, return_inverse=True)
    n3, q3 = np.bincount(long, counts), np.bincount(long, seen)
    # order 2: counts by (two-byte context, byte), totals by context
    keys, short = np.unique(grams & 0xFFFFFF, return_inverse=True)
    c2 = np.bincount(short, counts)
    _, own = np.unique(keys >> 8, return_inverse=True)
    n2, q2 = np.bincount(own, c2), np.bincount(own, c2 > 0)
    of_long = np.zeros(len(n3), np.int64)
    of_long[long] = own[short]
    n2_left = n2[of_long] - np.bincount(long, c2[short] * seen)
    q2_left = q2[of_long] - q3
    # order 1 without what order 2 has seen, order 0 without what order 1 has seen
    last, key_byte = keys >> 8 & 255, keys & 255
    c1 = pairs[last, key_byte].astype(float)
    of_pair = np.zeros(len(n2), np.int64)
    of_pair[own] = last
    n1_left = pairs.sum(axis=1)[of_pair] - np.bincount(own, c1 * (c2 > 0))
    q1_left = (pairs > 0).sum(axis=1)[of_pair] - q2
    zero = pairs.sum(axis=0)
    n0_left = zero.sum() - (pairs > 0) @ zero
    q0_left = (zero > 0).sum() - (pairs > 0).sum(axis=1)

    p, open_ = np.ones(len(grams)), np.ones(len(grams), bool)
    context = own[short]
    for count, total, kinds in (
        (counts, n3[long], q3[long]),
        (c2[short], n2_left[long], q2_left[long]),
        (c1[short], n1_left[context], q1_left[context]),
        (zero[byte], n0_left[before], q0_left[before]),
    ):
        there = open_ & (total > 0)  # else the context tells nothing, and nothing is paid for leaving it
        found = there & (count > 0)
        p = np.where(there, p * np.where(found, count, kinds) / np.where(there, total + kinds, 1), p)
        open_ &= ~found
    p[open_] /= max(1, 256 - int((zero > 0).sum()))
    return np.log10(np.maximum(p, 1e-300))


def _modelled(grams: DataFrame, pairs: np.ndarray) -> DataFrame:
    def model(table: pa.Table) -> pa.Table:
        own, counts = _flat(table, "grams"), _flat(table, "counts")
        slices = np.repeat(table.column("slice").to_numpy(), table.column("grams").combine_chunks().value_lengths().to_numpy())
        values = log_probabilities(own, counts, pairs)
        order = np.argsort(slices, kind="stable")
        wanted = np.unique(slices)
        return pa.Table.from_arrays([pa.array(wanted), *(_lists(pa.array(x[order]), slices[order], wanted) for x in (own, values))], names=["slice", "grams", "values"])

    return grams.groupBy("context").applyInArrow(model, "slice long, grams array<long>, values array<double>")


VALUED = "block long, slice long, word_counts array<long>, gram_values array<double>, n_distinct long, n_tokens long"


def valued(terms: DataFrame, model: DataFrame) -> DataFrame:
    """For each block and slice the words' training counts and the grams' log-probabilities, in the order of the terms.

    A row of block -1 for each slice has the number of its distinct training words and of their tokens.
    """

    def value(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_pylist([], schema=pa.schema([("block", pa.int64()), ("slice", pa.int64()), ("word_counts", pa.list_(pa.int64())), ("gram_values", pa.list_(pa.float64())), ("n_distinct", pa.int64()), ("n_tokens", pa.int64())]))
        own_words, own_grams = (left.column(c).combine_chunks() for c in ("words", "grams"))
        coded = own_words.flatten().dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        total = np.bincount(which, weights=_flat(left, "word_counts"), minlength=len(coded.dictionary)).astype(np.int64)
        known, values = _flat(right, "grams"), _flat(right, "values")
        order = np.argsort(known)
        got = values[order][np.searchsorted(known[order], own_grams.flatten().to_numpy())]
        n = left.num_rows + 1
        lists = [pa.ListArray.from_arrays(pa.array(np.append(b := bounds_of(x.value_lengths().to_numpy()), b[-1]).astype(np.int32)), pa.array(v)) for x, v in ((own_words, total[which]), (own_grams, got))]
        marks = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
        marks[0][-1], marks[1][-1] = (total > 0).sum(), total.sum()
        return pa.Table.from_arrays([pa.array(np.append(left.column("block").to_numpy(), -1)), pa.array(np.full(n, left.column("slice")[0].as_py())), *lists, *map(pa.array, marks)], names=["block", "slice", "word_counts", "gram_values", "n_distinct", "n_tokens"])

    return terms.groupBy("slice").cogroup(model.groupBy("slice")).applyInArrow(value, VALUED)


def _gram_places(grams: np.ndarray):
    """A function from grams to their numbers among the given ones (sorted)."""
    contexts = np.unique(grams >> np.uint32(8))
    if len(contexts) * 256 > CELLS:
        return lambda wanted: np.searchsorted(grams, wanted)
    number = np.zeros(1 << 24, np.int32)
    number[contexts] = np.arange(len(contexts)) << 8
    cells = np.zeros(len(contexts) << 8, np.int32)
    cells[number[grams >> np.uint32(8)] | (grams & np.uint32(255)).astype(np.int32)] = np.arange(len(grams))
    return lambda wanted: cells[number[wanted >> np.uint32(8)] | (wanted & np.uint32(255)).astype(np.int32)]


def _score(left: pa.Table, right: pa.Table, n_slices: int, end_count: int) -> pa.Table:
    data, ends = _texts(left, "text")
    tokens, firsts = words(lowered(data), ends)
    coded = tokens.dictionary_encode()
    parts = []
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + AT_ONCE, side="right")) - 1)
        parts.append((at, to))
        at = to
    grams = np.unique(np.concatenate([_distinct_grams(grams_of(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])[0])[0] for a, b in parts]))
    _, word_at, gram_at = _terms(coded.dictionary, grams, n_slices)
    right = right.sort_by("slice")
    counts = _flat(right, "word_counts")[word_at]
    values = _flat(right, "gram_values")[gram_at]
    which = coded.indices.to_numpy(zero_copy_only=False)
    n_tokens = np.diff(firsts) + 1
    n_known = sums((counts > 0)[which].astype(np.int64), firsts) + (end_count > 0)
    logs = sums(np.log10(counts + 0.5)[which], firsts) + np.log10(end_count + 0.5)
    place, scores = _gram_places(grams), []
    for a, b in parts:
        codes, bounds = grams_of(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
        scores.append(sums(values[place(codes)], bounds))
    return pa.Table.from_arrays([left.column("doc_id"), left.column("train"), *map(pa.array, (n_tokens, n_known, logs, np.concatenate(scores), np.diff(ends)))], names=["doc_id", "train", "n_tokens", "n_known", "logs", "score", "n_bytes"])


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (doc_id, text and more) with their block of ``n``, stored: a row's number in the scan is hashed as well, so that
    repeated rows don't meet in one block, and differs from scan to scan, so that blocks are dealt once."""
    return stored(rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(n))), "blocks")


def score(docs: DataFrame, train: Column) -> DataFrame:
    """Scores of each row's whole ``text`` by models of the rows where ``train`` holds.

    doc_id, held_out, n_tokens (words and one end), n_known (of them with a training count), train_tokens, base_score
    (log10 probability by smoothed unigrams), score (log10 probability by the byte model) and bits_per_byte. A null or
    empty text has just its end. Rows where ``train`` is null are held out. Repeated rows count as often as they occur; no
    rows give no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count_if("train").alias("ends")).first()
    n = max(LEAST_BLOCKS, -(-size["bytes"] // BLOCK_BYTES))
    ends = int(size["ends"])
    blocks = dealt(rows, n)
    terms = stored(extracted(blocks, n), "terms")
    grams = stored(gathered(terms), "grams")
    values = stored(valued(terms, _modelled(grams, first_orders(grams))), "values")
    totals = values.where("block = -1").agg(F.coalesce(F.sum("n_distinct"), F.lit(0)).alias("v"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()
    distinct, total = totals["v"] + (ends > 0), totals["n"] + ends
    found = blocks.groupBy("block").cogroup(values.where("block >= 0").groupBy("block")).applyInArrow(lambda x, y: _score(x, y, n, ends), "doc_id long, train boolean, n_tokens long, n_known long, logs double, score double, n_bytes long")
    return found.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(total + 0.5 * (distinct + 1)))).alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
