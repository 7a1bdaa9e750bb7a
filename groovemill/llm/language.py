"""Operator 4: language identification by interpolated Kneser-Ney models of characters.

There is a model of order 4 for each language. Characters are those of lower-cased words of letters, each word framed by
marks, so that a word's cost doesn't depend on its neighbours and each distinct word of a batch is scored once. A model
is a few sorted arrays of 64-bit hashes with values beside them; the languages' cross-entropies per character are
compared, and a document is rejected if even the lowest is out of what training documents have.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import checkpointed
from .text import Memo, slices, sums, text_bytes, words

ORDER = 4
#: Training documents per language are at most about this many, chosen by a hash of their ids.
SAMPLE = 2000
#: A language's model has its most frequent grams of ORDER characters, at most so many; their arrays are broadcast.
MOST_GRAMS = 500_000
START, END = "\x02", "\x03"
#: Cross-entropies' spread among training documents is measured in this share of them, which no model learns from.
CALIBRATION = 5
#: A document is rejected beyond the median deviation of calibration documents by so many of their standard deviations, estimated from the median one.
SLACK = 20.0
#: A language's spread is joined with that of all languages, which counts as so many documents, and that with PRIOR, which counts as many.
PRIOR_ROWS = 5
#: Variance of a character's cost in nats, and of documents' means; a guess that calibration documents soon outweigh.
PRIOR = (4.0, 0.05)
UNKNOWN = "und"

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters up to each position; the first n - 1 positions have no meaning."""
    h = np.full(len(codes), n, np.uint64)
    for back in range(n - 1, -1, -1):
        h = (h ^ np.roll(codes, back)) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


class Model(NamedTuple):
    """One language: for each order the discounted shares of grams and the weights left to shorter contexts."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float

    def probability(self, hashes: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Of characters whose grams of order n have hashes[n - 1], after contexts of n - 1 with contexts[n - 1]."""
        p = np.full(len(hashes[0]), self.floor)
        for (keys, shares), (heads, weights), gram, context in zip(self.grams, self.contexts, hashes, contexts, strict=True):
            p = _lookup(keys, shares, gram, 0.0) + _lookup(heads, weights, context, 1.0) * p
        return p


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def kneser_ney(counts: dict[str, int], alphabet: int) -> Model:
    """The model of the counts of grams of ORDER characters."""
    levels = [Counter(counts)]
    for _ in range(ORDER - 1):  # shorter grams count the characters that they follow
        levels.append(Counter(g[1:] for g in levels[-1]))
    grams, contexts = [], []
    for level in reversed(levels):
        once, twice = (sum(1 for c in level.values() if c == k) for k in (1, 2))
        discount = once / (once + 2 * twice) if once else 0.5
        total, kinds = defaultdict(int), defaultdict(int)
        for g, c in level.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        grams.append(_table({g: max(c - discount, 0.0) / total[g[:-1]] for g, c in level.items()}))
        contexts.append(_table({h: discount * kinds[h] / total[h] for h in total}))
    return Model(grams, contexts, 1.0 / alphabet)


def _table(values: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array([int(_hashes(np.array([ord(c) for c in g], np.uint64), len(g))[-1]) if g else 0 for g in values], np.uint64)
    order = np.argsort(keys)
    return keys[order], np.fromiter(values.values(), float, len(values))[order]


def _fitted(rows: pa.Table, alphabet: int) -> pa.Table:
    """A language's grams (lang, gram, n) as the arrays of its model, order by order."""
    order = pc.sort_indices(rows, [("n", "descending"), ("gram", "ascending")])[:MOST_GRAMS]
    kept = rows.take(order)
    model = kneser_ney(dict(zip(kept.column("gram").to_pylist(), kept.column("n").to_pylist(), strict=True)), alphabet)
    parts = [array.tobytes() for pair in zip(model.grams, model.contexts, strict=True) for table in pair for array in table]
    return pa.table({"lang": rows.column("lang")[:1], "parts": pa.array([parts], pa.list_(pa.binary()))})


def _model(parts: list[bytes], alphabet: int) -> Model:
    """The model whose arrays ``_fitted`` gave."""
    tables = [(np.frombuffer(keys, np.uint64), np.frombuffer(values, float)) for keys, values in zip(parts[::2], parts[1::2], strict=True)]
    return Model(tables[::2], tables[1::2], 1.0 / alphabet)


def _letter_words(token: bytes) -> list[str]:
    text = token.decode("utf-8", "replace").lower()
    return [text] if text.isalpha() else "".join(c if c.isalpha() else " " for c in text).split()


class Identifier(NamedTuple):
    """All languages' models, and the bounds of rejection: mean, spread within and between documents, most deviations."""

    languages: list[str]
    models: list[Model]
    bounds: np.ndarray | None = None

    def costs(self, tokens: list[bytes]) -> pa.Array:
        """For each token the nats that each language takes for its words, and their characters."""
        own = [_letter_words(t) for t in tokens]
        text = "".join(START * (ORDER - 1) + w + END for ws in own for w in ws)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        lengths = np.array([sum(len(w) + 1 for w in ws) for ws in own], np.int64)
        out = np.zeros((len(tokens), len(self.languages) + 1))
        out[:, -1] = lengths
        if len(codes):
            real = codes != ord(START)
            full, where, back = np.unique(_hashes(codes, ORDER)[real], return_index=True, return_inverse=True)
            at = np.flatnonzero(real)[where]
            hashes = [_hashes(codes, n)[at] for n in range(1, ORDER)] + [full]
            codes = np.roll(codes, 1)
            contexts = [np.zeros(len(at), np.uint64)] + [_hashes(codes, n)[at] for n in range(1, ORDER)]
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            for k, model in enumerate(self.models):
                out[:, k] = sums(-np.log(model.probability(hashes, contexts))[back], bounds)
        return pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1])

    def memo(self) -> Memo:
        return Memo(self.costs)

    def entropies(self, data: np.ndarray, ends: np.ndarray, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character (rows by languages) and characters of each row."""
        tokens, firsts = words(data, ends)
        if not len(tokens):
            return np.zeros((len(ends) - 1, len(self.languages))), np.zeros(len(ends) - 1, np.int64)
        coded = tokens.dictionary_encode()
        table = memo(coded.dictionary).flatten().to_numpy().reshape(-1, len(self.languages) + 1)
        which = coded.indices.to_numpy()
        total = np.stack([sums(table[:, k][which], firsts) for k in range(table.shape[1])], axis=1)
        return total[:, :-1] / np.maximum(total[:, -1:], 1), total[:, -1].astype(np.int64)

    def deviations(self, best: np.ndarray, entropy: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """How far above its language's mean each row's lowest entropy is, in deviations for its length."""
        mean, within, between, _ = self.bounds[best].T
        return (entropy - mean) / np.sqrt(within / np.maximum(chars, 1) + between)

    def predict(self, data: np.ndarray, ends: np.ndarray, memo: Memo) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the best language (-1: no letter), score, and whether the row is rejected."""
        entropy, chars = self.entropies(data, ends, memo)
        if not self.languages:
            return np.full(len(chars), -1), np.zeros(len(chars)), np.ones(len(chars), bool)
        line, best = np.arange(len(chars)), entropy.argmin(axis=1)
        apart = (entropy - entropy[line, best][:, None]) * np.minimum(chars, 100)[:, None]
        score = np.where(chars > 0, 1 / np.exp(-apart).sum(axis=1), 0.0)
        rejected = chars == 0
        if self.bounds is not None:
            rejected = rejected | (self.deviations(best, entropy[line, best], chars) > self.bounds[best, 3])
        return np.where(chars > 0, best, -1), score, rejected


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _sample(train: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` documents of each language at most, by a hash of their ids; all if there are no more."""
    sizes = train.groupBy("lang").agg(F.count("*").alias("n_lang"))
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n_lang"))
    u = (F.xxhash64("doc_id", F.lit("sample")).bitwiseAND(F.lit((1 << 40) - 1))) / F.lit(float(1 << 40))
    return train.join(F.broadcast(sizes), "lang").where(u < share).select("doc_id", "lang", "text")


def train(docs: DataFrame, per_language: int = SAMPLE) -> Identifier:
    """Models of all non-null languages of ``docs`` (doc_id, lang, text), learnt from a bounded sample.

    Each language's model is made where its grams are summed up. The driver gets the finished arrays, of MOST_GRAMS grams for
    each language at most, and one row of figures for each calibration document. Documents without letters teach nothing; without documents there is no
    language.
    """
    sample = _sample(docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang", "text"), per_language)
    held = (F.xxhash64("doc_id", F.lit("calibration")) % CALIBRATION) == 0

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: defaultdict[str, Counter] = defaultdict(Counter)
        for batch in slices(batches):
            tokens, firsts = words(*text_bytes(batch.column(1)))
            coded, languages = tokens.dictionary_encode(), batch.column(0).to_pylist()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(firsts))
            names = sorted(set(languages))
            number = np.array([names.index(x) for x in languages], np.int64)
            pairs, n = np.unique(number[owner] * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_counts=True)
            for pair, times in zip(pairs.tolist(), n.tolist(), strict=True):
                language, token = divmod(pair, len(coded.dictionary))
                for w in _letter_words(coded.dictionary[token].as_py()):
                    framed = START * (ORDER - 1) + w + END
                    for i in range(len(w) + 1):
                        found[names[language]][framed[i : i + ORDER]] += times
        for language, counts in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(counts)), pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["lang", "gram", "n"])

    counted = sample.where(~held).select("lang", "text").mapInArrow(grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = checkpointed(counted)
    alphabet = counted.agg(F.countDistinct(F.right("gram", F.lit(1)))).first()[0] + 1
    tables = counted.groupBy("lang").applyInArrow(lambda rows: _fitted(rows, alphabet), "lang string, parts array<binary>").orderBy("lang").toArrow()
    languages = tables.column("lang").to_pylist()
    learnt = Identifier(languages, [_model(parts, alphabet) for parts in tables.column("parts").to_pylist()])
    if not languages:
        return learnt

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = learnt.memo()
        for batch in slices(batches):
            entropy, chars = learnt.entropies(*text_bytes(batch.column(1)), memo)
            own = np.array([languages.index(x) if x in languages else -1 for x in batch.column(0).to_pylist()], np.int64)
            keep = (chars > 0) & (own == entropy.argmin(axis=1))  # else the label is doubtful
            yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array(entropy[keep, own[keep]]), pa.array(chars[keep])], names=["own", "entropy", "chars"])

    seen = sample.where(held).select("lang", "text").mapInArrow(figures, "own long, entropy double, chars long").toPandas()
    return learnt._replace(bounds=_calibrated(learnt, seen["own"].to_numpy(), seen["entropy"].to_numpy(), seen["chars"].to_numpy()))


def _calibrated(learnt: Identifier, own: np.ndarray, entropy: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Bounds of each language from its calibration documents.

    All are medians, so that a minority of odd documents moves them little. The spread of a language's documents is joined with
    that of all, the more so the fewer it has; without any it has the mean of the language of the largest. Without any in
    all nothing is known of costs, and nothing is rejected.
    """
    out = np.tile([0.0, 1.0, 1.0, np.inf], (len(learnt.languages), 1))
    if not len(own):
        return out
    rows = [np.flatnonzero(own == k) for k in range(len(out))]
    means = np.array([np.median(entropy[r]) if len(r) else -np.inf for r in rows])
    means[np.isinf(means)] = means.max()

    def joined(n: int, mine: np.ndarray, others: np.ndarray) -> np.ndarray:
        return (n * mine + PRIOR_ROWS * others) / (n + PRIOR_ROWS)

    def spread(r: np.ndarray) -> np.ndarray:
        """Variance within and between the rows' documents."""
        off, n = (entropy[r] - means[own[r]]) ** 2, chars[r]
        return np.array([np.median(off * n), np.median(off[n >= np.median(n)])]) / 0.455  # median of a squared normal deviate

    def middle(r: np.ndarray, within: float, between: float) -> np.ndarray:
        """Median deviation, and the standard deviation of deviations by their median."""
        z = (entropy[r] - means[own[r]]) / np.sqrt(within / chars[r] + between)
        return np.array([np.median(z), np.median(np.abs(z - np.median(z))) / 0.6745])

    every = np.arange(len(own))
    overall = joined(len(own), spread(every), np.array(PRIOR))
    for k, r in enumerate(rows):
        within, between = joined(len(r), spread(r), overall) if len(r) else overall
        between *= 1 + np.pi / 2 / max(len(r), 1)  # the mean is a median of so many
        at, width = joined(len(r), middle(r, within, between), middle(every, within, between)) if len(r) else middle(every, within, between)
        out[k] = means[k], within, between, at + SLACK * max(width, 1.0)
    return out


def identify(docs: DataFrame, learnt: Identifier) -> DataFrame:
    """``docs`` with lang_pred, score and rejected for each whole ``text``, instead of columns so named if there are any.

    lang_pred is a language that was learnt, or ``und`` (score 0, rejected) if the text is null or has no letter or no
    language was learnt. Equal entropies go to the language that sorts first. ``rejected`` also marks texts that cost
    more than the language's own documents do, by the bound set in calibration.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    schema = T.StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(learnt)  # at most MOST_GRAMS grams of each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, memo = [*shared.value.languages, UNKNOWN], shared.value.memo()
        for batch in slices(batches):
            best, score, rejected = shared.value.predict(*text_bytes(batch.column(at)), memo)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([names[i] for i in best.tolist()]), pa.array(score), pa.array(rejected)], names=schema.names)

    return docs.mapInArrow(run, schema)


def predict_languages(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each row, learnt from the rows that aren't held out.

    Held out are documents whose crc32(doc_id as text) leaves 0 modulo 5; a null doc_id is held out.
    """
    held = F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(True))
    learnt = train(docs.where(~held), per_language)
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), learnt).drop("text")


def keep_identified(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with their own columns."""
    own = docs.columns
    held = F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(True))
    learnt = train(docs.where(~held), per_language)
    return identify(docs.select(F.struct(*own).alias("q_row"), "text"), learnt).where(~F.col("rejected")).select("q_row.*")
