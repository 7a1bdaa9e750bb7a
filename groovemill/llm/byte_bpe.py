"""Operator 2: byte-level BPE encoding and decoding on padded numpy matrices.

Distinct pre-tokens are bucketed by length into padded matrices of token ids. In each round every row merges its
leftmost pair of lowest rank; a row then is one column shorter, so that the matrix shrinks with its rows, and rows
without a pair left are taken out. Ranks of pairs come from a hash table with open addressing.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .subwords import Encode, encode_rows, load_ranks
from .text import bounds_of, slices, text_bytes

#: Widths of the matrices; longer pre-tokens are merged on a heap by the same rule.
WIDTHS = (2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 256)
#: Cells of a matrix at most.
CELLS = 1 << 20
#: Rank of what can't be merged.
NEVER = np.int32(2**31 - 1)


class PairTable:
    """Merged id by pair of ids, in arrays with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(2 * len(merged) + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NEVER, np.int32)
        keys = left.astype(np.int64) << 32 | right
        slot, waiting = self._slot(keys), np.arange(len(keys))
        while len(waiting):
            free = waiting[self.keys[slot[waiting]] == -1]
            self.keys[slot[free]] = keys[free]  # of several for one slot the last stays
            placed = self.keys[slot[waiting]] == keys[waiting]
            self.values[slot[waiting[placed]]] = merged[waiting[placed]]
            waiting = waiting[~placed]
            slot[waiting] = (slot[waiting] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged pairs' ids, NEVER where a pair can't be merged or has padding (-1)."""
        keys = left.astype(np.int64) << 32 | right
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NEVER)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class ByteBpe:
    """Ids of pre-tokens by the ranks of their parts, and the bytes of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.table = PairTable(*np.array(pairs or [(0, 0, 0)], np.int64).T[:, : len(pairs)])
        self.by_pair = None
        self.ranks = ranks
        size = max(ranks.values()) + 1
        names = [b""] * size
        for token, rank in ranks.items():
            names[rank] = token
        self.names = pa.array(names, pa.large_binary())
        self.decimals = pa.array([b"%d " % i for i in range(size)], pa.large_binary())

    def _matrix(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged rows of a padded matrix: ids in a row and the number of each row."""
        rows, out = np.arange(len(ids)), []
        counts = np.zeros(len(ids), np.int64)
        ranks = self.table.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            line = np.arange(len(rows))
            best = ranks[line, at] if ranks.shape[1] else np.full(len(rows), NEVER)
            done = best == NEVER
            if done.any():
                ended = ids[done]
                counts[rows[done]] = (ended >= 0).sum(axis=1)
                out.append((rows[done], ended))
                keep = ~done
                rows, ids, ranks, at, best, line = rows[keep], ids[keep], ranks[keep], at[keep], best[keep], np.arange(int(keep.sum()))
            if not len(rows):
                break
            ids[line, at] = best
            stay = np.ones(ids.shape, bool)
            stay[line, at + 1] = False
            ids = ids[stay].reshape(len(rows), -1)
            ranks = ranks[stay[:, 1:]].reshape(len(rows), -1)
            for shift in (-1, 0):  # the pairs to the left and to the right of the merged one
                has = (at + shift >= 0) & (at + shift < ranks.shape[1])
                r, c = line[has], at[has] + shift
                ranks[r, c] = self.table.rank(ids[r, c], ids[r, c + 1])
        starts = bounds_of(counts)
        flat = np.empty(starts[-1], np.int32)
        for which, ended in out:
            real = ended >= 0
            flat[np.repeat(starts[which], counts[which]) + (np.cumsum(real, axis=1) - 1)[real]] = ended[real]
        return flat, counts

    def _heap(self, piece: bytes) -> list[int]:
        """One long pre-token; the heap gives the leftmost pair of lowest rank."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        if self.by_pair is None:
            full = self.table.keys >= 0
            self.by_pair = dict(zip(self.table.keys[full].tolist(), self.table.values[full].tolist(), strict=True))
        last, after, before = len(ids) - 1, list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        pair = lambda i: self.by_pair.get(ids[i] << 32 | ids[after[i]]) if i >= 0 and after[i] <= last else None
        heap = [(rank, i) for i in range(last) if (rank := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if ids[i] < 0 or pair(i) != rank:
                continue
            gone = after[i]
            ids[i], ids[gone], after[i] = rank, -1, after[gone]
            if after[i] <= last:
                before[after[i]] = i
            for j in (before[i], i):
                if (found := pair(j)) is not None:
                    heapq.heappush(heap, (found, j))
        return [x for x in ids if x >= 0]

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens in their order, and the number of each."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data, starts = np.frombuffer(b"".join(pieces), np.uint8), bounds_of(lengths)
        bucket = np.searchsorted(WIDTHS, lengths)
        counts, parts = np.zeros(len(pieces), np.int64), []
        for b, width in enumerate(WIDTHS):
            rows = np.flatnonzero((bucket == b) & (lengths > 0))
            for i in range(0, len(rows), max(1, CELLS // width)):
                some = rows[i : i + max(1, CELLS // width)]
                cell = np.arange(width)[None, :]
                inside = cell < lengths[some][:, None]
                ids = np.where(inside, self.byte_ids[data[np.minimum(starts[some][:, None] + cell, len(data) - 1)]], -1).astype(np.int32)
                flat, counts[some] = self._matrix(ids)
                parts.append((some, flat))
        for i in np.flatnonzero(bucket == len(WIDTHS)).tolist():
            ids = self._heap(pieces[i])
            counts[i] = len(ids)
            parts.append((np.array([i]), np.array(ids, np.int32)))
        to = bounds_of(counts)
        out = np.empty(to[-1], np.int32)
        for some, flat in parts:
            n = counts[some]
            out[np.repeat(to[some] - bounds_of(n)[:-1], n) + np.arange(len(flat))] = flat
        return out, counts

    def encoder(self, pattern: str) -> Encode:
        """Encodes strings: each match of the pattern is a pre-token."""
        import regex

        find = regex.compile(pattern).findall

        def encode(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            number: dict[str, int] = {}
            which, found = [], []
            for s in strings:
                pieces = find(s.decode("utf-8", "replace"))
                found.append(len(pieces))
                which += [number.setdefault(p, len(number)) for p in pieces]
            ids, lengths = self.encode([p.encode() for p in number])
            lists = pa.LargeListArray.from_arrays(pa.array(bounds_of(lengths)), pa.array(ids))
            which = np.array(which, np.int64)
            return lists.take(pa.array(which)).flatten().to_numpy(), np.diff(bounds_of(lengths[which])[bounds_of(np.array(found, np.int64))])

        return Encode(encode)

    def decode(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of all ids in a row, and each id's place in them."""
        return _joined(self.names.take(pa.array(ids)))

    def written(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The decimal ids, a space after each, and each id's place in them."""
        return _joined(self.decimals.take(pa.array(ids)))


def _joined(strings: pa.LargeBinaryArray) -> tuple[memoryview, np.ndarray]:
    _, offsets, data = strings.buffers()
    return memoryview(data or b""), np.frombuffer(offsets, np.int64)[: len(strings) + 1]


@functools.lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    """The tables for the ranks at ``path``."""
    return ByteBpe(load_ranks(path))


@functools.lru_cache(maxsize=4)
def matrix_encoder(path: str, pattern: str) -> Encode:
    """Encodes strings by the ranks at ``path``."""
    return load(path).encoder(pattern)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of each row's whole ``text``.

    Null and empty texts have no ids. Rows stay as they are, repeated ones as well; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = matrix_encoder(ranks_path, pattern)
        for batch in slices(batches):
            flat, bounds = encode_rows(*text_bytes(batch.column(1)), encode)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and the decoded bytes of each row's ``ids``; null ids give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path)
        for batch in batches:
            ids = batch.column(1)
            bounds = bounds_of(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            body, at = bpe.decode(ids.flatten().to_numpy(zero_copy_only=False))
            texts = [body[a:b].tobytes() for a, b in zip(at[bounds[:-1]].tolist(), at[bounds[1:]].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encodes each whole text, decodes the ids again, and returns digests of both.

    doc_id, n_tokens, ids_sha256 (of the decimal ids joined by spaces), decoded_sha256. A null or empty text has no
    tokens and the digests of the empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path)
        encode = matrix_encoder(ranks_path, pattern)
        for batch in slices(batches):
            ids, bounds = encode_rows(*text_bytes(batch.column(1)), encode)
            first, last = bounds[:-1].tolist(), bounds[1:].tolist()
            body, at = bpe.decode(ids)
            decoded = [hashlib.sha256(body[at[a] : at[b]]).hexdigest() for a, b in zip(first, last, strict=True)]
            body, at = bpe.written(ids)
            listed = [hashlib.sha256(body[at[a] : max(at[a], at[b] - 1)]).hexdigest() for a, b in zip(first, last, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(listed), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
