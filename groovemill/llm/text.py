"""Byte views of Arrow text columns, and their split into words and chunks.

Null texts count as empty everywhere in this module.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most bytes of text that a task works on at once.
SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Kinds of bytes between which chunks are cut: letters, digits and signs; 0 for all else. Apostrophes are part of contractions, and ``<|>`` of special tokens.
LETTER, DIGIT, SIGN = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[48:58] = DIGIT
_KIND[[ord(c) for c in '!"#$%&()*+,-./:;=?@[\\]^_`{}~']] = SIGN


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column as one array, and where each row starts and ends in it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


@functools.lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def give_back() -> None:
    """Returns free memory to the system, which an idle worker would keep from those beside it."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text, or of one row."""
    for batch in batches:
        _, ends = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
            give_back()


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z made a-z, every other byte left alone."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def _pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings data[start:end]; each has to start where the last one ended or later."""
    if not len(starts):
        return pa.array([], pa.binary())
    if len(starts) == 1 or (starts[1:] == ends[:-1]).all():
        bounds, body = np.append(starts, ends[-1]), data
    else:
        inside = np.zeros(len(data) + 1, np.int8)
        full = ends > starts  # an empty piece adds no byte
        inside[starts[full]] += 1
        inside[ends[full]] -= 1
        body = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
        bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(body)])


def words(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all rows, and the first word's number of each row (one more entry at the end)."""
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(len(ends), np.int64)
    dark = ~_SPACE[data]
    before = np.concatenate([[False], dark[:-1]])
    before[ends[:-1][ends[:-1] < len(data)]] = False
    after = np.concatenate([dark[1:], [False]])
    after[ends[1:][ends[1:] > 0] - 1] = False
    starts, stops = np.flatnonzero(dark & ~before), np.flatnonzero(dark & ~after) + 1
    return _pieces(data, starts, stops), np.searchsorted(starts, ends)


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte; both bytes of a letter from U+00C0 to U+00FF are letters."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    after = data[lead + 1]
    lead = lead[(after & 0xC0 == 0x80) & (after != 0x97) & (after != 0xB7)]  # not the signs of multiplication and division
    kind[lead] = kind[lead + 1] = LETTER
    return kind


def _lower_letters(data: np.ndarray) -> np.ndarray:
    """A-Z and U+00C0 to U+00DE made lower case."""
    out = lowered(data)
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    out[after[(data[after] < 0x9F) & (data[after] != 0x97)]] += 0x20
    return out


def chunks(data: np.ndarray, ends: np.ndarray, fold: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Rows cut before every white-space run that follows something dark and between kinds of bytes, as ``words`` returns them.

    Such a cut is where the patterns of the public byte-level tokenizers cut as well, so that the chunks of a
    text can be encoded apart. No cut is made after white space outside ASCII, since a run of white space has to
    stay whole, and none beside other bytes outside ASCII than those of the letters up to U+00FF.

    fold: for tokenizers that drop white space and case. Chunks then lose the white space before them, and those of
    nothing but letters are lower case.
    """
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(len(ends), np.int64)
    space, kind = _SPACE[data], _kinds(data)
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = space[1:] & ~space[:-1]
    at = np.flatnonzero(cut)
    one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    odd = (one >= 0x1C) & (one <= 0x1F) | (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three == 0xE1) & (two == 0x9A) | (three == 0xE2) & ((two == 0x80) | (two == 0x81)) | (three == 0xE3) & (two == 0x80)
    cut[at[odd]] = False
    cut[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    cut[ends[:-1][ends[:-1] < len(data)]] = True
    starts = np.flatnonzero(cut)
    stops, firsts = np.append(starts[1:], len(data)), np.searchsorted(starts, ends)
    if fold:
        dark = np.append(np.flatnonzero(~space), len(data))
        starts = np.minimum(dark[np.searchsorted(dark, starts)], stops)
        letters = bounds_of(kind == LETTER)
        plain = (letters[stops] - letters[starts] == stops - starts) & (stops > starts)
        small = np.zeros(len(data) + 1, np.int8)
        small[starts[plain]] += 1
        small[stops[plain]] -= 1
        data = np.where(np.cumsum(small[:-1], dtype=np.int8) > 0, _lower_letters(data), data)
    return _pieces(data, starts, stops), firsts


class Memo:
    """What was computed for distinct strings, kept from one batch to the next.

    Holds at most ``most`` strings, or those of one batch; when it is full, only the strings of the last batch stay.
    """

    def __init__(self, compute: Callable[[list[bytes]], pa.Array], most: int = 1 << 19):
        self.compute, self.most = compute, most
        self.known, self.values = pa.array([], pa.binary()), None

    def __call__(self, distinct: pa.BinaryArray) -> pa.Array:
        """The values of the strings, in their order."""
        found = pc.index_in(distinct, self.known)
        new = found.is_null()
        fresh, at = distinct.filter(new), found.fill_null(0).to_numpy().astype(np.int64)
        new = new.to_numpy(zero_copy_only=False)
        if self.values is None or len(self.known) + len(fresh) > self.most:
            used = found.drop_null()
            self.known = self.known.take(used)
            self.values = None if self.values is None else self.values.take(used)
            at[~new] = np.arange(len(used))
        at[new] = len(self.known) + np.arange(len(fresh))
        if len(fresh) or self.values is None:
            got = self.compute(fresh.to_pylist())
            self.known = pa.concat_arrays([self.known, fresh])
            self.values = got if self.values is None else pa.concat_arrays([self.values, got])
        return self.values.take(pa.array(at))


def bounds_of(lengths: np.ndarray) -> np.ndarray:
    """0 and the running sums of the lengths."""
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]; an empty range has 0. Each sum is taken on its own, so it doesn't depend on the rows beside it."""
    out = np.zeros(len(bounds) - 1, values.dtype)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, bounds[:-1][full])
    return out
