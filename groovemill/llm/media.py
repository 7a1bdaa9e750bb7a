"""Operator 8: media columns as PNG files in binary columns.

Payload bytes become the samples of an 8-bit grey image, 64 to a row. The file is written chunk by chunk: each row is
filtered (none, left or up neighbour, whichever leaves least), rows are deflated, and each chunk has its checksum. Reading
tests the checksums and undoes all five filters with numpy. The feature is a 64-bit hash of the low frequencies of
the image's cosine transform.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices, text_bytes

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, LEFT, UP, AVERAGE, PAETH = range(5)

WIDTH = 64
#: Side of the reduced image, and of the block of low frequencies.
REDUCED, LOW = 32, 8


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(samples: np.ndarray) -> bytes:
    """A grey 8-bit PNG of the rows of ``samples``."""
    height, width = samples.shape
    left, up = samples.copy(), samples.copy()
    left[:, 1:] -= samples[:, :-1]
    up[1:] -= samples[:-1]
    options = np.stack([samples, left, up])
    cost = np.abs(options.view(np.int8).astype(np.int16)).sum(axis=2)
    kind = cost.argmin(axis=0)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = kind
    rows[:, 1:] = options[kind, np.arange(height)]
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def _along_diagonals(kind: int, some: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Samples of a run of average or Paeth rows below ``above``. A sample depends on those left, above and above left, so all on a diagonal are undone at once."""
    height, width = some.shape
    out = np.zeros((height + 1, width + 1), np.int16)  # a column of zeros before the first
    out[0, 1:] = above
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        if kind == AVERAGE:
            guess = (left + up) >> 1
        else:
            a, b, c = (np.abs(left + up - corner - v) for v in (left, up, corner))
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        out[y + 1, x + 1] = (some[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Samples of filtered rows; runs of rows of one filter are undone together where the filter allows it."""
    height, width = rows.shape
    out = np.zeros((height + 1, width), np.uint8)  # out[0] is the row above the first
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip(np.concatenate([[0], edges]).tolist(), np.concatenate([edges, [height]]).tolist(), strict=True):
        kind, some = kinds[a], rows[a:b]
        if kind == NONE:
            out[a + 1 : b + 1] = some
        elif kind == LEFT:
            out[a + 1 : b + 1] = np.cumsum(some, axis=1, dtype=np.uint8)
        elif kind == UP:
            out[a + 1 : b + 1] = np.cumsum(some, axis=0, dtype=np.uint8) + out[a]
        elif kind in (AVERAGE, PAETH):
            out[a + 1 : b + 1] = _along_diagonals(int(kind), some, out[a])
        else:
            raise ValueError(f"unknown filter {kind}")
    return out[1:]


def decode_png(media: bytes) -> np.ndarray:
    """Samples of a grey 8-bit PNG; raises ValueError if it is damaged or of another kind."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, size, packed = 8, None, []
    while at < len(media):
        (length,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + length]
        if len(media) < at + 12 + length or struct.unpack_from(">I", media, at + 8 + length)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("not a plain grey 8-bit image")
            size = height, width
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + length
    if size is None:
        raise ValueError("no header")
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(rows) != size[0] * (size[1] + 1):
        raise ValueError("wrong number of samples")
    rows = rows.reshape(size[0], size[1] + 1)
    return _unfilter(rows[:, 0], rows[:, 1:])


@functools.lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(REDUCED)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * REDUCED))


def low_frequencies(samples: np.ndarray) -> bytes:
    """8 bytes: which of the 8 x 8 lowest frequencies of the image, reduced to 32 x 32 means, exceed their median.

    Slight changes leave most bits as they are where all frequencies have a share, as in texts' bytes; frequencies that
    an image hardly has all lie at the median, and their bits turn easily.
    """
    means = samples.astype(np.float64)
    for axis in (0, 1):
        length = means.shape[axis]
        edges = np.arange(REDUCED + 1) * length // REDUCED
        total = np.concatenate([np.zeros_like(means.take([0], axis)), means.cumsum(axis)], axis)
        high = np.maximum(edges[1:], edges[:-1] + 1)  # fewer rows than means: rows are repeated
        span = (high - edges[:-1]).reshape((-1, 1) if axis == 0 else (1, -1))
        means = (total.take(high, axis) - total.take(edges[:-1], axis)) / span
    waves = np.round(_cosines() @ means @ _cosines().T, 6).ravel()
    return np.packbits(waves > np.median(waves)).tobytes()


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (PNG) of each row's whole ``text``.

    The payload is the text's UTF-8 bytes (null: none) with bytes 0 up to a positive multiple of 64. Rows stay as they
    are; equal texts give equal files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, ends = text_bytes(batch.column(1))
            files = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                payload = np.zeros(max(1, -(-(b - a) // WIDTH)) * WIDTH, np.uint8)
                payload[: b - a] = data[a:b]
                files.append(encode_png(payload.reshape(-1, WIDTH)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """``stored`` (doc_id, n_bytes, media) with the payload read back from the file and its hash (both binary).

    A null file gives nulls; a damaged one fails the query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            images = [None if m is None else decode_png(m) for m in batch.column(2).to_pylist()]
            payloads = pa.array([None if i is None else i.tobytes() for i in images], pa.binary())
            hashes = pa.array([None if i is None else low_frequencies(i) for i in images], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, payloads, hashes], names=["doc_id", "n_bytes", "media", "payload", "wave_hash"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, wave_hash binary")


def digests(read: DataFrame) -> DataFrame:
    """The digest columns of ``read_media``'s rows, by Spark's own functions."""
    payload, media = F.col("payload"), F.col("media")
    return read.select(
        "doc_id",
        "n_bytes",
        F.length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -WIDTH, WIDTH)).alias("tail_crc32"),
        F.length(media).cast("long").alias("media_bytes"),
        F.sha2(media, 256).alias("media_sha256"),
        F.lower(F.hex("wave_hash")).alias("feature"),
    )
