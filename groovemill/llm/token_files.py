"""Operator 9: token ids in binary blocks of byte-aligned codes of variable length.

Documents are sorted by doc_id and encoded; a block holds whole documents. Its ids are replaced by their rank of
frequency in the block, most frequent first (ties by id), and a rank takes 1 to 4 bytes. The byte counts stand apart,
four to a control byte, so that a table from control bytes to lengths lets numpy decode a block without a loop.
Blocks are the rows of a Parquet table in the cluster's shared folder: Spark's writer commits them, and any machine
can read them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored
from .subwords import encode_rows, library_encoder
from .text import bounds_of, slices, text_bytes

MAGIC = b"FRB2"
#: Magic, documents, ids, distinct ids, data bytes, checksum of what follows.
HEADER = struct.Struct("<4sIIQIQI")
#: Byte lengths of the four codes of each control byte.
LENGTHS = np.stack([(np.arange(256) >> shift & 3) + 1 for shift in (0, 2, 4, 6)], axis=1).astype(np.uint8)
#: Text bytes that a block takes at most, unless one document has more.
BLOCK_BYTES = 4 << 20


def pack_codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype(np.uint32)
    extra = (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    at = bounds_of(extra.astype(np.int64) + 1)
    data = np.zeros(at[-1], np.uint8)
    for byte in range(4):
        has = np.flatnonzero(extra >= byte)
        data[at[has] + byte] = (values[has] >> np.uint32(8 * byte)).astype(np.uint8)
    return control.astype(np.uint8), data


def unpack_codes(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n values of ``pack_codes``."""
    lengths = LENGTHS[control].ravel()[:n]
    at = bounds_of(lengths)[:-1]
    values = np.zeros(n, np.uint32)
    for byte in range(4):
        has = np.flatnonzero(lengths > byte)
        values[has] |= data[at[has] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return values


def pack_block(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, n_null: int = 0) -> bytes:
    """One block: header, document ids and lengths, ids by rank, control bytes, data bytes. The first ``n_null`` documents have no id."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    used = np.flatnonzero(counts)
    ranked = used[np.argsort(-counts[used], kind="stable")]
    rank = np.zeros(len(counts), np.uint32)
    rank[ranked] = np.arange(len(ranked))
    control, data = pack_codes(rank[ids])
    body = b"".join(x.tobytes() for x in (doc_ids.astype("<i8"), lengths.astype("<u4"), ranked.astype("<u4"), control, data))
    return HEADER.pack(MAGIC, len(doc_ids), n_null, len(ids), len(ranked), len(data), zlib.crc32(body)) + body


def unpack_block(block: bytes) -> tuple[np.ma.MaskedArray, np.ndarray, np.ndarray]:
    """Document ids (masked where there is none), lengths and ids of a block; raises ValueError if it is damaged."""
    magic, n_docs, n_null, n_ids, n_ranked, n_data, check = HEADER.unpack_from(block)
    body = memoryview(block)[HEADER.size :]
    if magic != MAGIC or zlib.crc32(body) != check:
        raise ValueError("damaged block of token ids")
    parts, at = [], 0
    for kind, n in (("<i8", n_docs), ("<u4", n_docs), ("<u4", n_ranked), ("u1", -(-n_ids // 4)), ("u1", n_data)):
        parts.append(np.frombuffer(body, kind, n, at))
        at += parts[-1].nbytes
    doc_ids, lengths, ranked, control, data = parts
    return np.ma.array(doc_ids, mask=np.arange(n_docs) < n_null), lengths, ranked[unpack_codes(control, data, n_ids)]


def encode_blocks(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """All documents in ascending doc_id as blocks: part and seq (their order), n_docs, n_ids and block (binary).

    A null or empty text has just the end id. Rows that repeat a doc_id stand in the order of their texts; those
    without a doc_id stand first. Rows are dealt out by ranges of doc_id and a hash of the text,
    so that a repeated doc_id can be spread as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = library_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in slices(batches, most=BLOCK_BYTES):
            ids, bounds = encode_rows(*text_bytes(batch.column(1)), encode)
            ends = np.zeros(len(ids) + batch.num_rows, np.int64)
            last = bounds[1:] + np.arange(batch.num_rows)
            inner = np.ones(len(ends), bool)
            inner[last] = False
            ends[inner], ends[last] = ids, end_id
            block = pack_block(batch.column(0).fill_null(0).to_numpy(), np.diff(bounds) + 1, ends, batch.column(0).null_count)  # nulls stand first
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int64()), (seq, pa.int64()), (batch.num_rows, pa.int64()), (len(ends), pa.int64()), (block, pa.binary()))], names=["part", "seq", "n_docs", "n_ids", "block"])
            seq += 1

    dealt = docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text"))
    return dealt.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text").mapInArrow(run, "part long, seq long, n_docs long, n_ids long, block binary")


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """What the blocks hold, by document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    ids_crc32 is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc_ids, lengths, ids = unpack_block(block)
                bounds, body = bounds_of(lengths), memoryview(ids.astype("<u4")).cast("B")
                sums = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc_ids), part)), pa.array(np.full(len(doc_ids), seq)), pa.array(doc_ids.data, mask=doc_ids.mask), pa.array(bounds[:-1]), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())],
                    names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    documents = blocks.select("part", "seq", "block").mapInArrow(run, "part long, seq long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    before = (Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("part_start"))
    starts = blocks.select("part", "seq", F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(*before)), F.lit(0)).alias("block_start"))
    starts = starts.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("block_start")).alias("block_start"))
    return documents.join(starts, ["part", "seq"]).select("doc_id", (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """``decode_blocks`` of the blocks of ``docs``, which are written to the shared folder first."""
    return decode_blocks(stored(encode_blocks(docs, tokenizer_path, end_id), "token-blocks"))
