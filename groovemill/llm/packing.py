"""Operator 10: best-fit packing after the dominance reduction of Martello and Toth.

Only the number of pieces of each length matters for the packing, and lengths don't exceed the capacity; so the driver
gets a histogram of at most ``capacity`` rows, whatever the input, and plans patterns (lengths in one sequence, and how
many sequences have them). The reduction fixes sets that dominate all others with the same piece:

* a piece alone, if nothing fits beside it;
* a piece with its exact complement;
* a piece with the largest partner that fits, if no two pieces fit beside it.

The rest is packed best-fit, longest first. Pieces then find their pattern by their rank among the pieces of their length, on all executors: tasks number
the pieces of each length that they cut, and a running sum over tasks makes the numbers global.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored
from .subwords import encode_rows, library_encoder
from .text import slices, text_bytes

CAPACITY = 1024


class Lengths:
    """Counts of the lengths that are left."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, count in counts.items():
            self.n[length] += count

    def largest(self, most: int) -> int:
        """The largest length of at most ``most`` that is left, or 0."""
        found = np.flatnonzero(self.n[: max(most, 0) + 1])
        return int(found[-1]) if len(found) else 0

    def two_smallest(self) -> int:
        """What the two smallest pieces take; more than any room if there is just one."""
        found = np.flatnonzero(self.n)
        if not len(found) or len(found) == 1 and self.n[found[0]] < 2:
            return len(self.n)
        return int(2 * found[0] if self.n[found[0]] > 1 else found[0] + found[1])


def reduce_by_dominance(left: Lengths, capacity: int) -> Counter:
    """Takes sets out of ``left`` that some optimal packing has, until no rule finds another."""
    fixed: Counter = Counter()
    changed = True
    while changed:
        changed = False
        for a in np.flatnonzero(left.n)[::-1].tolist():
            while left.n[a]:
                free = capacity - a
                left.n[a] -= 1
                partner, two = left.largest(free), left.two_smallest()
                left.n[a] += 1
                if not partner:
                    chosen, times = (a,), int(left.n[a])
                elif partner == free or two > free:
                    chosen, times = (a, partner), int(left.n[a] // 2 if a == partner else min(left.n[a], left.n[partner]))
                else:
                    break
                fixed[chosen] += times
                for length in chosen:
                    left.n[length] -= times
                changed = True
    return fixed


def best_fit(left: Lengths, capacity: int) -> Counter:
    """Packs all of ``left``, longest first, each piece into the open sequence that it fills best."""
    closed: Counter = Counter()
    gaps: defaultdict[int, Counter] = defaultdict(Counter)  # open patterns by free room
    for a in np.flatnonzero(left.n)[::-1].tolist():
        rest, left.n[a] = int(left.n[a]), 0
        while rest:
            room = min((r for r in gaps if r >= a), default=capacity)
            fits = min(room // a, rest)
            if room in gaps:
                pattern, times = next(iter(gaps[room].items()))
                used = min(times, rest // fits)
                gaps[room][pattern] -= used
                gaps[room] += Counter()
                if not gaps[room]:
                    del gaps[room]
            else:
                pattern, used = (), rest // fits
            gaps[room - fits * a][pattern + (a,) * fits] += used
            rest -= used * fits
        least = np.flatnonzero(left.n)
        for room in [r for r in gaps if not len(least) or r < least[0]]:
            closed.update(gaps.pop(room))
    return closed


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how many sequences have each; together they use every length as often as ``counts`` says.

    Work and result depend on the capacity, not on the counts.
    """
    left = Lengths(counts, capacity)
    found = reduce_by_dominance(left, capacity) + best_fit(left, capacity)
    return sorted(((pattern, times) for pattern, times in found.items() if times), key=lambda x: (-sum(x[0]), x[0]))


def slots_of(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Ranges of ranks by length: pieces ``first`` to before the next range go to sequences from ``base`` on, ``per`` of
    them in each, from ``offset`` on. Sorted by key, which is the length's high bits and the first rank."""
    given, base, rows = Counter(), 0, []
    for pattern, times in patterns:
        offset = 0
        for length, per in sorted(Counter(pattern).items(), reverse=True):
            rows.append((length << 44 | given[length], base, per, offset))
            given[length] += times * per
            offset += per * length
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("key", "base", "per", "offset"), table.T.copy(), strict=True))


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Each document's pieces: doc_id, piece, start, length, ids_crc32, and part and rank (its number among the pieces
    of its length that the same task cut).

    A null or empty text is one piece with just the end id. Only documents of more than ``capacity`` ids are cut; their
    first piece is the shorter one. Repeated rows are packed as often as they occur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = library_encoder(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            ids, bounds = encode_rows(*text_bytes(batch.column(1)), encode)
            body = memoryview(ids.astype("<u4")).cast("B")
            total = np.diff(bounds) + 1
            pieces = -(-total // capacity)
            row = np.repeat(np.arange(len(total)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = total - (pieces - 1) * capacity
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[row], capacity)
            last = piece == pieces[row] - 1
            first = bounds[row] + start
            sums = [zlib.crc32(tail, zlib.crc32(body[4 * a : 4 * (a + n - 1)])) if ended else zlib.crc32(body[4 * a : 4 * (a + n)]) for a, n, ended in zip(first.tolist(), length.tolist(), last.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            runs = length[order]
            fresh = np.concatenate([[True], runs[1:] != runs[:-1]])
            begin = np.flatnonzero(fresh)
            rank = np.empty(len(row), np.int64)
            rank[order] = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row)))) + seen[runs]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(np.full(len(row), part, np.int64)), pa.array(rank)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` ids, each filled from 0 without gaps.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece. The pieces' table is written
    once, since their ranks have to stay as they are when a task runs again. An empty table gives no rows.
    """
    pieces = stored(cut_pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    counted = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = slots_of(plan_patterns(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, length, crc, rank = batch.columns
            key = length.to_numpy() << 44 | rank.to_numpy()
            at = np.searchsorted(slots["key"], key, side="right") - 1
            nth = key - slots["key"][at]
            sequence = slots["base"][at] + nth // slots["per"][at]
            offset = slots["offset"][at] + nth % slots["per"][at] * length.to_numpy()
            yield pa.RecordBatch.from_arrays([*kept, length, crc, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = pieces.join(starts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("earlier")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
