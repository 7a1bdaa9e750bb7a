"""Operators with state, timers and expiry: anchored batches of arrivals, and a cache of what lookups didn't find."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from groovemill.operators.batches import SPAN_SECONDS

BATCHES = "key string, run_at timestamp, n long, ids array<bigint>, late boolean"
#: Lookups that found nothing are asked again after so many days.
TTL_DAYS = 30
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Sets the state store that these operators need, for queries that are started from now on."""
    spark.conf.set(_PROVIDER, _ROCKS)


def anchored(arrivals: list[tuple[int, int]], span: int) -> list[list[tuple[int, int]]]:
    """Arrivals (at, id) cut into batches of up to ``span`` from the first of each."""
    found: list[list[tuple[int, int]]] = []
    for at, i in sorted(arrivals):
        if not found or at - found[-1][0][0] > span:
            found.append([])
        found[-1].append((at, i))
    return found


class _Anchored(StatefulProcessor):
    """State of a key: arrivals of batches that aren't closed yet, the first of them, and up to when batches are closed."""

    def __init__(self, span: int, shift: int):
        self.span, self.shift = span, shift  # microseconds; shift: by how much Spark's watermark is behind that of arrivals

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "at long, id long")
        self.marks = handle.getValueState("marks", "first long, closed long")

    def _now(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() * 1000 + self.shift if timers.getCurrentWatermarkInMs() > 0 else -1

    @staticmethod
    def _rows(key: tuple, batches: list[list[tuple[int, int]]], late: bool) -> Iterator[pd.DataFrame]:
        if batches:
            yield pd.DataFrame({"key": [key[0]] * len(batches), "run_at": [b[-1][0] for b in batches], "n": [len(b) for b in batches], "ids": [[i for _, i in b] for b in batches], "late": [late] * len(batches)})

    def _settle(self, key: tuple, first: int | None, closed: int, now: int) -> Iterator[pd.DataFrame]:
        """Gives out the batches that nothing can join any more, and sets the timer of the next."""
        if first is not None and first + self.span < now:
            batches = anchored(list(self.open.get()), self.span)
            done = [b for b in batches if b[0][0] + self.span < now]
            rest = [x for b in batches[len(done) :] for x in b]
            closed, first = done[-1][0][0] + self.span, rest[0][0] if rest else None
            if rest:
                self.open.put(rest)
            else:
                self.open.clear()
            yield from self._rows(key, done, False)
        self.marks.update((first, closed))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if first is not None:
            self.handle.registerTimer(max(0, (first + self.span - self.shift) // 1000 + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, closed = self.marks.get() if self.marks.exists() else (None, -(2**62))
        new = [(int(at), int(i)) for frame in rows for at, i in zip(frame["at"], frame["id"], strict=True)]
        late, fit = [x for x in new if x[0] <= closed], [x for x in new if x[0] > closed]
        yield from self._rows(key, anchored(late, self.span), True)
        if fit:
            self.open.appendList(fit)
            first = min([x[0] for x in fit] + ([first] if first is not None else []))
        yield from self._settle(key, first, closed, self._now(timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.marks.exists():
            first, closed = self.marks.get()
            yield from self._settle(key, first, closed, self._now(timerValues))

    def close(self) -> None:
        pass


def anchored_stream(stream: DataFrame, late_seconds: int = 600, span_seconds: int = SPAN_SECONDS, grace_days: int = 30) -> DataFrame:
    """key, run_at (last arrival), n, ids (in order of arrival) and late of batches of arrivals (key, id, seen_at).

    A batch takes arrivals up to ``span_seconds`` after its first one, whatever the gaps and in whatever order they come, and is
    given out once the watermark, ``late_seconds`` behind the latest arrival of all keys, has left it. Arrivals for what
    has been given out aren't lost: they come as batches of their own, with ``late`` true, so that they can be counted,
    or put into the registry. Only what is more than ``grace_days`` behind is dropped by Spark, which counts
    it as dropped by watermark. Rows without a key or time are left out. The state of a key is its open batches.
    """
    grace = max(grace_days * 86_400, late_seconds)
    timed = stream.where("key IS NOT NULL AND seen_at IS NOT NULL").withWatermark("seen_at", f"{grace} seconds").select("key", "id", "seen_at", F.unix_micros(F.col("seen_at").cast("timestamp")).alias("at"))
    found = timed.groupBy("key").transformWithStateInPandas(_Anchored(span_seconds * 1_000_000, (grace - late_seconds) * 1_000_000), "key string, run_at long, n long, ids array<bigint>, late boolean", "append", "eventtime")
    return found.select("key", F.timestamp_micros("run_at").alias("run_at"), "n", "ids", "late")


def late_counts(batches: DataFrame) -> DataFrame:
    """key, n_late: arrivals that came after their batch had been given out."""
    return batches.where("late").groupBy("key").agg(F.sum("n").alias("n_late"))


def blocks_lookup(status: Column, fetched_at: Column, now: Column, ttl_days: int = TTL_DAYS) -> Column:
    """True where a lookup that found nothing is too recent to be asked again."""
    return F.coalesce((status == "not_found") & (F.unix_micros(now) - F.unix_micros(fetched_at) < ttl_days * 86_400 * 1_000_000), F.lit(False))


class _Missing(StatefulProcessor):
    """State of an artist: when it wasn't found, for as long as that counts, and what was found of it."""

    def __init__(self, ttl: int):
        self.ttl = ttl  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.missing = handle.getValueState("missing", "at long", max(1, self.ttl // 1000))
        self.found = handle.getValueState("found", "image string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = self.found.get()[0] if self.found.exists() else None
        missing = self.missing.get()[0] if self.missing.exists() else None
        events = sorted(((int(at), kind != "ask", kind, image) for frame in rows for at, kind, image in zip(frame["at"], frame["kind"], frame["image"], strict=True)), key=lambda x: x[:2])
        out = []
        for at, _, kind, image in events:
            if kind == "found":
                found, missing = image, None
                self.found.update((image,))
                self.missing.clear()
            elif kind == "not_found":
                if found is None:
                    missing = at
                    self.missing.update((at,))
            elif found is not None:
                out.append((key[0], at, "cached", found))
            else:
                out.append((key[0], at, "blocked" if missing is not None and at - missing < self.ttl else "resolve", None))
        if out:
            yield pd.DataFrame(out, columns=["artist", "at", "answer", "image"])

    def close(self) -> None:
        pass


def answered_lookups(events: DataFrame, ttl_days: float = TTL_DAYS) -> DataFrame:
    """artist, at, answer and image of each question in events (artist, at, kind, image).

    kind: ``ask``, or what a lookup came back with, ``found`` (image) or ``not_found``. answer: ``cached`` if an image is known,
    ``blocked`` if nothing was found less than ``ttl_days`` before, else ``resolve``. Events of one artist are taken by
    time, those of a micro-batch together; a question at the time of a result comes before it. What wasn't found leaves
    the state by its time to live, by the clock; a query by the clock runs until it is stopped, also with ``availableNow``.
    """
    timed = events.where("artist IS NOT NULL AND at IS NOT NULL").select("artist", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "kind", "image")
    found = timed.groupBy("artist").transformWithStateInPandas(_Missing(int(ttl_days * 86_400 * 1_000_000)), "artist string, at long, answer string, image string", "append", "processingtime")
    return found.select("artist", F.timestamp_micros("at").alias("at"), "answer", "image")
