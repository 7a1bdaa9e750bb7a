"""Playlists: weights of albums, slots, caps, and the tracks that fill them."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groovemill.functions.text import csv_field, title_norm, track_key
from groovemill.sources.checkpoints import forget, stored

#: Most tracks and slots of a playlist.
MOST_TRACKS, MOST_SLOTS = 100, 2000
#: Tries for each slot before filling stops.
TRIES = 20
#: Tracks per album by place for each spread; later places get one.
CAPS = {"balanced": (3, 3, 3, 2, 2, 2, 2, 2, 2, 2, 2, 2), "deep": (4, 4, 3, 3, 2, 2, 2, 2), "variety": ()}


def album_weights(pool: DataFrame, score: str = "overall_score") -> DataFrame:
    """``pool`` with ``weight``: scores without negatives over their sum; equal weights if that is 0."""
    raw = F.greatest(F.lit(0.0), F.coalesce(F.col(score), F.lit(0.0)))
    totals = pool.agg(F.sum(raw).alias("total"), F.count("*").alias("size"))
    return pool.crossJoin(F.broadcast(totals)).withColumn("weight", F.when(F.col("total") > 0, raw / F.col("total")).otherwise(1 / F.col("size"))).drop("total", "size")


def amplify(pool: DataFrame, exponent: float) -> DataFrame:
    """Weights raised to the exponent and normed again; exponents up to 1 change nothing."""
    if exponent <= 1:
        return pool
    powered = F.pow(F.greatest(F.lit(0.0), F.col("weight")), F.lit(float(exponent)))
    total = pool.agg(F.sum(powered).alias("total"))
    return pool.crossJoin(F.broadcast(total)).withColumn("weight", F.when(F.col("total") > 0, powered / F.col("total")).otherwise(F.col("weight"))).drop("total")


def stratified_slots(pool: DataFrame, target: int) -> DataFrame:
    """``pool`` (place from 0, weight) with ideal, floor_slots, extra and quota: shares of ``target`` by largest remainder.

    Equal remainders go to the later place. The extra slots are the first of a sorted list, so no task ranks the pool.
    """
    ideal = F.round(F.lit(target) * F.col("weight"), 9)
    cut = pool.withColumn("ideal", ideal).withColumn("floor_slots", F.floor("ideal"))
    spare = target - int(cut.agg(F.coalesce(F.sum("floor_slots"), F.lit(0))).first()[0])
    extra = cut.orderBy(F.round(F.col("ideal") - F.col("floor_slots"), 9).desc(), F.col("place").desc()).limit(max(0, spare)).select("place", F.lit(1).cast("long").alias("extra"))
    return cut.join(F.broadcast(extra), "place", "left").withColumn("extra", F.coalesce("extra", F.lit(0))).withColumn("quota", F.col("floor_slots") + F.col("extra"))


def graduated_caps(pool: DataFrame, spread: str) -> DataFrame:
    """``pool`` with ``cap``: the more tracks, the larger the weight; only the first places get more than one."""
    caps = CAPS[spread]
    top = pool.orderBy(F.col("weight").desc(), "place").limit(len(caps)).select("place", (F.row_number().over(Window.orderBy(F.col("weight").desc(), "place")) - 1).alias("nth"))
    steps = F.array(*map(F.lit, caps)) if caps else F.array(F.lit(1))
    ranked = top.select("place", F.get(steps, F.col("nth")).cast("long").alias("cap"))
    return pool.join(F.broadcast(ranked), "place", "left").withColumn("cap", F.coalesce("cap", F.lit(1)))


def uniform(key: Column, seed: int) -> Column:
    """A number between 0 and 1 from a key and a seed, the same in every engine."""
    return (F.pmod(F.pmod(key, F.lit(1000003)) * 2654435761 + seed, F.lit(1000003)) + 0.5) / 1000003


def weighted_sample(pool: DataFrame, k: int, seed: int) -> DataFrame:
    """``pool`` rows of k draws with ``nth`` (from 1) and ``draw``: without replacement, with chances by weight (largest log(u) / weight
    first), as long as there are rows of positive weight; then with replacement, where ``draw`` is null.

    If no weight is positive, all rows have the same. k is at most MOST_TRACKS; draws with replacement are found by their place in the
    running sum of the weights, of which there are fewer than k.
    """
    if k > MOST_TRACKS:
        raise ValueError(f"at most {MOST_TRACKS} draws")
    sums = pool.agg(F.coalesce(F.sum(F.greatest(F.lit(0.0), F.col("weight"))), F.lit(0.0)).alias("q_sum"))
    weighed = pool.crossJoin(F.broadcast(sums)).withColumn("q_w", F.when(F.col("q_sum") > 0, F.greatest(F.lit(0.0), F.col("weight"))).otherwise(F.lit(1.0))).where("q_w > 0")  # sums is one row
    drawn = weighed.withColumn("draw", F.log(uniform(F.col("review_id"), seed)) / F.col("q_w")).orderBy(F.col("draw").desc(), "review_id").limit(k)
    first = drawn.withColumn("nth", F.row_number().over(Window.orderBy(F.col("draw").desc(), "review_id")).cast("long"))
    found, there = pool.columns, weighed.select("review_id").limit(k).count()
    if there == k or there == 0:
        return first.select(*found, "nth", "draw")
    # fewer rows than draws: at most k of them
    order = Window.orderBy("review_id")
    ranges = weighed.withColumn("q_high", F.sum("q_w").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("q_low", F.lag("q_high", 1, 0.0).over(order)).withColumn("q_all", F.sum("q_w").over(Window.partitionBy()))
    extra = pool.sparkSession.range(there + 1, k + 1).select(F.col("id").alias("nth"), uniform(F.col("id"), seed + 1).alias("q_u"))
    place = F.col("q_u") * F.col("q_all")
    again = ranges.join(F.broadcast(extra), (place >= F.col("q_low")) & (place < F.col("q_high")))  # at most k rows on either side
    return first.select(*found, "nth", "draw").unionByName(again.select(*found, "nth", F.lit(None).cast("double").alias("draw")))


def track_candidates(tracks: DataFrame, highlights: DataFrame | None = None) -> DataFrame:
    """``tracks`` with ``source``: highlight by flag; in albums without a flag, by title in ``highlights`` (review_id, title); else fallback."""
    flagged = F.max("is_highlight").over(Window.partitionBy("review_id"))
    if highlights is None:
        by_title = F.lit(False)
        joined = tracks
    else:
        named = highlights.select("review_id", title_norm(F.col("title")).alias("norm"), F.lit(True).alias("named")).distinct()
        joined = tracks.withColumn("norm", title_norm(F.col("title"))).join(named, ["review_id", "norm"], "left").drop("norm")
        by_title = F.coalesce("named", F.lit(False))
    return joined.withColumn("flagged", flagged).withColumn("source", F.when(F.when(F.col("flagged"), F.col("is_highlight")).otherwise(by_title), "highlight").otherwise("fallback")).drop("flagged", *(["named"] if highlights is not None else []))


def _shuffled(values: Iterable, seed: int) -> list:
    return [v for _, _, v in sorted((((i * 2654435761 + seed) % 1000003), i, v) for i, v in enumerate(values))]


class _Shelf:
    """Albums' tracks as filling asks for them: a few lists here, the whole pool in Spark's ``ranked`` (place, review_id, cap, nth, key, title, source).

    Tracks of given albums are asked for by the albums' ids (``ids``: place, review_id), so that Spark ranks these alone; the whole
    pool is ranked and stored when a slot passes on for the first time.

    An album that is closed once, as it has given all that it may or all its tracks are used, stays closed. So albums that were
    asked for after a place need to be asked for again only when all of them are closed.
    """

    def __init__(self, ranked: DataFrame, at_once: int):
        self.ranked, self.at_once = ranked, at_once
        self.ids: DataFrame | None = None
        self.stored: DataFrame | None = None
        self.tracks: dict[int, deque] = {}
        self.left: dict[int, int] = {}
        self.after: dict[int, list[int]] = {}
        self.used: set[str] = set()

    def fetch(self, places: list[int]) -> None:
        new = [p for p in places if p not in self.tracks]
        self.tracks |= {p: deque() for p in new}
        for r in self._of(new).orderBy("place", "nth").collect() if new else []:
            self.tracks[r["place"]].append(r)
            self.left.setdefault(r["place"], r["cap"])

    def _of(self, places: list[int]) -> DataFrame:
        found = (self.ranked if self.stored is None else self.stored).where(F.col("place").isin(places))
        if self.stored is not None or self.ids is None:
            return found
        # as numbers these go below the windows and joins that rank an album's tracks
        return found.where(F.col("review_id").isin([r["review_id"] for r in self.ids.where(F.col("place").isin(places)).select("review_id").distinct().collect()]))

    def whole(self) -> DataFrame:
        if self.stored is None:
            self.stored = stored(self.ranked, "ranked")
        return self.stored

    def forget(self) -> None:
        if self.stored is not None:
            forget(self.stored)

    def first(self, place: int):
        """The album's first track that isn't used yet, None if it is closed; used ones are dropped for good."""
        if not self.left.get(place):
            return None
        own = self.tracks[place]
        while own and own[0]["key"] in self.used:
            own.popleft()
        return own[0] if own else None

    def take(self, place: int):
        track = self.tracks[place].popleft()
        self.used.add(track["key"])
        self.left[place] -= 1
        return track

    def next_open(self, place: int) -> int | None:
        """The first album after ``place``, from the end on again from the start, that isn't closed."""
        asked = place not in self.after
        while True:
            if asked:
                full = [p for p, n in self.left.items() if not n]
                open_ = self.whole().where((F.col("cap") > 0) & (F.col("place") != place) & ~F.col("place").isin(full) & ~F.col("key").isin(list(self.used)))
                found = open_.groupBy("place").agg(F.count("*").alias("n")).orderBy(F.col("place") < place, "place").limit(self.at_once).select("place").collect()
                self.after[place] = [r["place"] for r in found]
                self.fetch(self.after[place])
                if not found:
                    return None
            other = next((p for p in self.after[place] if self.first(p)), None)
            if other is not None:
                return other
            if asked and len(self.after[place]) < self.at_once:
                return None
            asked = True


def fill_playlist(pool: DataFrame, candidates: DataFrame, target: int, seed: int = 0) -> DataFrame:
    """position, review_id, title, source of a playlist of at most ``target`` tracks.

    pool: review_id, artist, place, quota, cap. candidates: review_id, number, title, source. Slots are filled in an order by
    chance; each takes its album's next unused track, or passes to the next album of the pool that has room. Quotas above
    the caps are cut without being dealt out again.

    A slot depends on all slots before it, but a playlist has at most MOST_TRACKS tracks and MOST_SLOTS slots: the driver follows
    these, and asks Spark for the tracks of the slots' albums, and, of the whole pool, for the next albums with an unused track where
    a slot passes on. Of each album as many tracks can matter as can be taken or used before (cap and target): its highlights
    first, then others, both in an order by chance. The pool and its tracks, of any size, stay in tables.
    """
    if target > MOST_TRACKS:
        raise ValueError(f"a playlist has at most {MOST_TRACKS} tracks")
    pool = stored(pool.select("review_id", "artist", "place", "quota", "cap"), "pool")  # read several times
    quotas = pool.select("place", F.least("quota", "cap").alias("quota")).where("quota > 0").orderBy("place").limit(MOST_SLOTS + 1).collect()
    slots = deque(_shuffled((r["place"] for r in quotas for _ in range(int(r["quota"]))), seed))
    if len(slots) > MOST_SLOTS:
        raise ValueError(f"a playlist has at most {MOST_SLOTS} slots")
    keyed = pool.select("review_id", "artist", "place", "cap").join(candidates, "review_id").withColumn("key", track_key(F.col("artist"), F.col("title")))
    chance = F.crc32(F.concat("key", F.lit(f":{seed}")).cast("binary"))
    order = Window.partitionBy("review_id").orderBy((F.col("source") != "highlight").cast("int"), chance, "key", "number")
    once = keyed.withColumn("same", F.row_number().over(Window.partitionBy("review_id", "key").orderBy((F.col("source") != "highlight").cast("int"), "number"))).where("same = 1")
    first = once.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= F.col("cap") + target)
    shelf = _Shelf(first.select("place", "review_id", "cap", "nth", "key", "title", "source"), max(1, target))
    shelf.ids = pool.select("place", "review_id")
    shelf.fetch(sorted(set(slots)))
    picks, tries = [], TRIES * target
    while slots and tries > 0:
        tries -= 1
        album = slots.popleft()
        if shelf.first(album) is None:
            album = shelf.next_open(album)
            if album is None:
                continue
            if not tries:
                break
            tries -= 1
        track = shelf.take(album)
        picks.append((len(picks) + 1, track["review_id"], track["title"], track["source"]))
    shelf.forget()
    forget(pool)
    return pool.sparkSession.createDataFrame(picks, "position long, review_id long, title string, source string")


def export_csv(playlist: DataFrame) -> DataFrame:
    """position and line: artist and title as CSV fields."""
    return playlist.select("position", F.concat_ws(",", csv_field(F.col("artist")), csv_field(F.col("title"))).alias("line"))


def export_text(playlist: DataFrame) -> DataFrame:
    """position and line ``artist - title``; of equal tracks the first stays."""
    key = track_key(F.col("artist"), F.col("title"))
    first = playlist.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("position"))).where("nth = 1")
    return first.select("position", F.concat_ws(" - ", "artist", "title").alias("line"))


def integer_percents(rows: DataFrame, weight: str) -> DataFrame:
    """``rows`` (place, few) with ``percent``: whole numbers that add up to 100 by largest remainder."""
    return stratified_slots(rows.withColumn("weight", F.col(weight)), 100).withColumnRenamed("quota", "percent").drop("ideal", "floor_slots", "extra", "weight")
