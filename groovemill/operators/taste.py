"""What a listener has chosen: selected communities and their weights, categories, label filters, and lists in their order."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groovemill.functions.text import casefold, strip
from groovemill.operators.playlist import uniform
from groovemill.operators.scoring import DEFAULT_WEIGHT
from groovemill.sources.checkpoints import checkpointed

#: The bucket of what has no category and of rare labels, the label of a community without any, example artists.
OTHER, NO_LABEL, EXAMPLES = "Sonstige", "Stil-Cluster", 6
#: Shares from which on a tag is shown, and below which an album lies outside a profile.
SHOWN_FROM, OUTSIDE_BELOW = 0.1, 0.7
#: Places of the first photo, steps between later ones, and where each may move; node sizes of the map.
FIRST_PHOTO, PHOTO_STEP, PHOTO_MOVES = (1, 2, 3, 4, 5), 6, (0, 1, -2, 2, 3)
LEAST_RADIUS, MOST_RADIUS = 8.0, 22.0


def clean(values: Column) -> Column:
    """Strings stripped, without blank ones; null counts as none."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), strip), lambda x: x != "")


def canonical_selection(flows: DataFrame) -> DataFrame:
    """owner, communities (sorted) from flows (owner, flow, community): the ``canonical`` ones if there are any, else those of all other flows."""
    sets = flows.groupBy("owner").agg(F.collect_set(F.when(F.col("flow") == "canonical", F.col("community"))).alias("own"), F.collect_set(F.when(F.col("flow") != "canonical", F.col("community"))).alias("other"))
    return sets.select("owner", F.array_sort(F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("other"))).alias("communities"))


def selected_weights(selection: DataFrame, weights: DataFrame) -> DataFrame:
    """owner, community, weight of selected communities (owner, community); weights of others (owner, community, weight) are dropped.

    Without a weight a community has DEFAULT_WEIGHT; if all weights of an owner are 1, as an old version stored them, all have it.
    """
    chosen = selection.select("owner", "community").distinct().join(weights.select("owner", "community", "weight"), ["owner", "community"], "left")
    given = F.coalesce("weight", F.lit(DEFAULT_WEIGHT))
    old = F.min(given == 1).over(Window.partitionBy("owner"))
    return chosen.select("owner", "community", F.when(old, F.lit(DEFAULT_WEIGHT)).otherwise(given).alias("weight"))


def with_fallback(categories: DataFrame, communities: DataFrame) -> DataFrame:
    """community, category of all communities (community); those without a category have OTHER."""
    return communities.select("community").distinct().join(categories.select("community", "category").distinct(), "community", "left").select("community", F.coalesce("category", F.lit(OTHER)).alias("category"))


def within_categories(selection: DataFrame, categories: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of ``selection`` (owner, community) with a category among the owner's (chosen: owner, category); owners without any keep all."""
    placed = selection.join(with_fallback(categories, selection), "community").join(chosen.select("owner", "category").distinct(), ["owner", "category"], "left_semi").select("owner", "community").distinct()
    free = selection.select("owner", "community").join(chosen.select("owner"), "owner", "left_anti")
    return placed.unionByName(free)


def selection_categories(selection: DataFrame, categories: DataFrame) -> DataFrame:
    """owner, categories (sorted, distinct) of the selected communities; owners of none have an empty array."""
    found = selection.join(categories, "community").groupBy("owner").agg(F.array_sort(F.collect_set("category")).alias("c"))
    return selection.select("owner").distinct().join(found, "owner", "left").select("owner", F.coalesce("c", F.array().cast("array<string>")).alias("categories"))


def taste_communities(communities: DataFrame, labels: DataFrame, categories: DataFrame) -> DataFrame:
    """community, label (else the centroid's name, else NO_LABEL), categories and example artists of each community.

    communities: community, centroid, top_artists (array).
    """
    listed = categories.groupBy("community").agg(F.array_sort(F.collect_set("category")).alias("categories"))
    none = F.array().cast("array<string>")
    named = communities.join(labels.select("community", F.col("label").alias("own_label")), "community", "left").join(listed, "community", "left")
    label = F.coalesce(F.nullif("own_label", F.lit("")), F.nullif("centroid", F.lit("")), F.lit(NO_LABEL))
    return named.select("community", label.alias("label"), F.coalesce("categories", none).alias("categories"), F.slice(clean(F.col("top_artists")), 1, EXAMPLES).alias("example_artists"))


def category_index(options: DataFrame) -> DataFrame:
    """category, place, community, label: the options of each category by their labels; those of none are under OTHER."""
    order = Window.partitionBy("category").orderBy(F.lower("label"), "community")
    exploded = options.select("community", "label", F.explode(F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array(F.lit(OTHER)))).alias("category"))
    return exploded.select("category", F.row_number().over(order).cast("long").alias("place"), "community", "label")


def choice_counts(choices: DataFrame, visible: DataFrame) -> DataFrame:
    """owner, liked, disliked, reviewed, unset, total over visible communities (community); choices: owner, community, choice."""
    total = visible.select("community").distinct().agg(F.count("*").alias("total"))
    shown = choices.join(visible.select("community").distinct(), "community", "left_semi")
    counted = shown.groupBy("owner").agg(*(F.count_if(F.col("choice") == c).alias(c) for c in ("liked", "disliked")))
    rows = choices.select("owner").distinct().join(counted, "owner", "left").crossJoin(F.broadcast(total)).fillna(0, ["liked", "disliked"])  # total is one row
    return rows.select("owner", "liked", "disliked", (F.col("liked") + F.col("disliked")).alias("reviewed"), (F.col("total") - F.col("liked") - F.col("disliked")).alias("unset"), "total")


def label_set_filter(albums: DataFrame, selected: Sequence[str] | None) -> DataFrame:
    """Albums whose ``labels`` (array) pass a selection: none (all pass), all labels there are (all pass), an empty one (albums
    without a label), else those without a label or with one that is selected. Without any label at all, all pass."""
    if selected is None:
        return albums
    chosen = sorted({x.strip() for x in selected} - {""})
    rows = albums.withColumn("q_labels", clean(F.col("labels")))
    each = rows.select(F.explode("q_labels").alias("label"))
    known = each.agg(F.countDistinct("label").alias("n_all"), F.countDistinct(F.when(F.col("label").isin(chosen), F.col("label"))).alias("n_hit"))
    every = (F.col("n_all") == 0) | (F.col("n_all") == F.col("n_hit")) & (F.col("n_all") == len(chosen))
    own = F.size("q_labels") == 0
    if chosen:
        own = own | F.arrays_overlap("q_labels", F.array(*map(F.lit, chosen)))
    return rows.crossJoin(F.broadcast(known)).where(every | own).select(*albums.columns)  # known is one row


def expand_labels(chosen: Column, rare: Column) -> Column:
    """Labels that a choice stands for: OTHER stands for all rare ones. Sorted, distinct."""
    picked = clean(chosen)
    named = F.array_remove(picked, OTHER)
    return F.array_sort(F.array_distinct(F.when(F.array_contains(picked, OTHER), F.concat(named, clean(rare))).otherwise(named)))


def collapse_labels(concrete: Column, frequent: Column, rare: Column) -> Column:
    """The choice that stands for labels: frequent ones in their order, then OTHER if there are rare ones and all are in."""
    all_rare = (F.size(clean(rare)) > 0) & (F.size(F.array_except(clean(rare), concrete)) == 0)
    shown = F.filter(frequent, lambda x: F.array_contains(concrete, x))
    return F.when(all_rare, F.array_append(shown, F.lit(OTHER))).otherwise(shown)


def label_text(metadata_text: Column, metadata_labels: Column, review_labels: Column) -> Column:
    """Record labels as text: the metadata's, as text or as a list, else the review's, joined with commas; never null."""
    listed = F.when(F.size(clean(metadata_labels)) > 0, clean(metadata_labels)).otherwise(clean(review_labels))
    return F.coalesce(F.nullif(strip(metadata_text), F.lit("")), F.array_join(listed, ", "), F.lit(""))


def redistributed(shares: tuple[Column, Column, Column], which: int, percent: Column) -> list[Column]:
    """Three weights normed to 1 after one was set to a percentage; the others keep their proportion, or halve the rest if both are 0."""
    raw = [F.greatest(F.lit(0.0), s) for s in shares]
    total = raw[0] + raw[1] + raw[2]
    normed = [F.when(total > 0, r / total).otherwise(F.lit(1.0) / 3) for r in raw]
    own = F.least(F.lit(100.0), F.greatest(F.lit(0.0), percent)) / 100
    rest = [n for i, n in enumerate(normed) if i != which]
    others = rest[0] + rest[1]
    moved = lambda n: F.when(others > 0, n / others * (1 - own)).otherwise((1 - own) / 2)
    return [own if i == which else moved(n) for i, n in enumerate(normed)]


def rounded_percents(shares: Sequence[Column]) -> list[Column]:
    """Whole percents (halves up); what is missing or over in their sum goes to the first largest."""
    whole = [F.floor(s * 100 + 0.5).cast("long") for s in shares]
    largest = F.greatest(*whole)
    drift = F.lit(100) - sum(whole[1:], whole[0])
    out, taken = [], F.lit(False)
    for w in whole:
        first = (w == largest) & ~taken
        out.append(w + F.when(first, drift).otherwise(F.lit(0)))
        taken = taken | (w == largest)
    return out


def node_radius(sizes: DataFrame) -> DataFrame:
    """``sizes`` (size) with ``radius``: sizes scaled to LEAST_RADIUS to MOST_RADIUS; the middle if all are equal."""
    ends = sizes.agg(F.min("size").alias("low"), F.max("size").alias("high"))
    scaled = F.lit(LEAST_RADIUS) + (F.col("size") - F.col("low")) / (F.col("high") - F.col("low")) * (MOST_RADIUS - LEAST_RADIUS)
    return sizes.crossJoin(F.broadcast(ends)).withColumn("radius", F.when(F.col("low") == F.col("high"), F.lit((LEAST_RADIUS + MOST_RADIUS) / 2)).otherwise(scaled)).drop("low", "high")  # ends is one row


def visible_breadth(affinities: DataFrame) -> DataFrame:
    """review_id, tags (number of shares that are shown) and breadth (their effective number, at least 1) of each album."""
    shown = affinities.where(F.round("share", 9) >= SHOWN_FROM).withColumn("p", F.col("share") / F.sum("share").over(Window.partitionBy("review_id")))
    counted = shown.groupBy("review_id").agg(F.count("*").alias("tags"), F.exp(-F.sum(F.col("p") * F.log("p"))).alias("b"))
    every = affinities.select("review_id").distinct().join(counted, "review_id", "left")
    return every.select("review_id", F.coalesce("tags", F.lit(0)).alias("tags"), F.when(F.coalesce("tags", F.lit(0)) <= 1, F.lit(1.0)).otherwise(F.col("b")).alias("breadth"))


def serendipity_order(ranked: DataFrame, share: float, seed: int) -> DataFrame:
    """``ranked`` (rank from 1, review_id) with ``key`` and a new ``rank``: (1 - share) of the old place and share of a chance.

    One row has key 0; chances come from the id and the seed. Ranked rows are a page, which one task may sort.
    """
    s = min(1.0, max(0.0, float(share)))
    size = ranked.agg(F.count("*").alias("size"))
    chance = F.round(F.lit(1 - s) * (F.col("rank") - 1) / (F.col("size") - 1) + F.lit(s) * uniform(F.col("review_id"), seed), 9)
    keyed = ranked.crossJoin(F.broadcast(size)).withColumn("key", F.when(F.col("size") <= 1, F.lit(0.0)).otherwise(chance))  # size is one row
    return keyed.withColumn("old_rank", F.col("rank")).withColumn("rank", F.row_number().over(Window.orderBy("key", "old_rank")).cast("long")).drop("size")


def newest_highlights(rows: DataFrame) -> DataFrame:
    """kind, place, review_id, artist, album: the best fit; then the best rated of the rest; then the best rated of what is left
    below OUTSIDE_BELOW or, if nothing is, the least fitting.

    rows: review_id, artist, album, overall_score (the fit) and rating_effective. A record is its artist and album.
    """
    fit, rating, newest = F.round("overall_score", 9), F.col("rating_effective"), F.col("review_id").desc()
    rows = checkpointed(rows.select("review_id", "artist", "album", "overall_score", "rating_effective"))
    first = rows.orderBy(fit.desc(), rating.desc(), newest).limit(1)
    rest = rows.join(F.broadcast(first.select("artist", "album")), ["artist", "album"], "left_anti")  # one row, as below
    second = rest.orderBy(rating.desc(), fit.desc(), newest).limit(1)
    left = rest.join(F.broadcast(second.select("artist", "album")), ["artist", "album"], "left_anti")
    outside = fit < OUTSIDE_BELOW  # sorts first where true; there the rating counts first
    third = left.orderBy(outside.desc(), F.when(outside, rating).desc(), fit, rating.desc(), newest).limit(1)
    picks = [p.select(F.lit(kind).alias("kind"), F.lit(i).cast("long").alias("place"), "review_id", "artist", "album") for i, (kind, p) in enumerate((("fit", first), ("critic", second), ("outside", third)))]
    return picks[0].union(picks[1]).union(picks[2])


def photo_ranks(lists: DataFrame) -> DataFrame:
    """list, rank of the rows that show a photo. lists: list, rank (from 1), artist, mbid, has_photo.

    Each slot, in order, takes the first of its ranks that is free, has a photo and an artist that no earlier slot shows (by
    mbid and by name). Slots depend on those before, so one task has a list; lists are pages of rankings.
    """

    def run(page: pd.DataFrame) -> pd.DataFrame:
        rows = {r.rank: r for r in page.itertuples(index=False)}
        top, shown, claimed = max(rows), [], set()
        slots = [FIRST_PHOTO, *(tuple(a + m for m in PHOTO_MOVES) for a in range(PHOTO_STEP, top + 1, PHOTO_STEP))]
        for slot in slots:
            for rank in slot:
                r = rows.get(rank)
                keys = set() if r is None else {k for k in ((r.mbid or "").strip(), f"name:{(r.artist or '').strip().lower()}") if k not in ("", "name:")}
                if keys and rank not in shown and not keys & claimed and r.has_photo:
                    claimed |= keys
                    shown.append(rank)
                    break
        return pd.DataFrame({"list": page["list"].iloc[0], "rank": shown}, columns=["list", "rank"]).astype({"rank": "int64"})

    kind = dict(lists.dtypes)["list"]
    return lists.select("list", "rank", "artist", "mbid", "has_photo").groupBy("list").applyInPandas(run, f"list {kind}, rank long")


def lookup_key(mbid: Column, artist: Column) -> Column:
    """The mbid, else ``name:`` and the name without case; null if both are blank."""
    named = F.nullif(casefold(strip(artist)), F.lit(""))
    return F.coalesce(F.nullif(strip(mbid), F.lit("")), F.concat(F.lit("name:"), named))


def first_artists(ranked: DataFrame, n: int) -> DataFrame:
    """rank, review_id, artist, key of the first n distinct artists (by ``lookup_key``) of a ranking (rank, review_id, artist, mbid)."""
    keyed = ranked.withColumn("key", lookup_key(F.col("mbid"), F.col("artist"))).where(F.col("key").isNotNull())
    best = keyed.groupBy("key").agg(F.min_by(F.struct("rank", "review_id", "artist"), "rank").alias("r")).select("r.*", "key")
    return best.orderBy("rank").limit(n)


def playlist_rows(ranked: DataFrame, reviews: DataFrame, metadata: DataFrame) -> DataFrame:
    """rank, review_id, artist, album, first_label and mbid of ranked rows (rank, review_id) that have a review; ranks stay."""
    own = reviews.select("review_id", "artist", "album", F.get(clean(F.col("labels")), F.lit(0)).alias("first_label"))
    ids = metadata.select("review_id", F.nullif(strip(F.col("mbid")), F.lit("")).alias("mbid"))
    return ranked.select("rank", "review_id").join(own, "review_id").join(ids, "review_id", "left").select("rank", "review_id", "artist", "album", "first_label", "mbid")


def moved_favorites(saved: DataFrame) -> DataFrame:
    """owner, review_id, saved_at, place: a guest's favourites, the last saved first; what is saved again moves to the front."""
    last = saved.groupBy("owner", "review_id").agg(F.max("saved_at").alias("saved_at"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy(F.col("saved_at").desc(), F.col("review_id").desc())).cast("long"))


def release_text(date: Column, year: Column) -> Column:
    """``dd.MM.yyyy``, else the year, else an empty text."""
    return F.coalesce(F.date_format(date, "dd.MM.yyyy"), year.cast("string"), F.lit(""))


def caption(artists: Column, most: int = 55) -> Column:
    """``z. B.`` and up to three artists; fewer, at least one, if that is longer than ``most``."""
    names = clean(artists)
    text = lambda n: F.concat(F.lit("z. B. "), F.array_join(F.slice(names, 1, n), ", "))
    return F.when(F.size(names) == 0, F.lit("")).when(F.length(text(3)) <= most, text(3)).when(F.length(text(2)) <= most, text(2)).otherwise(text(1))


def slider_percents(low: Column, high: Column, step: int = 5) -> tuple[Column, Column]:
    """Scores from 0 to 1 as percents in whole steps (halves to even), the lower one first."""
    whole = [F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(d)))) * 100, 0) for c, d in ((low, 0.0), (high, 1.0))]
    stepped = [F.bround(x / step, 0) * step for x in (F.least(*whole), F.greatest(*whole))]
    return stepped[0].cast("long"), stepped[1].cast("long")


def range_text(low: Column, high: Column) -> Column:
    """``45 % bis 100 %``, the lower one first."""
    whole = [F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.bround(F.coalesce(c, F.lit(d)) * 100, 0))).cast("long") for c, d in ((low, 0.0), (high, 1.0))]
    return F.concat(F.least(*whole).cast("string"), F.lit(" % bis "), F.greatest(*whole).cast("string"), F.lit(" %"))


def card_parts(date: Column, year: Column, rating: Column, overall: Column, labels: Column) -> Column:
    """The parts of a card's line that have something to say: release, rating, score and record labels."""
    rated = F.when(rating.isNull(), F.lit("Rating 5/10 (angenommen)")).otherwise(F.concat(F.lit("Rating "), F.regexp_replace(rating.cast("string"), r"\.0$", ""), F.lit("/10")))
    parts = [F.nullif(release_text(date, year), F.lit("")), rated, F.concat(F.lit("Score "), F.format_string("%.2f", overall)), F.when(strip(labels) != "", F.concat(F.lit("Plattenlabel: "), strip(labels)))]
    return F.array_compact(F.array(*parts))


def usable_memberships(memberships: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: ``usable``, whether any of the columns ``keys`` has a community that isn't blank."""
    there = F.lit(False)
    for k in keys:
        there = there | (F.coalesce(strip(F.col(k)), F.lit("")) != "")
    return memberships.agg(F.coalesce(F.bool_or(there), F.lit(False)).alias("usable"))

