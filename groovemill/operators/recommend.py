"""Archive recommendations, rankings of new reviews, filters and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groovemill.functions.numbers import effective_rating, overall_score, rating_unit
from groovemill.operators.scoring import TasteProfile, album_scores, percentile_table, with_percentile
from groovemill.sources.checkpoints import checkpointed, stored


def corpus_scores(affinities: DataFrame, profile: TasteProfile, of: DataFrame | None = None) -> DataFrame:
    """``album_scores`` with fit_pct and breadth_pct over all albums that have affinities, before any filter.

    of: review_id of the albums to return, if not all. Scores are kept by a checkpoint; of the corpus only they and the
    tables of percentiles are read after that.
    """
    scores = checkpointed(album_scores(affinities, profile.selected(affinities.sparkSession)))
    fit, breadth = percentile_table(scores, "style_fit", "fit_pct"), percentile_table(scores, "n_eff", "breadth_pct")
    wanted = scores if of is None else scores.join(of.select("review_id"), "review_id", "left_semi")
    return with_percentile(with_percentile(wanted, "style_fit", fit), "n_eff", breadth)


def label_filter(label: Column, selected: tuple[str, ...] | None) -> Column:
    """No selection: all pass. An empty one: only albums without a label. Else albums without a label pass as well."""
    if selected is None:
        return F.lit(True)
    return label.isNull() if not selected else label.isNull() | label.isin(*selected)


def year_filter(year: Column, bounds: tuple[int, int] | None) -> Column:
    """Within the bounds, in whichever order they come; albums without a year pass."""
    return F.lit(True) if bounds is None else year.isNull() | year.between(min(bounds), max(bounds))


def clamped(bounds: tuple | None, floor: float, cap: float, kind: type = int) -> tuple:
    """Bounds within floor and cap, the lower one first; what is no number is the floor or the cap."""
    low, high = bounds or (None, None)

    def number(value, default):
        try:
            return min(max(kind(value), floor), cap)
        except (TypeError, ValueError):
            return default

    return tuple(sorted((number(low, floor), number(high, cap))))


def checked_request(limit: int = 20, offset: int = 0, rounds: int = 1, target: int = 30, exponent: float = 1.0, archive_limit: int = 200) -> None:
    """Raises ValueError for what a request may not ask for; archive_limit: albums of a playlist's pool."""
    for name, value, low, high in (("limit", limit, 1, 100), ("offset", offset, 0, 20_000), ("archive_limit", archive_limit, 1, 20_000), ("rounds", rounds, 1, 20), ("target", target, 1, 100), ("exponent", exponent, 1, 5)):
        if not low <= value <= high:
            raise ValueError(f"{name} has to be from {low} to {high}")


def scored(reviews: DataFrame, scores: DataFrame, profile: TasteProfile, how: str = "inner") -> DataFrame:
    """Reviews with scores; with ``how`` left, albums without affinities have percentiles of 0."""
    joined = reviews.join(scores, "review_id", how)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total = overall_score(zero("fit_pct"), rating_unit(F.col("rating")), zero("breadth_pct"), (profile.alpha, profile.beta, profile.gamma))
    return joined.select(*reviews.columns, zero("style_fit").alias("style_fit"), F.coalesce("n_eff", F.lit(1.0)).alias("n_eff"), F.coalesce("hits", F.lit(0)).alias("hits"), zero("fit_pct").alias("score"), zero("breadth_pct").alias("breadth"), effective_rating(F.col("rating")).alias("rating_effective"), rating_unit(F.col("rating")).alias("rating_norm"), total.alias("overall_score"))


def archive_candidates(reviews: DataFrame, affinities: DataFrame, profile: TasteProfile) -> DataFrame:
    """Albums with a selected community that pass the profile's filters; the score band is one of percentiles."""
    rows = scored(reviews, corpus_scores(affinities, profile), profile)
    low, high = clamped(profile.rating_range, 0.0, 10.0, float)
    band = sorted(profile.score_range)
    year = F.coalesce("release_year", F.year("release_date"))
    years = None
    if profile.year_range is not None:
        ends = reviews.agg(F.min(year).alias("first"), F.max(year).alias("last")).first()
        years = None if ends["first"] is None else clamped(profile.year_range, ends["first"], ends["last"])
    return rows.where((F.col("hits") > 0) & F.col("rating_effective").between(low, high) & year_filter(year, years) & label_filter(F.col("label"), profile.labels) & F.round("score", 9).between(*band))


def order_keys() -> list[Column]:
    """Best first: overall score, percentile of fit, id, all falling."""
    return [F.round("overall_score", 9).desc(), F.round("score", 9).desc(), F.col("review_id").desc()]


def page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to before ``offset + limit`` of the ranking, with their rank: Spark keeps only as many in each task."""
    top = rows.orderBy(*order_keys()).limit(offset + limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order_keys())).cast("long"))
    return ranked.where(F.col("rank") > offset)


def all_ranked(rows: DataFrame) -> DataFrame:
    """All rows with their rank from 1, best first, from a stored table.

    Rows are dealt out by ranges of the ranking; a range knows its ranks when it is known how many rows the ranges before it have.
    """
    dealt = rows.repartitionByRange(*order_keys()).sortWithinPartitions(*order_keys())
    kept = stored(dealt.withColumns({"q_range": F.spark_partition_id(), "q_at": F.monotonically_increasing_id()}), "ranked")
    sizes = kept.groupBy("q_range").agg(F.count("*").alias("n"), F.min("q_at").alias("first"))
    before = F.sum("n").over(Window.orderBy("q_range")) - F.col("n")  # a row for each range
    shifts = sizes.select("q_range", (before - F.col("first") + 1).alias("q_shift"))
    return kept.join(shifts, "q_range").withColumn("rank", F.col("q_at") + F.col("q_shift")).drop("q_range", "q_at", "q_shift")


def in_order(reviews: DataFrame, affinities: DataFrame, profile: TasteProfile) -> DataFrame:
    """``scored`` reviews of a page with their rank, best first; without a selected community they stay newest first, with scores of 0."""
    if profile.weights:
        rows = scored(reviews, corpus_scores(affinities, profile, reviews), profile, "left")
        return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order_keys())).cast("long"))
    zeros = {c: F.lit(0.0) for c in ("style_fit", "score", "breadth", "overall_score")} | {"n_eff": F.lit(1.0), "hits": F.lit(0)}
    rows = reviews.withColumns(zeros | {"rating_effective": effective_rating(F.col("rating")), "rating_norm": rating_unit(F.col("rating"))})
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col("review_id").desc())).cast("long"))


def archive_pool(rows: DataFrame, archive_limit: int | None = None) -> DataFrame:
    """Candidates for a playlist with ``place`` from 0: the best ``archive_limit``, as a request may ask for, or all of them."""
    if archive_limit is None:
        return all_ranked(rows).withColumn("place", F.col("rank") - 1)
    checked_request(archive_limit=archive_limit)
    return page(rows, 0, archive_limit).withColumn("place", F.col("rank") - 1)


def page_with_total(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """``page`` with ``total``, the number of all rows; rows are kept by a checkpoint, as both need them."""
    checked_request(limit=limit, offset=offset)
    rows = checkpointed(rows)
    return page(rows, offset, limit).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row


def newest(reviews: DataFrame, n: int) -> DataFrame:
    return reviews.orderBy(F.col("review_id").desc()).limit(max(1, n))


def newest_pool(reviews: DataFrame, batches: DataFrame, rounds: int, per_round: int = 20) -> DataFrame:
    """Reviews of the last ``rounds`` (1 to 20) batches (run_at, review_ids); if these name none, the newest by id."""
    rounds = max(1, min(20, rounds))
    ids = batches.orderBy(F.col("run_at").desc()).limit(rounds).select(F.explode("review_ids").alias("review_id")).distinct()
    known = reviews.join(ids, "review_id", "left_semi")
    return known if not ids.isEmpty() else newest(reviews, rounds * per_round)


def highlights(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """One row for each kind: the best by its column among those of artists that no earlier kind has taken."""
    rows = checkpointed(rows.select("review_id", "artist", *dict.fromkeys(kinds.values())))  # each pick reads them again
    taken: DataFrame | None = None
    picks = None
    for place, (kind, column) in enumerate(kinds.items()):
        free = rows if taken is None else rows.join(F.broadcast(taken), "artist", "left_anti")  # one artist for each kind before
        pick = free.orderBy(F.round(column, 9).desc(), F.col("review_id").desc()).limit(1).select(F.lit(kind).alias("kind"), F.lit(place).cast("long").alias("place"), "review_id", "artist", F.col(column).cast("double").alias("value"))
        picks = pick if picks is None else picks.union(pick)
        taken = picks.select("artist")
    return picks


def histogram(rows: DataFrame, value: str, bins: int = 8) -> DataFrame:
    """bin, n of values from 0 to 1 in equal bins, the last one closed; bins without values have 0."""
    counted = rows.groupBy(F.least(F.floor(F.round(value, 9) * bins), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return rows.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
