"""Queries on scores, rankings and filters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from groovemill.functions.numbers import best_year, bias_to_weight, fit_display, fit_level, weight_to_bias
from groovemill.functions.text import excerpt
from groovemill.operators import affinity, recommend, scorebook, scoring
from groovemill.sources.checkpoints import checkpointed, shared_folder
from groovemill.sources.domain import Tables, with_views

PROFILE = scoring.TasteProfile(weights={"C001": 1.0, "C005": 0.5, "C009": 0.25})
#: Corpus rows of a page, and which page.
OFFSET, LIMIT = 20, 20
LABELS = ("1-URGENT", "2-HIGH")


def _affinities(t: Tables):
    return affinity.album_affinities(affinity.community_masses(t.refs(), t.memberships()))


def _r(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


def _archive(t: Tables, profile: scoring.TasteProfile = PROFILE):
    return recommend.archive_candidates(t.reviews(), _affinities(t), profile)


def style_diversity(spark, sf_dir):
    scores = scoring.album_scores(_affinities(Tables(spark, sf_dir)), PROFILE.selected(spark))
    return scores.select("review_id", "hits", *_r("style_fit", "n_eff", "best"))


def style_fit_percentile(spark, sf_dir):
    scores = checkpointed(scoring.album_scores(_affinities(Tables(spark, sf_dir)), PROFILE.selected(spark)))
    return scoring.with_percentile(scores, "style_fit", scoring.percentile_table(scores, "style_fit", "fit_pct")).select("review_id", *_r("fit_pct"))


def breadth_percentile(spark, sf_dir):
    scores = checkpointed(scoring.album_scores(_affinities(Tables(spark, sf_dir)), PROFILE.selected(spark)))
    return scoring.with_percentile(scores, "n_eff", scoring.percentile_table(scores, "n_eff", "breadth_pct")).select("review_id", *_r("breadth_pct"))


def score_book(spark, sf_dir):
    """Percentiles kept between two runs: the first has two thirds of the albums, some with but one community; the second gets only albums that are new or changed."""
    path = f"{shared_folder(spark)}/book-{uuid.uuid4().hex}"
    every = checkpointed(_affinities(Tables(spark, sf_dir)))
    first = every.where("review_id % 3 <> 0 AND (review_id % 5 <> 0 OR community = 'C001')")
    scorebook.update(spark, path, first, first.select("review_id"), PROFILE, 1)
    changed = every.where("review_id % 3 = 0 OR review_id % 5 = 0")
    scorebook.update(spark, path, changed, changed.select("review_id"), PROFILE, 2)
    return scorebook.scores(spark, path).select("review_id", *_r("fit_pct", "breadth_pct"))


def batch_max_norm(spark, sf_dir):
    scores = scoring.album_scores(_affinities(Tables(spark, sf_dir)), PROFILE.selected(spark))
    normed = scoring.batch_max_norm(scores, "best", "best_norm")
    return normed.select("review_id", F.round(F.round("best_norm", 9), 6).alias("best_norm"))  # sums in another order must not turn a tie


def archive_recommendations(spark, sf_dir):
    rows = _archive(Tables(spark, sf_dir))
    return rows.select("review_id", "artist", "album", "hits", "label", "release_year", *_r("style_fit", "n_eff", "score", "breadth", "rating_effective", "rating_norm", "overall_score"))


def archive_page(spark, sf_dir):
    top = recommend.page_with_total(_archive(Tables(spark, sf_dir)), OFFSET, LIMIT)
    whole = F.round("overall_score", 9)
    return top.select("rank", "review_id", "artist", F.round("overall_score", 6).alias("overall_score"), fit_display(whole).alias("display"), fit_level(whole).alias("level"), "total")


def archive_filtered(spark, sf_dir):
    """Year bounds in the wrong order, one of them beyond the corpus; rating bounds beyond the scale; a label."""
    profile = scoring.TasteProfile(weights=PROFILE.weights, rating_range=(99, 4), year_range=(2500, 1996), labels=("1-URGENT",), score_range=(0.9, 0.2))
    return _archive(Tables(spark, sf_dir), profile).select("review_id", "label", "release_year", *_r("score", "overall_score"))


def newest_ranked(spark, sf_dir):
    t = Tables(spark, sf_dir)
    fresh = checkpointed(recommend.newest(t.reviews(), 200))
    rows = recommend.scored(fresh, recommend.corpus_scores(_affinities(t), PROFILE, fresh), PROFILE, "left")
    return recommend.page(rows, 0, 200).select("rank", "review_id", "artist", *_r("score", "breadth", "overall_score"))


def newest_pool(spark, sf_dir):
    t = Tables(spark, sf_dir)
    day = F.to_date("o_orderdate")
    batches = t.read("orders").groupBy(day.alias("run_at")).agg(F.collect_list("o_orderkey").alias("review_ids"))
    return recommend.newest_pool(t.reviews(), batches, 5).select("review_id", "artist")


def community_tags(spark, sf_dir):
    tags = affinity.community_tags(_affinities(Tables(spark, sf_dir)), PROFILE.selected(spark))
    return tags.select("review_id", "community", "matched", "place", *_r("share"))


def label_filter(spark, sf_dir):
    rows = Tables(spark, sf_dir).reviews()
    return rows.where(recommend.label_filter(F.col("label"), LABELS)).groupBy("label").agg(F.count("*").alias("n"))


def release_year_bounds(spark, sf_dir):
    year = best_year(F.col("release_year"), F.col("release_date").cast("string"))
    return Tables(spark, sf_dir).reviews().agg(F.min(year).cast("long").alias("first_year"), F.max(year).cast("long").alias("last_year"), F.max("review_id").alias("last_id"), F.count("*").alias("n"))


def score_histogram(spark, sf_dir):
    return recommend.histogram(recommend.corpus_scores(_affinities(Tables(spark, sf_dir)), PROFILE), "fit_pct")


def score_summary(spark, sf_dir):
    rows = recommend.corpus_scores(_affinities(Tables(spark, sf_dir)), PROFILE)
    v = F.round("fit_pct", 9)
    return rows.agg(F.round(F.percentile(v, F.lit(0.5)), 6).alias("median"), F.round(F.avg(v), 6).alias("mean"), F.round(F.avg((v >= 0.5).cast("double")), 6).alias("share_half"))


def highlights(spark, sf_dir):
    rows = _archive(Tables(spark, sf_dir))
    picks = recommend.highlights(rows, {"overall": "overall_score", "critic": "rating_effective", "broadest": "breadth", "fit": "score"})
    return picks.select("kind", "place", "review_id", "artist", *_r("value"))


def weight_mapping(spark, sf_dir):
    bias = F.round(F.col("c_acctbal") / 5000 - 1, 9)
    rows = Tables(spark, sf_dir).read("customer").select("c_custkey", F.round(bias_to_weight(bias), 6).alias("weight"), F.round(weight_to_bias(bias_to_weight(bias)), 6).alias("bias"))
    return rows


def text_repair_excerpt(spark, sf_dir):
    cut = excerpt(F.col("text"))
    return Tables(spark, sf_dir).read("documents").select("doc_id", cut.alias("x")).select("doc_id", "x.excerpt", "x.continues")


_SELECTED = ", ".join(f"('{c}', {w}::DOUBLE)" for c, w in PROFILE.weights.items())
_SCORES = f"""sel(community, weight) AS (VALUES {_SELECTED}),
    scores AS (SELECT review_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, sum(share * coalesce(weight, 0)))) AS style_fit, greatest(1.0::DOUBLE, exp(-sum(share * ln(share)))) AS n_eff,
    count(weight) AS hits, coalesce(max(share * weight), 0) AS best FROM affinities LEFT JOIN sel USING (community) GROUP BY 1)"""


def _percentile(value: str, out: str) -> str:
    key = f"round({value}, 9)"
    return f"""{out}_r AS (SELECT review_id, rank() OVER (ORDER BY {key}) + (count(*) OVER (PARTITION BY {key}) - 1) / 2.0::DOUBLE AS r FROM scores),
    {out}_t AS (SELECT review_id, CASE WHEN max(r) OVER () <= min(r) OVER () THEN 1.0::DOUBLE ELSE (r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()) END AS {out} FROM {out}_r)"""


_CORPUS = f"{_SCORES}, {_percentile('style_fit', 'fit_pct')}, {_percentile('n_eff', 'breadth_pct')}, corpus AS (SELECT * FROM scores JOIN fit_pct_t USING (review_id) JOIN breadth_pct_t USING (review_id))"
_UNIT = "greatest(0.0::DOUBLE, least(10.0::DOUBLE, coalesce(rating, 7.0::DOUBLE))) / 10.0::DOUBLE"


def _scored(join: str, source: str = "reviews") -> str:
    return f"""scored AS (SELECT r.*, coalesce(style_fit, 0) AS style_fit, coalesce(n_eff, 1) AS n_eff, coalesce(hits, 0) AS hits, coalesce(fit_pct, 0) AS score, coalesce(breadth_pct, 0) AS breadth,
    coalesce(rating, 7.0::DOUBLE) AS rating_effective, {_UNIT} AS rating_norm,
    0.7::DOUBLE * coalesce(fit_pct, 0) + 0.1::DOUBLE * ({_UNIT}) + 0.2::DOUBLE * coalesce(breadth_pct, 0) AS overall_score FROM {source} r {join} JOIN corpus USING (review_id))"""


_ALL = with_views("reviews", "affinities")
_ARCHIVE = f"{_ALL}, {_CORPUS}, {_scored('')}, archive AS (SELECT * FROM scored WHERE hits > 0 AND rating_effective BETWEEN 6 AND 10 AND round(score, 9) BETWEEN 0 AND 1)"
_ORDER = "round(overall_score, 9) DESC, round(score, 9) DESC, review_id DESC"
_TEXT = "".join(chr(c) for c in (128, 130, 131, 132, 133, 134, 135, 136, 137, 138, 139, 140, 142, *range(145, 157), 158, 159))


def _highlight_sql() -> str:
    steps, taken = [], []
    for i, (kind, column) in enumerate({"overall": "overall_score", "critic": "rating_effective", "broadest": "breadth", "fit": "score"}.items()):
        free = " AND ".join(f"artist NOT IN (SELECT artist FROM h{j})" for j in range(i)) or "true"
        steps.append(f"h{i} AS (SELECT '{kind}' AS kind, {i}::BIGINT AS place, review_id, artist, round({column}, 6) AS value FROM archive WHERE {free} ORDER BY round({column}, 9) DESC, review_id DESC LIMIT 1)")
        taken.append(f"SELECT * FROM h{i}")
    return f"{_ARCHIVE}, {', '.join(steps)} {' UNION ALL '.join(taken)}"


SQL = {
    "style_diversity": f"{_ALL}, {_SCORES} SELECT review_id, hits, round(style_fit, 6) AS style_fit, round(n_eff, 6) AS n_eff, round(best, 6) AS best FROM scores",
    "style_fit_percentile": f"{_ALL}, {_CORPUS} SELECT review_id, round(fit_pct, 6) AS fit_pct FROM corpus",
    "breadth_percentile": f"{_ALL}, {_CORPUS} SELECT review_id, round(breadth_pct, 6) AS breadth_pct FROM corpus",
    "batch_max_norm": f"{_ALL}, {_SCORES} SELECT review_id, round(round(CASE WHEN max(best) OVER () > 0 THEN best / max(best) OVER () ELSE 0 END, 9), 6) AS best_norm FROM scores",
    "archive_recommendations": f"""{_ARCHIVE} SELECT review_id, artist, album, hits, label, release_year, round(style_fit, 6) AS style_fit, round(n_eff, 6) AS n_eff, round(score, 6) AS score, round(breadth, 6) AS breadth,
        round(rating_effective, 6) AS rating_effective, round(rating_norm, 6) AS rating_norm, round(overall_score, 6) AS overall_score FROM archive""",
    "archive_page": f"""{_ARCHIVE} SELECT rank, review_id, artist, round(overall_score, 6) AS overall_score, CAST(CAST(round_even(round(overall_score, 9) * 100, 0) AS INT) AS VARCHAR) || '% Fit' AS display,
        CASE WHEN round(overall_score, 9) >= 0.75 THEN 'high' WHEN round(overall_score, 9) < 0.35 THEN 'low' ELSE 'medium' END AS level, total
        FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS rank, count(*) OVER () AS total FROM archive) WHERE rank > {OFFSET} AND rank <= {OFFSET + LIMIT}""",
    "archive_filtered": f"""{_ALL}, {_CORPUS}, {_scored("")}, y AS (SELECT max(coalesce(release_year, year(release_date))) AS last FROM reviews) SELECT review_id, label, release_year, round(score, 6) AS score, round(overall_score, 6) AS overall_score
        FROM scored, y WHERE hits > 0 AND rating_effective >= 4 AND coalesce(release_year, year(release_date)) BETWEEN least(1996, last) AND last AND (label IS NULL OR label = '1-URGENT') AND round(score, 9) BETWEEN 0.2 AND 0.9""",
    "newest_ranked": f"""{_ALL}, {_CORPUS}, fresh AS (SELECT * FROM reviews ORDER BY review_id DESC LIMIT 200), {_scored("LEFT", "fresh")}
        SELECT row_number() OVER (ORDER BY {_ORDER}) AS rank, review_id, artist, round(score, 6) AS score, round(breadth, 6) AS breadth, round(overall_score, 6) AS overall_score FROM scored""",
    "newest_pool": f"{with_views('reviews')} SELECT review_id, artist FROM reviews WHERE release_date IN (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders ORDER BY d DESC LIMIT 5)",
    "community_tags": f"""{_ALL}, sel(community, weight) AS (VALUES {_SELECTED}) SELECT review_id, community, weight IS NOT NULL AS matched, row_number() OVER (PARTITION BY review_id ORDER BY round(share, 9) DESC, community) AS place,
        round(share, 6) AS share FROM affinities LEFT JOIN sel USING (community) WHERE round(share, 9) >= 0.1""",
    "label_filter": f"{with_views('reviews')} SELECT label, count(*) AS n FROM reviews WHERE label IS NULL OR label IN {LABELS} GROUP BY 1",
    "release_year_bounds": f"""{with_views("reviews")} SELECT min(y) AS first_year, max(y) AS last_year, max(review_id) AS last_id, count(*) AS n FROM (
        SELECT review_id, coalesce(CASE WHEN release_year BETWEEN 1800 AND 2100 THEN release_year END, TRY_CAST(substr(CAST(release_date AS VARCHAR), 1, 4) AS BIGINT)) AS y FROM reviews)""",
    "score_histogram": f"{_ALL}, {_CORPUS} SELECT b.range AS bin, count(review_id) AS n FROM range(8) b LEFT JOIN corpus ON least(floor(round(fit_pct, 9) * 8), 7) = b.range GROUP BY 1",
    "score_summary": f"{_ALL}, {_CORPUS} SELECT round(quantile_cont(round(fit_pct, 9), 0.5), 6) AS median, round(avg(round(fit_pct, 9)), 6) AS mean, round(avg(CASE WHEN round(fit_pct, 9) >= 0.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_half FROM corpus",
    "highlights": _highlight_sql(),
    "weight_mapping": """SELECT c_custkey, round(w, 6) AS weight, round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, 2 * w - 1)), 6) AS bias
        FROM (SELECT c_custkey, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (round(c_acctbal / 5000 - 1, 9) + 1) / 2)) AS w FROM customer)""",
    "text_repair_excerpt": f"""SELECT doc_id, CASE WHEN n <= 300 THEN t ELSE regexp_replace(CASE WHEN last > 150 THEN substr(t, 1, last) ELSE substr(t, 1, 300) END, '\\s+$', '') END AS excerpt, n > 300 AS continues FROM (
        SELECT doc_id, t, length(t) AS n, 300 - strpos(reverse(substr(t, 1, 300)), ' ') - CASE WHEN contains(substr(t, 1, 300), ' ') THEN 0 ELSE 1000 END AS last FROM (
        SELECT doc_id, regexp_replace(translate(coalesce(text, ''), '{_TEXT}', '€‚ƒ„…†‡ˆ‰š‹Œž‘’“”•–—˜™š›œžŸ'), '^\\s+|\\s+$', '', 'g') AS t FROM documents))""",
}
SQL["score_book"] = f"SELECT * FROM ({SQL['style_fit_percentile']}) JOIN ({SQL['breadth_percentile']}) USING (review_id)"

QUERIES = {
    f.__name__: f
    for f in (
        style_diversity, style_fit_percentile, breadth_percentile, score_book, batch_max_norm, archive_recommendations, archive_page, archive_filtered, newest_ranked, newest_pool, community_tags, label_filter, release_year_bounds,
        score_histogram, score_summary, highlights, weight_mapping, text_repair_excerpt,
    )
}
