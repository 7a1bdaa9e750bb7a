"""Scores and their percentiles kept between runs, and brought up to date by the albums that have changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groovemill.operators.scoring import TasteProfile, album_scores, changed_counts, percentiles, value_counts, with_percentile
from groovemill.sources import versions
from groovemill.sources.checkpoints import checkpointed

#: What percentiles are kept of, and the columns that they go to.
KEPT = {"style_fit": "fit_pct", "n_eff": "breadth_pct"}


def update(spark: SparkSession, path: str, affinities: DataFrame, changed: DataFrame, profile: TasteProfile, run: int) -> bool:
    """Brings the book at ``path`` up to date; false if this run (numbers ascend) is in it already.

    changed: review_id of albums that are new, have changed or are gone. affinities: review_id, community, share of those that are there;
    nothing else of the corpus is read. The book has the albums' scores and, for each distinct value, how many albums have
    it; counts of the albums' earlier values are taken off and those of the new ones added. The tables are versions of
    their own with the run's number, so a run that fails in between is finished by the same run again.
    """
    ids = checkpointed(changed.select("review_id").distinct())
    new = checkpointed(album_scores(affinities.join(ids, "review_id", "left_semi"), profile.selected(spark)))
    known = versions.version(spark, f"{path}/scores")
    if known and known.batches.get("run", -1) >= run:
        # the scores are in: what they replaced is in the version before
        before = versions.read(spark, f"{path}/scores", known.number - 1) if known.batches["run"] == run and known.number > 1 else None
    else:
        before = versions.read(spark, f"{path}/scores")
    old = checkpointed(before.join(ids, "review_id", "left_semi")) if before is not None else new.limit(0)
    done = versions.replace(spark, f"{path}/scores", lambda rows: new if rows is None else rows.join(ids, "review_id", "left_anti").unionByName(new), batch=("run", run)) is not None
    for value in KEPT:
        gone, added = value_counts(old, value), value_counts(new, value)
        done |= versions.replace(spark, f"{path}/{value}", lambda counts: added if counts is None else changed_counts(counts, gone, added), batch=("run", run)) is not None  # noqa: B023
    return done


def scores(spark: SparkSession, path: str, of: DataFrame | None = None) -> DataFrame:
    """The book's scores with their percentiles among all of its albums, or those of the albums ``of`` (review_id)."""
    rows = versions.read(spark, f"{path}/scores")
    if of is not None:
        rows = rows.join(of.select("review_id"), "review_id", "left_semi")
    for value, out in KEPT.items():
        rows = with_percentile(rows, value, percentiles(versions.read(spark, f"{path}/{value}"), out))
    return rows
