"""Scores of albums against a taste profile, and their percentiles over the corpus."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groovemill.functions.numbers import ALPHA, BETA, GAMMA, KEY_DIGITS
from groovemill.sources.checkpoints import checkpointed


#: Fixed value: the weight of a selected community that the profile gives none.
DEFAULT_WEIGHT = 0.5


@dataclass(frozen=True)
class TasteProfile:
    """Selected communities with weights from 0 to 1 (null: DEFAULT_WEIGHT), shares of the score's parts, and hard filters."""

    weights: dict[str, float | None] = field(default_factory=dict)
    alpha: float = ALPHA
    beta: float = BETA
    gamma: float = GAMMA
    score_range: tuple[float, float] = (0.0, 1.0)
    rating_range: tuple[float, float] = (6.0, 10.0)
    year_range: tuple[int, int] | None = None
    labels: tuple[str, ...] | None = None

    def selected(self, spark: SparkSession) -> DataFrame:
        """community, weight of the selected communities: as many rows as the profile names."""
        return spark.createDataFrame([(c, DEFAULT_WEIGHT if w is None else min(1.0, max(0.0, float(w)))) for c, w in sorted(self.weights.items())], "community string, weight double")


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """p_key (the value, rounded), n: how many rows have it. Counts of parts of a table add up to those of the whole."""
    return df.groupBy(F.round(F.col(value), KEY_DIGITS).alias("p_key")).agg(F.count("*").alias("n"))


def changed_counts(counts: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """Counts (p_key, n) without those of what is gone and with those of what is new; only the changed rows need to be read for them."""
    parts = counts.select("p_key", "n").union(gone.select("p_key", -F.col("n"))).union(new.select("p_key", "n"))
    return parts.groupBy("p_key").agg(F.sum("n").alias("n")).where("n > 0")


def percentiles(counts: DataFrame, out: str, width: float = 1e-3) -> DataFrame:
    """p_key and its percentile by counts (p_key, n; read several times): average ranks of ties, rescaled to 0 to 1. One row, or all equal, give 1.

    Ranks are sums within ranges of ``width`` and over the ranges, so that no task sees all values.
    """
    counts = counts.withColumn("range", F.floor(F.col("p_key") / width))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("range").agg(F.sum("n").alias("in_range")).select("range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("earlier"))
    ends = counts.agg(((F.min_by("n", "p_key") + 1) / 2).alias("low"), (F.sum("n") - (F.max_by("n", "p_key") - 1) / 2).alias("high"))
    within = Window.partitionBy("range").orderBy("p_key").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.col("earlier") + F.sum("n").over(within) - F.col("n") + (F.col("n") + 1) / 2
    ranked = counts.join(ranges, "range").select("p_key", rank.alias("rank")).crossJoin(F.broadcast(ends))  # one row
    return ranked.select("p_key", F.when(F.col("high") <= F.col("low"), F.lit(1.0)).otherwise((F.col("rank") - F.col("low")) / (F.col("high") - F.col("low"))).alias(out))


def percentile_table(df: DataFrame, value: str, out: str, width: float = 1e-3) -> DataFrame:
    """``percentiles`` of a column's values, of which there is a row for each distinct one; they are counted once and kept by a checkpoint."""
    return percentiles(checkpointed(value_counts(df, value)), out, width)


def with_percentile(df: DataFrame, value: str, table: DataFrame) -> DataFrame:
    """``df`` with the percentile that ``percentile_table`` has for the value."""
    return df.join(table, F.round(F.col(value), KEY_DIGITS) == F.col("p_key"), "left").drop("p_key")


def album_scores(affinities: DataFrame, selected: DataFrame) -> DataFrame:
    """review_id, style_fit (weights of the selected communities over all positive shares, 0 to 1), n_eff (effective
    number of communities, exp of the entropy), hits and best (largest contribution) of each album."""
    positive = affinities.where("share > 0").join(F.broadcast(selected.select("community", F.col("weight"))), "community", "left")
    total = Window.partitionBy("review_id")
    p = positive.withColumn("p", F.col("share") / F.sum("share").over(total))
    weight = F.coalesce("weight", F.lit(0.0))
    sums = p.groupBy("review_id").agg(
        F.sum(F.col("p") * weight).alias("fit"),
        F.exp(-F.sum(F.col("p") * F.log("p"))).alias("n_eff"),
        F.count_if(F.col("weight").isNotNull()).alias("hits"),
        F.coalesce(F.max(F.col("share") * F.col("weight")), F.lit(0.0)).alias("best"),
    )
    return sums.select("review_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "fit")).alias("style_fit"), F.greatest(F.lit(1.0), "n_eff").alias("n_eff"), "hits", "best")


def batch_max_norm(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with the value over the largest value; 0 where that isn't positive."""
    top = df.agg(F.max(value).alias("top"))
    return df.crossJoin(F.broadcast(top)).withColumn(out, F.when(F.col("top") > 0, F.col(value) / F.col("top")).otherwise(F.lit(0.0))).drop("top")
