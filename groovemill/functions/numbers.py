"""Weights, ratings, years and scores as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least position weight, rating of unrated albums, share of each part of the overall score.
LEAST_WEIGHT = 0.2
DEFAULT_RATING = 7.0
ALPHA, BETA, GAMMA = 0.7, 0.1, 0.2
#: Sums differ in their last digits by the order of summation; keys are rounded before they are ranked.
KEY_DIGITS = 9


def position_weight(position: Column, n: Column, least: float = LEAST_WEIGHT) -> Column:
    """1 for the first of n references, falling evenly to ``least`` for the last."""
    falling = F.lit(least) + F.lit(1.0 - least) * (n - position) / (n - 1)
    return F.when(n <= 0, F.lit(least)).when(n == 1, F.lit(1.0)).otherwise(falling)


def effective_rating(rating: Column) -> Column:
    return F.coalesce(rating, F.lit(DEFAULT_RATING))


def rating_unit(rating: Column) -> Column:
    """The effective rating from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), effective_rating(rating))) / 10.0


def normal_weights(alpha: float, beta: float, gamma: float) -> tuple[float, float, float]:
    """Three weights without negatives that add up to 1; thirds if all are 0."""
    weights = [max(0.0, float(w)) for w in (alpha, beta, gamma)]
    total = sum(weights)
    return tuple(w / total for w in weights) if total > 0 else (1 / 3, 1 / 3, 1 / 3)


def overall_score(fit: Column, rating: Column, breadth: Column, weights: tuple[float, float, float] = (ALPHA, BETA, GAMMA)) -> Column:
    alpha, beta, gamma = normal_weights(*weights)
    return F.lit(alpha) * fit + F.lit(beta) * rating + F.lit(gamma) * breadth


def bias_to_weight(bias: Column) -> Column:
    """A bias from -1 to 1 as a weight from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (bias + 1) / 2))


def weight_to_bias(weight: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * weight - 1))


def best_year(release_year: Column, date_text: Column) -> Column:
    """The year if it lies in 1800 to 2100, else the first four characters of the date, if they are a number."""
    year = F.expr("NULL").cast("int") if release_year is None else release_year
    return F.coalesce(F.when(year.between(1800, 2100), year), F.substring(date_text, 1, 4).try_cast("int"))


def five_year_bucket(year: Column) -> Column:
    start = (F.floor(year / 5) * 5).cast("int")
    return F.concat(start.cast("string"), F.lit("-"), (start + 4).cast("string"))


def fit_level(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score < 0.35, "low").otherwise("medium")


def fit_display(score: Column) -> Column:
    """``NN% Fit``; halves are rounded to even, as Python does."""
    return F.concat(F.bround(score * 100, 0).cast("int").cast("string"), F.lit("% Fit"))
