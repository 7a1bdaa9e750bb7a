"""Data quality of reviews and metadata: counts in one pass, and findings where they pass a threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groovemill.functions.text import strip

#: Shares above which a rule fires, length of a short text, bounds of years and ratings.
EMPTY_RATE = SHORT_RATE = 0.01
MISSING_RATE = 0.5
SHORT_TEXT = 50
LEAST_YEAR = 1900
MOST_RATING = 15.0


def review_stats(rows: DataFrame, this_year: int) -> DataFrame:
    """One row of counts. rows: id, url, artist, album, text, release_year, rating; a null id counts as missing."""
    text = F.length(strip(F.coalesce("text", F.lit(""))))
    blank = F.lit(False)
    for c in ("id", "url", "artist", "album", "text"):
        blank = blank | F.col(c).isNull() | (strip(F.col(c).cast("string")) == "")
    valid = F.col("id").isNotNull()
    # what is there but no number is an outlier as well
    number = lambda c: F.col(c).cast("string").try_cast("double")
    outlier = lambda c, low, high: F.col(c).isNotNull() & F.coalesce((number(c) < low) | (number(c) > high), F.lit(True))
    counts = rows.agg(
        F.count("*").alias("n_rows"),
        F.count_if(valid).alias("n_valid"),
        F.count_if(valid & (text == 0)).alias("n_empty_text"),
        F.count_if(valid & (text > 0) & (text < SHORT_TEXT)).alias("n_short_text"),
        F.count_if(valid & outlier("release_year", LEAST_YEAR, this_year + 1)).alias("n_year_outlier"),
        F.count_if(valid & outlier("rating", 0, MOST_RATING)).alias("n_rating_outlier"),
        F.count_if(blank).alias("n_missing_field"),
    )
    repeated = rows.where(valid).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n_duplicate_ids"))
    return counts.crossJoin(repeated)


#: Code, severity, counter that is reported, and when a rule fires on a row of ``review_stats``.
REVIEW_RULES = (
    ("REVIEWS_DUPLICATE_ID", "error", "n_duplicate_ids", "n_duplicate_ids > 0"),
    ("REVIEWS_ZERO_VALID", "error", "n_rows", "n_rows > 0 AND n_valid = 0"),
    ("REVIEWS_EMPTY_TEXT_RATE", "warning", "n_empty_text", f"n_empty_text / greatest(n_valid, 1) > {EMPTY_RATE}D"),
    ("REVIEWS_SHORT_TEXT_RATE", "warning", "n_short_text", f"n_short_text / greatest(n_valid, 1) > {SHORT_RATE}D"),
    ("REVIEWS_RELEASE_YEAR_OUTLIER", "warning", "n_year_outlier", "n_year_outlier > 0"),
    ("REVIEWS_RATING_OUTLIER", "warning", "n_rating_outlier", "n_rating_outlier > 0"),
    ("REVIEWS_MISSING_REQUIRED_FIELDS", "warning", "n_missing_field", "n_missing_field > 0"),
)
#: The same on a row of ``file_stats``: of reviews, and of metadata with ``metadata_stats`` beside it.
REVIEW_FILE_RULES = (("REVIEWS_FILE_MISSING", "warning", "n_lines", "missing"), ("REVIEWS_INVALID_JSON_LINES", "warning", "n_invalid", "n_invalid > 0"))
METADATA_RULES = (
    ("METADATA_IMPUTED_MISSING", "warning", "n_lines", "missing"),
    ("METADATA_DUPLICATE_REVIEW_ID", "error", "n_duplicate_ids", "n_duplicate_ids > 0"),
    ("METADATA_INVALID_LINES", "warning", "n_invalid", "n_invalid > 0"),
    ("METADATA_COVERAGE_LOW", "warning", "n_missing", f"NOT missing AND n_missing / greatest(n_reviews, 1) > {MISSING_RATE}D"),
)


def findings(stats: DataFrame, rules: tuple[tuple[str, str, str, str], ...] = REVIEW_RULES) -> DataFrame:
    """code, severity, n of the rules that fire on a row of counts; rates have to be above their threshold."""
    rows = F.array(*(F.when(F.expr(fires), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(n).cast("long").alias("n"))) for code, severity, n, fires in rules))
    return stats.select(F.inline(F.array_compact(rows)))


def file_stats(rows: DataFrame, good: Column, missing: bool) -> DataFrame:
    """One row: n_lines, n_invalid (those where ``good`` doesn't hold) and whether the file is missing; rows are its lines that aren't blank."""
    return rows.agg(F.count("*").alias("n_lines"), F.count_if(~F.coalesce(good, F.lit(False))).alias("n_invalid")).withColumn("missing", F.lit(missing))


def metadata_stats(rows: DataFrame, reviews: DataFrame, missing: bool) -> DataFrame:
    """One row: ``file_stats`` of metadata lines (review_id, null where a line has none that is a number), ids that occur twice, reviews (id) and those without metadata."""
    own = rows.where("review_id IS NOT NULL").groupBy("review_id").agg(F.count("*").alias("times"))
    known = reviews.select(F.col("id").alias("review_id")).where("review_id IS NOT NULL").distinct()
    seen = known.join(own, "review_id", "left").agg(F.count("*").alias("n_reviews"), F.count_if(F.col("times").isNull()).alias("n_missing"))
    twice = own.agg(F.count_if(F.col("times") > 1).alias("n_duplicate_ids"))
    return file_stats(rows, F.col("review_id").isNotNull(), missing).crossJoin(twice).crossJoin(seen)  # one row each


def artifact_findings(lines: dict[str, int], spark: SparkSession) -> DataFrame:
    """code, severity, n of exports (by name) that are missing (-1 lines) or have no line."""
    bad = [(f"ARTIFACT_{name.upper()}_{'MISSING' if n < 0 else 'EMPTY'}", "error", max(n, 0)) for name, n in sorted(lines.items()) if n <= 0]
    return spark.createDataFrame(bad, "code string, severity string, n long")


def coverage(reviews: DataFrame, metadata: DataFrame, key: str, sample: int = 15) -> DataFrame:
    """One row: reviews, those without metadata, their rate, whether it is too high, and the first missing ids."""
    missing = reviews.select(key).distinct().join(metadata.select(key), key, "left_anti")
    first = missing.orderBy(key).limit(sample).agg(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("long"))), ",").alias("sample_ids"))
    total = reviews.agg(F.countDistinct(key).alias("n_reviews"))
    return missing.agg(F.count("*").alias("n_missing")).crossJoin(total).crossJoin(first).select("n_reviews", "n_missing", (F.col("n_missing") / F.greatest(F.col("n_reviews"), F.lit(1))).alias("rate"), (F.col("n_missing") / F.greatest(F.col("n_reviews"), F.lit(1)) > MISSING_RATE).alias("too_low"), "sample_ids")


def severity_counts(found: DataFrame, strict: bool = False) -> DataFrame:
    """One row: errors, warnings, and the exit code (1 for an error, and for a warning if ``strict``)."""
    errors, warnings = (F.count_if(F.col("severity") == s) for s in ("error", "warning"))
    fails = (errors > 0) | (F.lit(strict) & (warnings > 0))
    return found.agg(errors.alias("errors"), warnings.alias("warnings"), fails.cast("int").alias("exit_code"))


def label_buckets(reviews: DataFrame, frequent_above: int = 50) -> DataFrame:
    """label, n, frequent: albums per record label; labels of more than ``frequent_above`` albums are frequent."""
    counted = reviews.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))
    return counted.withColumn("frequent", F.col("n") > frequent_above)
