"""Operator 3: quality rules, a table of thresholds compiled into one projection of Spark's own functions.

Features are counts and ratios of one row's text; no rows are moved and no Python runs on executors.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common function words of the languages served.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by are this at from "
    "de la le et les en des un du une que est pour par dans avec qui pas sur au "
    "der die und in den von zu das sich mit des auf für ist im nicht dem ein eine "
    "el y los las se del por con no una su para es al lo"
).split()
SYMBOLS = "#*$%&|<>"
#: Words in a window of the repetition rule.
WINDOW = 3


class Rule(NamedTuple):
    """A document fails if the feature lies outside the bounds; an open bound is None."""

    feature: str
    least: float | None
    most: float | None


#: A text of fewer than 50 words, or more than half of it in repeated windows, always fails (``base_failed``).
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_word_ratio", 0.05, None),
    Rule("dup_line_ratio", None, 0.35),
    Rule("mean_line_words", 2.0, None),
)

_SPACES = " \t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with a struct ``q`` of counts; null and empty texts have zeros.

    Windows are put in order by a hash of their words and then by the words themselves, so that equal ones stand together.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    at = lambda array, i: F.get(array, i)
    w, lines, windows, repeats = (F.col(f"q_{x}") for x in ("words", "lines", "windows", "repeats"))
    split = docs.withColumns({"q_words": _words(text), "q_lines": F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(_SPACES)) != "")})
    hashed = split.withColumn("q_windows", F.sort_array(F.transform(F.slice(w, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))), lambda x, i: F.struct(F.struct(F.xxhash64(x, *(at(w, i + k) for k in range(1, WINDOW))).alias("h"), x.alias("w0"), *(at(w, i + k).alias(f"w{k}") for k in range(1, WINDOW))).alias("h"), i.alias("i")))))
    same = lambda i, x: F.coalesce(at(windows, i)["h"] == x["h"], F.lit(False))
    found = hashed.withColumn("q_repeats", F.sort_array(F.transform(F.filter(windows, lambda x, i: same(i + 1, x) | ((i > 0) & same(F.greatest(i - 1, F.lit(0)), x))), lambda x: x["i"])))
    # each repeated window covers its words up to the next repeated window
    covered = F.aggregate(repeats, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    counts = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        covered.cast("long").alias("n_repeat_words"),
    )
    return found.withColumn("q", counts).drop("q_words", "q_lines", "q_windows", "q_repeats")


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where all rules hold for the ratios of ``q``."""
    ratios = {"mean_word_chars": _ratio("q.word_chars", "q.n_words"), "symbol_ratio": _ratio("q.n_symbols", "q.n_words"), "stop_word_ratio": _ratio("q.n_stop_words", "q.n_words"), "dup_line_ratio": _ratio("q.n_dup_lines", "q.n_lines"), "mean_line_words": _ratio("q.n_words", "q.n_lines")}
    verdict = F.lit(True)
    for rule in rules:
        value = ratios.get(rule.feature, F.col(f"q.{rule.feature}"))
        if rule.least is not None:
            verdict = verdict & (value >= rule.least)
        if rule.most is not None:
            verdict = verdict & (value <= rule.most)
    return verdict


def _judged(docs: DataFrame, columns: list[Column], rules: tuple[Rule, ...]) -> DataFrame:
    """``columns`` of each row with base_failed and kept.

    Spark moves no filter below a projection that isn't deterministic. Without one it would put the features' whole
    expressions in place of their columns where a caller filters, and evaluate them again for each use.
    """
    failed = (F.col("q.n_words") < 50) | (100 * F.col("q.n_repeat_words") > 50 * F.col("q.n_words"))
    verdicts = with_features(docs).select(*columns, failed.alias("base_failed"), (~failed & compiled(rules)).alias("kept"), F.monotonically_increasing_id().alias("q_at"))
    return verdicts.where("q_at >= 0").drop("q_at")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the counts, base_failed and kept of each row.

    A null or empty text has zero counts and fails. Rows stay as they are, repeated ones as well; further columns of
    ``docs`` are ignored.
    """
    return _judged(docs.select("doc_id", "text"), [F.col("doc_id"), F.col("q.*")], rules)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` whose text passes, with their own columns."""
    own = docs.select(F.struct(*docs.columns).alias("q_row"), F.col("text"))
    return _judged(own, [F.col("q_row")], rules).where("kept").select("q_row.*")
