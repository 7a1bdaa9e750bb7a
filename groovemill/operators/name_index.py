"""Which artist names mean the same, or stand in which texts, without comparing all with all.

A name that stands in a text has all its words there, so it is looked up by one of them: the one that the fewest texts have. An
inverted index of the texts' words finds the candidates, which are then tested by the rules of ``names``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groovemill.operators import names
from groovemill.sources.checkpoints import checkpointed


@F.pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("words", "bare", "forms")]))
def keys_udf(name: pd.Series) -> pd.DataFrame:
    """A name's plain words, those without a leading article, and the forms in which equal names are equal."""
    plain, folded = [names.plain(n or "") for n in name], [names.folded(n or "") for n in name]
    forms = [sorted({x for p in names.variants(f) for x in (p, " ".join(w for w in p.split() if w not in names.CONNECTORS)) if x}) for f in folded]
    return pd.DataFrame({"words": [p.split() for p in plain], "bare": [names.bare(p).split() for p in plain], "forms": forms})


def _keyed(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with their keys; read several times."""
    rows = df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    return checkpointed(rows.withColumn("k", keys_udf("value")).select("value", "k.words", "k.bare", "k.forms"))


def _phrase_candidates(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """name, text where all words of the name (keyed rows) stand one after the other in the text."""
    index = texts.select(F.col("value").alias("text"), F.explode(F.array_distinct("words")).alias("word"), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("line"))
    often = index.groupBy("word").agg(F.count("*").alias("n"))
    parts = asked.where(F.size("bare") > 0).select("value", "bare", F.explode(F.array_distinct("bare")).alias("word"))
    # a word that no text has rules its name out
    rarest = parts.join(often, "word", "left").groupBy("value", "bare").agg(F.min_by("word", F.struct("n", "word")).alias("word"), F.count_if(F.col("n").isNull()).alias("missing")).where("missing = 0")
    found = rarest.join(index, "word").where(F.contains("line", F.concat(F.lit(" "), F.array_join("bare", " "), F.lit(" "))))
    return found.select(F.col("value").alias("name"), "text")


def _tested(pairs: DataFrame, test: Callable) -> DataFrame:
    return pairs.distinct().withColumn("fits", test("name", "text")).where("fits").drop("fits")


def names_in_texts(asked: DataFrame, texts: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """name, text: each distinct name that stands in a text as an artist's name of its own, by ``names.in_text``. Nulls fit nothing."""
    return _tested(_phrase_candidates(_keyed(asked, name), _keyed(texts, text)), names.stands_in_udf)


def same_artists(asked: DataFrame, found: DataFrame, name: str = "name", other: str = "name") -> DataFrame:
    """name, text: each two distinct names of the tables that mean the same artist, by ``names.same_artist``. Nulls fit nothing."""
    left, right = _keyed(asked, name), _keyed(found, other)
    forms = lambda rows, to: rows.select(F.col("value").alias(to), F.explode("forms").alias("form"))
    equal = forms(left, "name").join(forms(right, "text"), "form").select("name", "text")
    inside = _phrase_candidates(left, right)
    around = _phrase_candidates(right, left).select(F.col("text").alias("name"), F.col("name").alias("text"))
    return _tested(equal.union(inside).union(around), names.same_artist_udf)
