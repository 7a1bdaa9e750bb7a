"""Rejection by the language models: what odd and mislabelled rows among the training documents can't switch off."""

from __future__ import annotations

import numpy as np
from groovemill.llm import language
from pyspark.sql import functions as F
from tests.llm.conftest import SCHEMA, fold

FOREIGN = [
    "ja tak myślę że dzisiaj nie będzie padać deszcz ale jutro może być zimno na polach za miastem i w górach " * 3,
    "questa è una frase italiana che parla di musica e di dischi molto belli usciti negli ultimi anni a milano " * 3,
    "xqzv bkrt wwpl zzqk mnbv lkjh qwrt zxcv pflk jjwq vvxz kkqj bdgf " * 6,
]


def _rejected(spark, docs, planted):
    """Verdicts of all rows by doc_id; planted (text, label) are held out where the label is null, else trained on."""
    ids = iter(range(10**6, 2 * 10**6))
    free, taught = (iter([i for i in [next(ids) for _ in range(2000)] if (fold(i) == 0) == out]) for out in (True, False))
    rows = [(next(free if lang is None else taught), text, lang, "planted", len(text)) for text, lang in planted]
    found = language.predict_languages(docs.unionByName(spark.createDataFrame(rows, SCHEMA))).collect()
    verdicts = {r["doc_id"]: r["rejected"] for r in found}
    return verdicts, [verdicts[r[0]] for r in rows if r[2] is None]


def test_odd_training_rows_dont_switch_rejection_off(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rng = np.random.default_rng(1)
    junk = lambda: " ".join("".join(rng.choice(list("qxzvwkjbp"), rng.integers(3, 9))) for _ in range(80))
    wrong = [(junk(), lang) for lang in ("de", "en", "es", "fr") for _ in range(5)]
    verdicts, planted = _rejected(spark, docs, [(t, None) for t in FOREIGN] + wrong)
    assert all(planted)
    clean = [r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").collect()]
    assert len(clean) > 100 and np.mean([verdicts[i] for i in clean]) < 0.005  # a few mix languages


def test_small_languages_reject_as_well(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").where("lang = 'en' OR lang = 'es' AND doc_id % 4 = 0")
    few = docs.where(F.col("lang") == "es")
    assert few.count() < 60  # so under 20 for calibration
    verdicts, planted = _rejected(spark, docs, [(t, None) for t in FOREIGN])
    assert all(planted)
    assert np.mean([verdicts[r["doc_id"]] for r in few.collect()]) < 0.1
