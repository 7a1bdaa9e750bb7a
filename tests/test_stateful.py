"""Operators with state, event by event and against plain versions."""

from __future__ import annotations

import json
import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from groovemill.operators.batches import anchored_batches
from groovemill.streaming import stateful

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(autouse=True)
def on_disk(spark):
    before = spark.conf.get(stateful._PROVIDER)
    stateful.keep_state_on_disk(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set(stateful._PROVIDER, before)


def _at(minute):
    return (START + timedelta(minutes=minute)).isoformat()


def _fed(spark, folder, files, schema, made, name, ends=True):
    """The rows that ``made`` gives for files of rows, read one file after the other; queries by the clock don't end by themselves."""
    folder.mkdir()
    for i, rows in enumerate(files):
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(folder / f"{i}.json", (i + 1, i + 1))  # files are read by their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    sink = made(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder) + "-marks")
    if ends:
        assert sink.trigger(availableNow=True).start().awaitTermination(180)
    else:
        query = sink.start()
        query.processAllAvailable()
        query.stop()
    return spark.table(name).collect()


ARRIVALS = "key string, id long, seen_at timestamp"


def _arrivals(groups):
    ids = iter(range(1000))
    return [[{"key": k, "id": next(ids), "seen_at": _at(m)} for k, m in group] for group in groups]


def test_batches_close_with_the_watermark(spark, tmp_path):
    files = _arrivals([[("a", 0), ("a", 60), ("a", 170)], [("a", 200), ("a", 260)], [("a", 600), ("b", 601)], [("c", 9000)], [("c", 9001)]])
    got = _fed(spark, tmp_path / "in", files, ARRIVALS, stateful.anchored_stream, "closing")
    assert sorted((r["key"], list(r["ids"]), r["n"], r["late"]) for r in got) == [("a", [0, 1, 2], 3, False), ("a", [3, 4], 2, False), ("a", [5], 1, False), ("b", [6], 1, False)]
    assert {r["ids"][0]: r["run_at"].isoformat() for r in got}[0] == "2024-01-01T02:50:00"


def test_arrivals_out_of_order(spark, tmp_path):
    """Earlier arrivals within the watermark move the anchor and don't move run_at back."""
    files = _arrivals([[("a", 0), ("a", 60)], [("a", 55)], [("a", -5), ("a", 176)], [("z", 9000)], [("z", 9001)]])
    got = _fed(spark, tmp_path / "in", files, ARRIVALS, lambda s: stateful.anchored_stream(s, late_seconds=3600), "order")
    assert sorted((list(r["ids"]), r["run_at"].strftime("%H:%M"), r["late"]) for r in got if r["key"] == "a") == [([3, 0, 2, 1], "01:00", False), ([4], "02:56", False)]


def test_late_arrivals_are_kept_apart_and_counted(spark, tmp_path):
    files = _arrivals([[("a", 0), ("a", 10)], [("b", 1000)], [("b", 1001)], [("a", 5), ("a", 170), ("a", 900)], [("b", 5000)], [("b", 5001)]])
    got = _fed(spark, tmp_path / "in", files, ARRIVALS, stateful.anchored_stream, "late")
    assert sorted((r["key"], list(r["ids"]), r["late"]) for r in got) == [("a", [0, 1], False), ("a", [4, 5], True), ("a", [6], False), ("b", [2, 3], False)]
    assert [tuple(r) for r in stateful.late_counts(spark.table("late")).collect()] == [("a", 2)]


def test_stream_gives_the_batches_of_the_whole_table(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), m) for m in sorted(rng.sample(range(20_000), 150))]
    rng.shuffle(rows[:50])
    groups = [rows[i : i + 40] for i in range(0, len(rows), 40)] + [[("end", 90_000)], [("end", 90_001)]]
    files = _arrivals(groups)
    got = _fed(spark, tmp_path / "in", files, ARRIVALS, stateful.anchored_stream, "whole")
    table = spark.createDataFrame([(r["key"], r["id"], datetime.fromisoformat(r["seen_at"])) for f in files for r in f if r["key"] != "end"], ARRIVALS)
    wanted = anchored_batches(table, "key").collect()
    assert sorted((r["key"], tuple(r["ids"]), r["run_at"]) for r in got) == sorted((r["key"], tuple(r["ids"]), r["run_at"]) for r in wanted)
    assert not any(r["late"] for r in got)


EVENTS = "artist string, at timestamp, kind string, image string"


def _events(*events):
    return [{"artist": a, "at": (START + timedelta(days=d)).isoformat(), "kind": k, "image": i} for a, d, k, i in events]


def test_lookups_that_found_nothing_expire(spark, tmp_path):
    files = [
        _events(("x", 0, "ask", None), ("y", 0, "ask", None), ("x", 1, "not_found", None)),
        _events(("x", 2, "ask", None), ("x", 30.9, "ask", None), ("y", 1, "found", "p.jpg")),
        _events(("x", 31, "ask", None), ("y", 400, "ask", None), (None, 3, "ask", None)),
        _events(("x", 32, "not_found", None), ("x", 33, "ask", None), ("x", 34, "found", "q.jpg"), ("x", 35, "not_found", None), ("x", 36, "ask", None)),
    ]
    got = _fed(spark, tmp_path / "in", files, EVENTS, stateful.answered_lookups, "lookups", ends=False)
    day = lambda r: round((r["at"].replace(tzinfo=timezone.utc) - START) / timedelta(days=1), 1)
    assert sorted((r["artist"], day(r), r["answer"], r["image"]) for r in got) == [
        ("x", 0.0, "resolve", None), ("x", 2.0, "blocked", None), ("x", 30.9, "blocked", None), ("x", 31.0, "resolve", None), ("x", 33.0, "blocked", None), ("x", 36.0, "cached", "q.jpg"),
        ("y", 0.0, "resolve", None), ("y", 400.0, "cached", "p.jpg"),
    ]


def test_records_that_block_a_lookup(spark):
    rows = [("not_found", "2024-01-01", "2024-01-30"), ("not_found", "2024-01-01", "2024-01-31"), ("found", "2024-01-01", "2024-01-02"), ("not_found", None, "2024-01-02"), (None, "2024-01-01", "2024-01-02")]
    df = spark.createDataFrame(rows, "status string, fetched string, now string")
    got = df.select(stateful.blocks_lookup(F.col("status"), F.to_timestamp("fetched"), F.to_timestamp("now")).alias("b")).collect()
    assert [r["b"] for r in got] == [True, False, False, False, False]
