"""Anchored batches against a plain reading from end to end."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from groovemill.operators import batches

START = datetime(2024, 1, 1)
SCHEMA = "key string, id long, seen_at timestamp_ntz"


def _plain(rows, span):
    """(key, batch, run_at, n, ids) by reading each key in order."""
    out = []
    for key in {r[0] for r in rows}:
        own, found = sorted((at, i) for k, i, at in rows if k == key and at is not None), []
        for at, i in own:
            if not found or (at - found[-1][0][0]).total_seconds() > span:
                found.append([])
            found[-1].append((at, i))
        out += [(key, n, b[-1][0], len(b), [i for _, i in b]) for n, b in enumerate(found)]
    return sorted(out, key=repr)


def _rows(seconds, key="a"):
    return [(key, i, START + timedelta(seconds=s)) for i, s in enumerate(seconds)]


@pytest.mark.parametrize(
    ("seconds", "span"),
    [
        ([0, 100, 101, 200, 201, 202, 303, 1000], 100),
        ([0], 100),
        ([5, 5, 5, 5], 100),
        ([0, 1, 1, 2, 5], 0),
        ([s / 7 for s in range(0, 9000, 3)], 10),  # no gap at all: some 120 batches in a chain
        ([-50, -1, 0, 49, 50, 51, 99, 100, 151], 50),
    ],
)
def test_batches_of_a_dense_key(spark, seconds, span):
    rows = _rows(seconds)
    got = batches.anchored_batches(spark.createDataFrame(rows, SCHEMA), "key", span).collect()
    assert sorted(map(tuple, got), key=repr) == _plain(rows, span)


def test_batches_of_many_keys(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "c", None, ""]), i, None if i % 40 == 0 else START + timedelta(seconds=rng.choice([rng.random() * 5000, 60_000 + rng.random() * 100, rng.randrange(300) * 10]))) for i in range(1200)]
    got = batches.anchored_batches(spark.createDataFrame(rows, SCHEMA), "key", 130).collect()
    assert sorted(map(tuple, got), key=repr) == _plain(rows, 130)
    assert batches.anchored_batches(spark.createDataFrame([], SCHEMA), "key", 130).count() == 0
