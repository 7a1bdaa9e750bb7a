"""The pipeline's near-dedup against the Jaccard similarity of all pairs."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import pytest
from groovemill.llm import near_copies, near_dup
from tests.llm.conftest import SCHEMA


def alike_components(texts):
    """Smallest id of each text's component, by all pairs."""
    sets, label = {}, {i: i for i, _ in texts}
    for i, t in texts:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def _planted(rng):
    """A large group of near copies, chains of small steps, and texts that only share a passage."""
    words = [f"w{k}" for k in range(3000)]
    text = lambda n: [words[k] for k in rng.integers(0, 3000, n)]
    out, origin, passage = [], text(120), text(60)
    for _ in range(150):
        t = list(origin)
        for k in rng.integers(0, 120, rng.integers(0, 5)):
            t[k] = words[rng.integers(0, 3000)]
        out.append(t)
    chain = text(90)
    for k in range(12):
        chain = [*chain[1:], f"x{k}"] if k % 2 else [*chain[:40], f"y{k}", *chain[41:]]
        out.append(chain)
    out += [[*text(rng.integers(2, 80)), *passage, *text(5)] for _ in range(80)]
    out += [[], ["one"], ["ONE"], ["one", "two"], text(5), text(4)]
    return [(1000 + int(k), " ".join(out[k])) for k in rng.permutation(len(out))]


@pytest.mark.parametrize("hot", [1 << 12, 20])
def test_near_copies_by_all_pairs(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(near_copies, "HOT", hot)
    monkeypatch.setattr(near_dup, "SHARE", 1)  # many cells
    if hot == 20:
        monkeypatch.setattr(near_copies, "SHARE", 1)
        monkeypatch.setattr(near_copies, "HOT_KEY", 10)
        monkeypatch.setattr(near_copies, "REMEMBERED", 3)
        monkeypatch.setattr(near_copies, "MOST_BITS", 1 << 10)
    texts = [*rows, *_planted(np.random.default_rng(5))]
    wanted = alike_components(texts)
    assert len(set(wanted.values())) < len(texts) - 100
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(df).collect()} == wanted
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dup"](spark, df, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(wanted.values()))


def test_keys_are_counted_alike_in_parts(spark, monkeypatch):
    rows = [(k, f) for k in range(40) for f in range(k % 7 * 30)] + [(100, f) for f in range(5000)] * 2 + [(101, f) for f in range(5000)]
    prefixes = spark.createDataFrame(rows, "key long, fp long").repartition(8)
    whole = {tuple(r) for r in near_copies.shards(prefixes).collect()}
    assert {k for k, _ in whole} == {1, 2, 3, 4, 5, 6, 100}  # of keys with the same sets the least
    monkeypatch.setattr(near_copies, "SHARE", 1)
    monkeypatch.setattr(near_copies, "HOT_KEY", 100)
    assert {tuple(r) for r in near_copies.shards(prefixes).collect()} == whole


@pytest.mark.parametrize("n", [0, 1, 1000, 10**8, 10**12])
def test_size_of_the_map(n):
    bits = near_copies._map_bits(n)
    assert bits & (bits - 1) == 0 and 1 << 10 <= bits <= near_copies.MOST_BITS and (bits >= 8 * n or bits == near_copies.MOST_BITS)
    assert 0 <= near_copies._spread(np.array([0, 1, -1, 2**63 - 1]), bits).min() and near_copies._spread(np.array([0, 1, -1, 2**63 - 1]), bits).max() < bits


def test_near_copies_of_odd_rows(clashing, none):
    kept = near_copies.keep_one(clashing)
    assert kept.columns == clashing.columns and near_copies.keep_one(none).count() == 0
    assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == sorted(["1", "10", "4", "4", "None", "5", "6", "7", "8", "9"])


def test_pipeline_of_odd_tables(clashing, none, tmp_path, spark):
    """All stages over documents with odd rows and further columns, and over an empty table."""
    for name, table in (("odd", clashing), ("none", none)):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES[:-1]:
            kept = function(spark, docs, folder)
            assert kept.columns == table.columns, stage
            assert kept.join(docs, "doc_id", "left_anti").where("doc_id IS NOT NULL").count() == 0
        packed = corpus_pipeline.run(spark, folder)
        assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(packed.columns)
        assert packed.count() == 0 or name == "odd"


def test_one_template_on_many_rows(spark, monkeypatch):
    """Different pages of one template, each alike to it and to few others, and strangers: blocks of connected rows don't meet."""
    shipped = []
    linked = near_copies.linked

    def counted(rows, light, keys, node, link, hot_rows):
        shipped.append([])

        def counting(dealt):
            shipped[-1].append(dealt.count())
            return link(dealt)

        return linked(rows, light, keys, node, counting, hot_rows)

    monkeypatch.setattr(near_copies, "linked", counted)
    monkeypatch.setattr(near_copies, "HOT", 1 << 10)
    rng, n = np.random.default_rng(3), 12_000
    template = [f"t{k}" for k in range(60)]
    texts = [" ".join(template)]
    for k in range(n - 1):
        at = int(rng.integers(0, 60))
        texts.append(" ".join([*template[:at], f"x{k}", *template[at + 1 :]]))
    texts += [" ".join(f"s{k}-{i}" for i in range(30)) for k in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8).cache()
    found = near_copies.near_copies(df).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: 0 if i < n else i for i in range(len(texts))}
    # shards, then the check of sets, each with one or two rounds of blocks; blocks against blocks would be 12 for each document
    assert len(shipped) == 2 and sum(shipped[1]) <= 3 * n, shipped
