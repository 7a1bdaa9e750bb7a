"""Operators 12 and 13 against plain versions and their SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from groovemill.llm import fim, merkle, queries
from pyspark.sql import functions as F
from tests.comparison import connect, spark_rows, sql_rows
from tests.llm.conftest import SCHEMA

# operator 12


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])))


def _tree(digests):
    """The root, and for each digest its siblings by level as (left, right)."""
    paths, level, members = [[] for _ in digests], list(digests), [[i] for i in range(len(digests))]
    while len(level) > 1:
        above, above_members = [], []
        for at in range(0, len(level), 8):
            run = level[at : at + 8]
            for k in range(len(run)):
                for i in members[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(H(*run))
            above_members.append([i for m in members[at : at + 8] for i in m])
        level, members = above, above_members
    return level[0], paths


def _plain(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        langs[lang].sort(key=lambda x: x[:3])
        trees[lang] = _tree([x[2] for x in langs[lang]])
    root, over = _tree([trees[x][0] for x in order])
    found = []
    for lang, above in zip(order, over, strict=True):
        for (_, _, leaf, r), path in zip(langs[lang], trees[lang][1], strict=True):
            path = path + above
            fold = leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                fold = _leaf({**r, "text": re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])})
            for left, right in path:
                fold = H(left, fold, right)
            found.append((r["doc_id"], leaf, trees[lang][0], root, H(*(a + b for a, b in path)), fold, fold == root))
    return found


def _made(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = merkle.digests(merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0))
    return sorted(map(tuple, got.collect()), key=repr), sorted(_plain([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows]), key=repr)


def test_manifest_gives_the_rows_of_its_sql(spark, sf_dir):
    assert spark_rows(queries.op12_merkle_manifest(spark, sf_dir)) == sql_rows(connect(sf_dir), queries.ORACLE_SQL["op12_merkle_manifest"])


@pytest.mark.parametrize("sizes", [(1,), (9,), (64, 65, 1, 7), (70, 2, 1, 1, 1, 3, 1, 1, 1, 8)])
def test_trees_of_many_shapes(spark, sizes):
    names = [None, "", "de", "\U0001f600", "é", "fr", "a", "-", "=", "z"]
    rows = [(i, f"Text {i}", names[k], "s", i) for k, n in enumerate(sizes) for i in range(100 * k, 100 * k + n)]
    random.Random(1).shuffle(rows)
    got, wanted = _made(spark, rows)
    assert got == wanted
    assert any(not r[-1] for r in got) or len(rows) < 8


def test_manifest_of_odd_rows(spark, odd, clashing, none):
    rows = [tuple(r) for r in odd.collect()]
    same = [(77, "Same Text", "en", "a", 9)] * 40
    got, wanted = _made(spark, rows + same)
    assert got == wanted
    assert merkle.manifest(clashing).count() == len(rows) and merkle.manifest(none).count() == 0
    assert all(r["verified"] for r in merkle.manifest(clashing).collect())


def test_equal_rows_are_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same = spark.range(0, 4000, 1, 8).select(F.lit(7).alias("doc_id"), F.lit("g").alias("g"), F.lit("h").alias("hash"))
        places = merkle.placed(same, "g", ["doc_id", "hash"], "test")
        assert sorted(r["idx"] for r in places.select("idx").collect()) == list(range(4000))
        ranges = spark.read.parquet(places.inputFiles()[0].rsplit("/", 1)[0]).groupBy("m_range").count().collect()
        assert len(ranges) > 1 and max(r["count"] for r in ranges) < 3000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# operator 13


def _filled(doc_id, text, seed=42):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    assert "".join(tokens) == text
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h, n = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)], len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", text, None, None
    if h[3] % 100 < 80:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_fill_gives_the_rows_of_its_sql(spark, sf_dir):
    assert spark_rows(queries.op13_fill_in_middle(spark, sf_dir)) == sql_rows(connect(sf_dir), queries.ORACLE_SQL["op13_fill_in_middle"])


ODD_TEXTS = ["", " ", "a", " a", "a ", "a  \t\n\x0b\x0c\rb  c", "x<P>y", "<<P", "a<", "<S", "\U0001f600 \U0001f600\U0001f601  é", "\x1c \x1d\x85　\xa0 z", "\n\n\n", "<M", "M><", "a\x00b c", "word " * 40_000]


def test_fill_by_a_plain_version(spark):
    rows = [(i, ODD_TEXTS[i % len(ODD_TEXTS)], "en", "a", 1) for i in range(12 * len(ODD_TEXTS))] + [(None, "no id at all", None, None, None), (5, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("n", "form", "output", "a", "b", "parts", "pieces", "digest")})
    out = fim.transform(docs)
    got = sorted((r["doc_id"] or -1, r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"]) for r in out.collect())
    key = lambda x: (x[0], x[3])
    assert sorted(got, key=key) == sorted(((r[0] or -1, *_filled(r[0], r[1])) for r in rows), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    for r in fim.digests(out).join(docs.select("doc_id", "text").dropDuplicates(), "doc_id").where("doc_id <> 5").collect():
        assert r["restored_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_fill_of_odd_rows(clashing, none):
    got = fim.digests(fim.transform(clashing)).collect()
    assert len(got) == clashing.count() and {r["form"] for r in got if r["doc_id"] in (1, 2)} == {"plain"}
    assert fim.digests(fim.transform(none)).count() == 0


@pytest.mark.parametrize(
    ("grammar", "text", "units"),
    [
        ("line", "a\n\nb\n", ["a\n", "\n", "b\n"]),
        ("sentence", "One. Two?! Three", ["One.", " Two?!", " Three"]),
        ("run", "ab12é, c", ["ab", "12", "é", ", ", "c"]),
        ("character", "a\U0001f600\né", ["a", "\U0001f600", "\n", "é"]),
        ("word", "", []),
    ],
)
def test_unit_grammars(spark, grammar, text, units):
    got = spark.createDataFrame([(text,)], "text string").select(fim.units(F.col("text"), grammar).alias("u")).first()["u"]
    assert got == units


def test_shares_of_forms(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    counts = {r["form"]: r["count"] for r in fim.transform(docs, plan=fim.Plan(seed=1, changed=90, spm=10)).groupBy("form").count().collect()}
    assert abs(counts["plain"] - 400) < 100 and abs(counts["spm"] - 360) < 100
