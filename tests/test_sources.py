"""Readers, writers, batches and streams over small files."""

from __future__ import annotations

import json
import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from groovemill.operators import batches, pages
from groovemill.sources import documents, jsonl, sample_corpus, versions
from groovemill.streaming import ingest


def _write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_lenient_lines(spark, tmp_path):
    path = _write(tmp_path / "a.jsonl", '{"id": 1, "x": "a"}\n\n  \n[1]\n{"id": 2, "x": "b"}\nnope\n{"id": 1, "x": "c"}\n{"x": "d"}\n{"id": "e"}\n')
    rows = jsonl.read_jsonl(spark, path, "id long, x string")
    assert rows.count() == 7 and jsonl.count_lines(spark, path) == 7 and jsonl.count_lines(spark, f"{path}-none") == -1
    assert sorted((r["id"], r["x"]) for r in jsonl.read_keyed(spark, path, "id long, x string", "id").collect()) == [(1, "c"), (2, "b")]
    assert {r["id"] for r in jsonl.read_ids(spark, path, "id").collect()} == {1, 2}
    assert jsonl.read_jsonl(spark, f"{path}-none", "id long").count() == 0


def test_the_last_line_over_files_wins(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(4):  # the first file is the largest, which Spark reads first
        _write(folder / f"{i}.jsonl", "\n".join(json.dumps({"id": k, "x": f"{i}-{k}-{'y' * (4 - i) * 50}"}) for k in [*range(200), 7]))
    got = {r["id"]: r["x"] for r in jsonl.read_keyed(spark, str(folder), "id long, x string", "id").collect()}
    assert len(got) == 200 and all(x.startswith("3-") for x in got.values())


def test_typed_reviews(spark, tmp_path):
    rows = [{"id": 1, "artist": "A\x92s", "album": "B", "text": "t\x96", "labels": ["L"], "extra": {"k": "v"}, "release_date": "2020-05-01"}, {"id": 2, "artist": "A", "album": "B", "text": "  "}, {"id": 1, "artist": "late", "album": "B", "text": "x"}]
    path = _write(tmp_path / "r.jsonl", "\n".join(json.dumps(r) for r in rows))
    got = jsonl.read_reviews(spark, path).orderBy("artist").collect()
    assert [(r["artist"], r["text"]) for r in got] == [("A’s", "t–"), ("late", "x")] and got[0]["extra"] == {"k": "v"} and str(got[0]["release_date"]) == "2020-05-01"
    assert [r["artist"] for r in jsonl.read_keyed(spark, path, jsonl.REVIEW, "id").where("id = 1").collect()] == ["late"]


def test_log_lines(spark, tmp_path):
    said = "Found {} new reviews ({}-{}). Continuing with enrichment."
    path = _write(tmp_path / "log", "\n".join([f"2024-01-02 04:04:05,678 INFO {said.format(3, 10, 12)}", f"  2024-01-02 05:00:00 x {said.format(1, 40, 40)}", f"2024-01-03 00:00:00,001 x {said.format(1, 9, 7)}", f"no time {said.format(2, 1, 2)}", "2024-01-04 00:00:00,000 nothing"]))
    known = spark.createDataFrame([(i,) for i in (1, 10, 12, 13)], "review_id long")
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    stamp = lambda df: {(r["t"], tuple(r["review_ids"])) for r in df.select(F.date_format("run_at", "yyyy-MM-dd HH:mm:ss.SSS").alias("t"), "review_ids").collect()}
    assert stamp(jsonl.read_log_batches(spark, path, known, now)) == {("2024-01-02 04:04:05.678", (10, 12))}
    other = spark.createDataFrame([(2,), (1,)], "review_id long")
    assert stamp(jsonl.read_log_batches(spark, path, other, now)) == {("2030-01-01 00:00:00.000", (1, 2))}
    assert jsonl.read_log_batches(spark, f"{path}-none", known, now).count() == 0


def test_batches_are_read_in_order_and_appended_once(spark, tmp_path):
    lines = [{"run_at": "2024-02-01T00:00:00Z", "review_ids": [3]}, {"run_at": "2024-01-01T00:00:00Z", "review_ids": [1, 2]}, {"run_at": "x", "review_ids": [1]}, {"run_at": "2024-03-01T00:00:00Z", "review_ids": []}]
    path = _write(tmp_path / "b.jsonl", "\n".join(map(json.dumps, lines)))
    stored = jsonl.read_batches(spark, path)
    assert [list(r["review_ids"]) for r in stored.collect()] == [[1, 2], [3]]
    new = lambda ids: spark.createDataFrame([(datetime(2025, 1, 1), ids)], "run_at timestamp, review_ids array<long>")
    assert batches.append_batch(stored, new([3, 3])).count() == 2 and batches.append_batch(stored, new([])).count() == 2
    assert [list(r["review_ids"]) for r in batches.append_batch(stored, new([5, 4, 5])).where("run_at > '2024-12-01'").collect()] == [[5, 4]]


def test_documents(spark, tmp_path):
    one = _write(tmp_path / "c.json", json.dumps({"resolution": 10, "communities": [{"id": "C1", "centroid": "a", "size": 3, "top_artists": ["a"]}, {"id": ""}, {"centroid": "b"}]}))
    assert [(r["community"], r["resolution"]) for r in documents.read_communities(spark, one).collect()] == [("C1", 10.0)]
    for bad in (f"{one}-none", _write(tmp_path / "d.json", "{")):
        assert documents.read_communities(spark, bad).count() == 0
        with pytest.raises(ValueError):
            documents.read_communities(spark, bad, strict=True)
    labels = _write(tmp_path / "l.json", json.dumps({"labels": [{"community_id": "C1", "genre_label": "Pop"}, {"community_id": "C2", "genre_label": ""}, {"genre_label": "x"}]}))
    assert [(r["community"], r["label"]) for r in documents.read_labels(spark, labels).collect()] == [("C1", "Pop")]
    whole = _write(tmp_path / "p.json", json.dumps({"mbid:1": {"artist_name": "A", "total_albums": 2, "genre_counts": {"pop": 2}, "main_genres": ["pop"]}, "name:B": {"artist_name": "B", "total_albums": 1}}))
    assert {(r["artist_key"], r["total_albums"]) for r in documents.read_profiles(spark, whole).collect()} == {("mbid:1", 2), ("name:B", 1)}
    assert documents.read_profiles(spark, f"{whole}-none").count() == 0
    assert (documents.res_key(10.0), documents.res_file(1.5)) == ("res_10", "communities_res_1_5.json")
    members = _write(tmp_path / "m.jsonl", '{"artist_id": "a", "communities": {"res_10": "C1"}}\n{"artist_id": "b", "communities": {"res_1": "C1"}}\n{"communities": {"res_10": "C1"}}\n')
    assert [tuple(r) for r in documents.read_memberships(spark, members).collect()] == [("a", "C1")]


def test_anchored_batches_by_a_plain_scan(spark):
    start, rows = datetime(2024, 1, 1), []
    for k, gaps in (("a", [0, 60, 60, 70, 200, 179, 1, 2000, 0, 181]), ("b", [0, 180, 1]), ("c", [0] * 5)):
        at = start
        for i, minutes in enumerate(gaps):
            at += timedelta(minutes=minutes)
            rows.append((k, i, at))
    wanted = []
    for k in "abc":
        open_, number = [], 0
        for _, i, at in [r for r in rows if r[0] == k]:
            if open_ and (at - open_[0][1]).total_seconds() > 3 * 3600:
                wanted.append((k, number, open_[-1][1], [x for x, _ in open_]))
                open_, number = [], number + 1
            open_.append((i, at))
        wanted.append((k, number, open_[-1][1], [x for x, _ in open_]))
    got = batches.anchored_batches(spark.createDataFrame(rows, "k string, id long, seen_at timestamp_ntz"), "k").collect()
    assert sorted((r["k"], r["batch"], r["run_at"], list(r["ids"])) for r in got) == wanted


def _page(head="Kestrel Row - Salt Maps", facts="Northlight", rating="", body="<p>Slow and bright.</p>", more=""):
    return f'<div id="rezension"><div class="headerbox"><h1>{head}</h1><p>{facts}</p>{rating}</div><div id="rezitext">{body}</div>{more}</div>'


OURS, YOURS = ('<p class="bewertung b{0}">{1} Bewertung: <strong>{2}</strong></p>'.format(i, w, "{}") for i, w in ((1, "Unsere"), (2, "Eure Ø-")))
PAGES = [
    (_page(rating=OURS.format("6/10") + YOURS.format("9/10"), facts="Northlight<br>VÖ: 3.11.2019", body='<h2>Tides</h2><p class="autor">(Ada Quill)</p><p>Wide <i>open</i> songs.</p><p> </p><p>Then rain.</p>'),
     {"artist": "Kestrel Row", "album": "Salt Maps", "text": "Wide open songs.\n\nThen rain.", "title": "Tides", "author": "Ada Quill", "rating": 6.0, "user_rating": 9.0, "release_date": date(2019, 11, 3), "release_year": 2019, "labels": ["Northlight"]}),
    ("<body><p>nothing of the kind</p></body>", None),
    (_page(head="Salt Maps"), None),
    (_page(head=" - Salt Maps"), None),
    ('<div id="rezension"><div class="headerbox"><p>no name</p></div><div id="rezitext"><p>words</p></div></div>', None),
    (_page(body='<p class="autor">(Ada Quill)</p><p>  </p>'), None),
    (_page(facts="Pine / Pine West, Harbour ;; Ltd"), {"labels": ["Pine", "Pine West", "Harbour", "Ltd"], "release_year": None, "total_duration": None, "tracks": [], "refs": [], "title": None, "author": None}),
    (_page(facts="Pine<br>since 1987"), {"release_year": 1987, "release_date": None}),
    (_page(facts="Pine<br>31.02.1999<br>x 12.5.2001"), {"release_year": 2001, "release_date": date(2001, 5, 12)}),
    (_page(facts="Pine<br>30.02.1999"), {"release_year": 1999, "release_date": None}),
    (_page(rating=OURS.format("6,5/10") + YOURS.format("none")), {"rating": 6.5, "user_rating": None}),
    (_page(head="A - B - C", more='<div id="reziref"><a>Owl Court</a>, <a>OWL COURT</a>, <b><a>Fen</a></b></div>'), {"artist": "A", "album": "B - C", "refs": ["Owl Court", "Fen"]}),
    (_page(more='<div id="rezihighlights"><ul><li>low tide</li><li></li></ul></div><div id="rezitracklist"><p>Gesamtspielzeit: 38:12 min</p><ul><li>1<ol><li>Low Tide</li><li>Ebb <i>again</i></li></ol></li><li><ol><li>Coda</li></ol></li></ul></div>'),
     {"total_duration": "38:12", "highlights": ["low tide"], "tracks": [(1, "Low Tide", True), (2, "Ebb again", False), (3, "Coda", False)]}),
    (_page(more='<div id="rezitracklist"><ol><li>Only one<li>And two</ol></div>'), {"tracks": [(1, "Only one", False), (2, "And two", False)]}),
    ("", None),
    (None, None),
]


def test_review_pages(spark):
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAGES)], "page_id long, html string")
    got = {r["page_id"]: r for r in pages.parse_reviews(rows).collect()}
    for i, (_, wanted) in enumerate(PAGES):
        assert (i in got) == (wanted is not None), i
        for field, value in (wanted or {}).items():
            found = got[i][field]
            assert ([tuple(t) for t in found] if field == "tracks" else found) == value, (i, field)


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def _run(query):
    query.processAllAvailable()
    query.stop()


def test_new_files_are_written_once(spark, tmp_path):
    source, sink, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    spark.range(5).write.json(source)
    for more in (0, 3):
        if more:
            spark.range(5, 5 + more).write.mode("append").json(source)
        for _ in range(2):
            rows = ingest.unseen(spark.readStream.schema("id long").json(source), spark.createDataFrame([(1,)], "id long"), "id")
            ingest.write_new_files(rows, sink, marks).awaitTermination()
        assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == [i for i in range(5 + more) if i != 1]


def test_once_per_key(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate([[("a", 1), ("b", 2)], [("a", 3), ("c", 4)]]):
        _write(folder / f"{i}.json", "\n".join(json.dumps({"k": k, "at": f"2024-01-01T00:0{m}:00Z"}) for k, m in rows))
        os.utime(folder / f"{i}.json", (i, i))
    kept = ingest.once_per_key(_stream(spark, folder, "k string, at timestamp"), "k", "at")
    _run(kept.writeStream.format("memory").queryName("once").outputMode("append").start())
    assert sorted(r["k"] for r in spark.table("once").collect()) == ["a", "b", "c"]


def test_batches_are_registered_once(spark, tmp_path):
    folder, path, marks = tmp_path / "in", str(tmp_path / "batches"), str(tmp_path / "marks")
    folder.mkdir()
    for i, ids in enumerate([[1, 2], [2, 1, 1], [3]]):
        _write(folder / f"{i}.json", "\n".join(json.dumps({"id": x}) for x in ids))
        os.utime(folder / f"{i}.json", (i, i))  # files are read by their times
    for _ in range(2):
        _run(ingest.register_batches(_stream(spark, folder, "id long"), path, marks, "id"))
    assert sorted(sorted(r["review_ids"]) for r in versions.read(spark, path).collect()) == [[1, 2], [3]]
    ingest.register_batch(spark.createDataFrame([(4,)], "id long"), 2, path, "id")  # a batch of this number again
    ingest.register_batch(spark.createDataFrame([(3,)], "id long"), 3, path, "id")  # the same ids again
    ingest.register_batch(spark.createDataFrame([(None,)], "id long"), 4, path, "id")
    assert versions.read(spark, path).count() == 2 and versions.read(spark, path).columns == ["run_at", "review_ids"]


def test_kept_until_the_files_change(spark, tmp_path):
    from groovemill.sources import cache

    folder, built = str(tmp_path / "files"), []

    def build():
        built.append(1)
        return spark.read.parquet(folder)

    spark.range(3).write.parquet(folder)
    assert [cache.kept(spark, "all", folder, build).count() for _ in range(2)] == [3, 3] and len(built) == 1
    spark.range(2).write.mode("append").parquet(folder)
    assert cache.kept(spark, "all", folder, build).count() == 5 and len(built) == 2


def test_kept_results_of_ended_applications_go(spark, tmp_path, monkeypatch):
    from groovemill.sources import cache

    folder = str(tmp_path / "files")
    spark.range(3).write.parquet(folder)
    monkeypatch.setitem(cache._KEPT, ("ended", "all", folder), (cache.signature(spark, folder), None))
    assert cache.kept(spark, "all", folder, lambda: spark.read.parquet(folder)).count() == 3
    monkeypatch.setattr(cache, "MOST", 2)
    for name in ("b", "c"):
        cache.kept(spark, name, folder, lambda: spark.range(1))
    assert [k[1] for k in cache._KEPT] == ["b", "c"] and all(k[0] != "ended" for k in cache._KEPT)


def test_bounds_of_requests():
    from groovemill.operators import recommend

    assert recommend.clamped((2500, 1996), 1990, 2020) == (1996, 2020) and recommend.clamped((None, "x"), 1990, 2020) == (1990, 2020)
    assert recommend.clamped((99, 4), 0.0, 10.0, float) == (4.0, 10.0) and recommend.clamped(None, 1, 2) == (1, 2)
    for bad in ({"limit": 0}, {"limit": 101}, {"rounds": 21}, {"target": 0}, {"exponent": 6}, {"offset": -1}):
        with pytest.raises(ValueError):
            recommend.checked_request(**bad)


@pytest.mark.parametrize("table", ["reviews", "metadata", "affinities", "communities"])
def test_sample_corpus_is_the_same_in_any_partitions(spark, table):
    plain = sorted(r for i in range(1, 31) for r in sample_corpus.rows_of(table, i))
    for partitions in (1, 3, 100):
        df = sample_corpus.read(spark, table, 30, partitions)
        assert sorted(tuple(list(v) if isinstance(v, list) else v for v in r) for r in df.collect()) == plain
        assert df.rdd.getNumPartitions() == min(partitions, 30)
    assert sample_corpus.read(spark, table, 0).count() == 0


def test_sample_corpus_makes_only_what_is_asked_for(spark):
    df = sample_corpus.read(spark, "reviews", 10**12, 5)  # would never end
    assert sorted(r["id"] for r in df.where("id > 10 AND id <= 13 AND artist <> ''").collect()) == [11, 12, 13]
    assert sorted(r["id"] for r in df.where("id IN (5, 999999999999, -1)").where("id >= 6").collect()) == [999999999999]
    assert df.where("id = 7").count() == 1 and df.where("id < 1").count() == 0
    assert [r["id"] for r in sample_corpus.newest(df.where("id <= 40"), 2).collect()] == [40, 39]
    with pytest.raises(Exception, match="table"):
        sample_corpus.read(spark, "other").count()
