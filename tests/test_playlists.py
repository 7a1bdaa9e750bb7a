"""Playlists, photos and recommendations against plain versions."""

from __future__ import annotations

import zlib
from collections import defaultdict

import pytest

from groovemill.functions.text import track_key
from groovemill.operators import playlist, recommend, scoring, taste
from groovemill.plans import album_queries, taste_queries


def _shuffled(values, seed):
    return [v for _, _, v in sorted(((i * 2654435761 + seed) % 1000003, i, v) for i, v in enumerate(values))]


def _plain_fill(albums, tracks, target, seed):
    """albums: (review_id, place, quota, cap); tracks: review_id -> [(key, title, source, number)]. Slot after slot, over plain lists."""
    albums = sorted(albums, key=lambda a: a[1])
    order = lambda t: (t[2] != "highlight", zlib.crc32(f"{t[0]}:{seed}".encode()), t[0], t[3])
    slots = _shuffled([i for i, a in enumerate(albums) for _ in range(min(a[2], a[3]))], seed)
    used, taken, picks, tries = set(), [0] * len(albums), [], 0

    def pick(i):
        if taken[i] >= albums[i][3]:
            return None
        free = [t for t in sorted(tracks[albums[i][0]], key=order) if t[0] not in used]
        return free[0] if free else None

    for slot in slots:
        if tries >= 20 * target:
            break
        tries += 1
        at, track = slot, pick(slot)
        if track is None:
            at = next((j % len(albums) for j in range(slot + 1, slot + len(albums)) if pick(j % len(albums))), None)
            if at is None:
                continue
            tries += 1
            track = pick(at)
        used.add(track[0])
        taken[at] += 1
        picks.append((albums[at][0], track[1], track[2]))
    return picks


def test_playlist_fill_by_a_plain_version(spark, sf_dir):
    t = album_queries.Tables(spark, sf_dir)
    slots = playlist.stratified_slots(playlist.amplify(album_queries._pool(t), album_queries.EXPONENT), album_queries.TARGET)
    pool = playlist.graduated_caps(slots, "balanced").select("review_id", "artist", "place", "quota", "cap").collect()
    found = playlist.track_candidates(t.tracks()).join(t.reviews().select("review_id", "artist"), "review_id")
    tracks = defaultdict(list)
    for r in found.select("review_id", "number", "title", "source", track_key(album_queries.F.col("artist"), album_queries.F.col("title")).alias("key")).collect():
        tracks[r["review_id"]].append((r["key"], r["title"], r["source"], r["number"]))
    wanted = _plain_fill([(r["review_id"], r["place"], r["quota"], r["cap"]) for r in pool], tracks, album_queries.TARGET, album_queries.SEED)
    got = sorted(map(tuple, album_queries.playlist_fill(spark, sf_dir).collect()))
    assert [r[1:] for r in got] == wanted and [r[0] for r in got] == list(range(1, len(got) + 1)) and len(got) > 5


def test_playlist_fill_passes_slots_on(spark):
    albums = [(i, f"artist{i}", i, 3, 2) for i in range(4)]
    candidates = [(0, 1, "same", "highlight"), (1, 1, "a", "fallback"), (1, 2, "b", "highlight"), (1, 3, "c", "fallback"), (3, 1, "d", "fallback")]
    pool = spark.createDataFrame(albums, "review_id long, artist string, place long, quota long, cap long")
    got = playlist.fill_playlist(pool, spark.createDataFrame(candidates, "review_id long, number long, title string, source string"), 10, 3).collect()
    tracks = defaultdict(list)
    for i, n, title, source in candidates:
        tracks[i].append((f"artist{i}::{title}", title, source, n))
    assert [(r["review_id"], r["title"], r["source"]) for r in sorted(got)] == _plain_fill([(a[0], a[2], a[3], a[4]) for a in albums], tracks, 10, 3)
    with pytest.raises(ValueError):
        playlist.fill_playlist(pool, spark.createDataFrame(candidates, "review_id long, number long, title string, source string"), 101)


def test_fill_asks_again_when_albums_close(spark, monkeypatch):
    """Many albums have the same track, so that one pick closes all of them; slots pass on over them and past the end."""
    albums = [(i, f"artist{i // 6 if i < 24 else i}", i, 4 if i in (3, 27) else 0, 4 if i == 3 else 1) for i in range(30)]
    titles = {3: ["x", "y"], 27: ["a", "b"], 28: ["c"], 29: []}
    candidates = [(i, n, t, "fallback" if n % 2 else "highlight") for i, *_ in albums for n, t in enumerate(titles.get(i, ["same"] if i < 24 else [f"t{i}"]))]
    pool = spark.createDataFrame(albums, "review_id long, artist string, place long, quota long, cap long")
    df = spark.createDataFrame(candidates, "review_id long, number long, title string, source string")
    tracks = defaultdict(list)
    for i, n, title, source in candidates:
        tracks[i].append((f"{albums[i][1]}::{title}", title, source, n))
    small, once = playlist._Shelf.__init__, playlist._Shelf
    for seed in range(3):
        wanted = _plain_fill([(a[0], a[2], a[3], a[4]) for a in albums], tracks, 20, seed)
        for at_once in (20, 2):
            monkeypatch.setattr(once, "__init__", lambda self, ranked, n, at_once=at_once: small(self, ranked, at_once))
            assert [(r["review_id"], r["title"], r["source"]) for r in sorted(playlist.fill_playlist(pool, df, 20, seed).collect())] == wanted
    with pytest.raises(ValueError):
        playlist.fill_playlist(pool.selectExpr("review_id", "artist", "place", "3000L AS quota", "3000L AS cap"), df, 20)


def test_pool_of_a_request(spark):
    rows = spark.range(50).selectExpr("id AS review_id", "id % 7 / 7D AS overall_score", "0.5D AS score")
    every = [r["review_id"] for r in recommend.archive_pool(rows).orderBy("place").collect()]
    assert every == [i for _, i in sorted(((-(i % 7), -i) for i in range(50)))] or every == sorted(range(50), key=lambda i: (-(i % 7), -i))
    assert [r["review_id"] for r in recommend.archive_pool(rows, 9).orderBy("place").collect()] == every[:9]
    for bad in (0, 20_001):
        with pytest.raises(ValueError):
            recommend.archive_pool(rows, bad)


def test_draws_of_weights_that_are_all_zero(spark):
    pool = spark.range(6).selectExpr("id + 4000000000000 AS review_id", "0D AS weight")
    got = playlist.weighted_sample(pool, 9, 5).collect()
    assert sorted(r["nth"] for r in got) == list(range(1, 10))
    assert len({r["review_id"] for r in got if r["nth"] <= 6}) == 6 and all(r["draw"] is None for r in got if r["nth"] > 6)


def _plain_photos(rows):
    rows = {r["rank"]: r for r in rows}
    shown, claimed = [], set()
    slots = [[1, 2, 3, 4, 5]] + [[a, a + 1, a - 2, a + 2, a + 3] for a in range(6, max(rows) + 1, 6)]
    for slot in slots:
        for rank in slot:
            r = rows.get(rank)
            if r is None or rank in shown or not r["has_photo"]:
                continue
            keys = {k for k in (r["mbid"], r["artist"] and "name:" + r["artist"].lower()) if k}
            if keys and not keys & claimed:
                shown.append(rank)
                claimed |= keys
                break
    return set(shown)


def test_photo_ranks_by_a_plain_version(spark, sf_dir, monkeypatch):
    kept = {}
    monkeypatch.setattr(taste_queries.taste, "photo_ranks", lambda rows: kept.setdefault("rows", rows))
    rows = taste_queries.photo_ranks(spark, sf_dir)
    monkeypatch.undo()
    lists = defaultdict(list)
    for r in rows.collect():
        lists[r["list"]].append(r)
    got = defaultdict(set)
    for r in taste.photo_ranks(rows).collect():
        got[r["list"]].add(r["rank"])
    assert len(lists) > 2 and got == {k: _plain_photos(v) for k, v in lists.items()}


def test_no_weight_is_the_default_weight(spark):
    got = {r["community"]: r["weight"] for r in scoring.TasteProfile(weights={"a": None, "b": 2.0, "c": 0.25}).selected(spark).collect()}
    assert got == {"a": 0.5, "b": 1.0, "c": 0.25}


def test_percentiles_of_one_value_and_of_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.75), (4, None)], "review_id long, v double")
    got = {r["review_id"]: r["p"] for r in scoring.with_percentile(df.where("v IS NOT NULL"), "v", scoring.percentile_table(df.where("v IS NOT NULL"), "v", "p")).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 1.0}
    same = df.where("review_id < 3")
    assert {r["p"] for r in scoring.with_percentile(same, "v", scoring.percentile_table(same, "v", "p")).collect()} == {1.0}


def test_label_sets(spark):
    albums = spark.createDataFrame([(1, ["A", " B "]), (2, []), (3, None), (4, ["C"]), (5, [" "])], "review_id long, labels array<string>")
    passed = lambda selected: {r["review_id"] for r in taste.label_set_filter(albums, selected).collect()}
    assert passed(None) == passed(["A", "B", "C"]) == {1, 2, 3, 4, 5}
    assert passed([]) == {2, 3, 5} and passed([" B"]) == {1, 2, 3, 5} and passed(["Z"]) == {2, 3, 5}
    assert {r["review_id"] for r in taste.label_set_filter(albums.where("review_id IN (2, 3)"), ["Z"]).collect()} == {2, 3}


def test_fill_ranks_the_tracks_of_its_slots_alone(spark, tmp_path, monkeypatch):
    path, names, asked, real, of = str(tmp_path / "tracks"), [], [], playlist.stored, playlist._Shelf._of

    def kept(df, name):
        names.append(name)
        return real(df, name)

    def plan(self, places):
        found = of(self, places)
        asked.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(playlist, "stored", kept)
    monkeypatch.setattr(playlist._Shelf, "_of", plan)
    spark.range(200).selectExpr("id DIV 4 AS review_id", "id % 4 + 1 AS number", "concat('t', id) AS title", "id % 3 = 0 AS is_highlight").write.parquet(path)
    albums = [(i, f"artist{i}", i, 2 if i in (7, 30) else 0, 3) for i in range(50)]
    pool = spark.createDataFrame(albums, "review_id long, artist string, place long, quota long, cap long")
    candidates = playlist.track_candidates(spark.read.parquet(path))
    got = [(r["review_id"], r["title"], r["source"]) for r in sorted(playlist.fill_playlist(pool, candidates, 4, 1).collect())]
    tracks = defaultdict(list)
    for r in candidates.collect():
        tracks[r["review_id"]].append((f"artist{r['review_id']}::{r['title']}", r["title"], r["source"], r["number"]))
    assert got == _plain_fill([(a[0], a[2], a[3], a[4]) for a in albums], tracks, 4, 1) and len(got) == 4
    assert "ranked" not in names and len(asked) == 1 and "In(review_id, [30,7])" in asked[0].replace("[7,30]", "[30,7]")
