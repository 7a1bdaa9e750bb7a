"""Operators 1, 3, 4, 5, 7 and 8 and the pipeline against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
import regex
import xxhash
from groovemill.llm import language, license_scan, media, near_dup, ppm, quality_rules, queries
from tests.comparison import connect, spark_rows, sql_rows
from tests.llm.conftest import SCHEMA, fold
from tests.llm.test_near_copies import alike_components

SPACE = "\x20\x09-\x0d"


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


# operator 1


def _license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def test_licences_by_a_plain_search(spark, sf_dir, rows):
    got = {r["doc_id"]: r for r in queries.op1_license_scan(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        words, found = _license_words(text), []
        for notice in license_scan.BASE:
            phrase = notice.words.split()
            found += [(i, notice.label) for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
        r = got[doc_id]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(found), ",".join(sorted({x for _, x in found})))
        assert (r["first_word"], r["last_word"]) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_seeds_lose_no_fuzzy_match(rows):
    planted = " it is releasd under the mitt license and the gnu genral publc license or mozila public licens ok released under a mit license "
    texts = [planted] + [f" {' '.join(_license_words(t))} " for _, t in rows[:60]]
    for text in texts:
        spans = license_scan.find_spans(text)
        for notice in license_scan.FUZZY:
            whole = regex.compile(rf"(?e)(?<![^ ])(?:{notice.words}){{e<={notice.errors}}}(?![^ ])")
            found = any(s["label"] == notice.label and not s["base"] for s in spans)
            assert found or not whole.search(text)
    assert {s["label"] for s in license_scan.find_spans(planted)} == {"mit", "gpl", "mpl"}


def test_spans_name_the_words():
    text = " 中 it is releasd under the mitt license x gnu genral publc license y mit license "
    words = text.split()
    found = {(s["label"], s["base"]): " ".join(words[s["first"] : s["last"] + 1]) for s in license_scan.find_spans(text)}
    assert found == {("mit", True): "mit license", ("mit", False): "releasd under the mitt license", ("gpl", False): "gnu genral publc license"}


def test_licences_of_odd_rows(clashing, none):
    got = {r["doc_id"]: r for r in license_scan.summarise(license_scan.scan(clashing)).collect()}
    assert license_scan.scan(clashing).count() == clashing.count() and license_scan.scan(none).count() == 0
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["labels"], got[1]["score"]) == (0, 0, None, "", 0.0)
    assert (got[5]["n_base"], got[5]["first_word"], got[5]["last_word"], got[5]["base_labels"], got[5]["score"]) == (2, 3, 8, "mit", 1.0)


# operator 3


def test_quality_query_gives_the_rows_of_its_sql(spark, sf_dir):
    assert spark_rows(queries.op3_quality_rules(spark, sf_dir)) == sql_rows(connect(sf_dir), queries.ORACLE_SQL["op3_quality_rules"])


def _quality(text):
    words = re.findall(f"[^{SPACE}]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(f"[^{SPACE}]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_of_odd_rows(clashing, none):
    for r in quality_rules.judge(clashing.where("doc_id IS NULL OR doc_id <> 7")).collect():
        text = next(x["text"] for x in clashing.collect() if x["doc_id"] == r["doc_id"]) or ""
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == _quality(text)
        assert r["base_failed"] and not r["kept"]
    long = quality_rules.judge(clashing.where("doc_id = 7")).first()
    assert long["n_words"] == 80_000 and long["n_repeat_words"] == 80_000 and long["base_failed"]
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep_good(clashing).columns == clashing.columns


def test_quality_keeps_good_documents(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    good = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").select("doc_id")
    judged = queries.op3_quality_rules(spark, folder)
    assert judged.where("kept").join(good, "doc_id").count() >= 0.9 * good.count()


# operator 4


def test_languages_of_held_out_documents(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    truth = spark.read.parquet(f"{folder}/documents.parquet").where("lang IS NOT NULL").select("doc_id", "lang")
    got = queries.op4_language_id(spark, folder).join(truth, "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    assert len(got) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (fold(r["doc_id"]) == 0) for r in got)


def test_languages_of_odd_rows(clashing, none):
    own = clashing.drop("held_out", "score", "rejected", "lang_pred")
    got = {r["doc_id"]: r for r in language.predict_languages(clashing).collect()}
    assert len(got) == 11 and own.count() == language.predict_languages(clashing).count()
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (1, 2, 3))
    assert language.predict_languages(none).count() == 0
    assert language.keep_identified(clashing).columns == clashing.columns and language.keep_identified(none).count() == 0


def test_kneser_ney_adds_up_to_one():
    counts = Counter()
    for word in "banana bandana ananas nab".split():
        framed = language.START * 3 + word + language.END
        counts.update(framed[i : i + 4] for i in range(len(word) + 1))
    last = sorted({g[-1] for g in counts})
    model = language.kneser_ney(counts, len(last))
    for head in {g[:-1] for g in counts}:
        total = 0.0
        for c in last:
            codes = np.array([ord(x) for x in head + c], np.uint64)
            hashes = [language._hashes(codes, n)[-1:] for n in range(1, 5)]
            before = np.array([ord(x) for x in head], np.uint64)
            contexts = [np.zeros(1, np.uint64)] + [language._hashes(before, n)[-1:] for n in range(1, 4)]
            total += model.probability(hashes, contexts)[0]
        assert total == pytest.approx(1.0)


def _plain_kneser_ney(texts):
    """A function from a framed word's context and character to its probability, by interpolated counts of characters 4 to 1."""
    grams = Counter()
    for t in texts:
        for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
            framed = language.START * 3 + w + language.END
            grams.update(framed[i : i + 4] for i in range(len(w) + 1))
    levels = [grams]
    for n in (3, 2, 1):
        kinds = defaultdict(set)
        for g in levels[-1]:
            kinds[g[1:]].add(g[0])
        levels.append(Counter({g: len(k) for g, k in kinds.items()}))
    return levels


def _plain_entropy(levels, alphabet, text):
    total, n = 0.0, 0
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    discounts = []
    for level in levels:
        once, twice = (sum(c == k for c in level.values()) for k in (1, 2))
        discounts.append(once / (once + 2 * twice) if once else 0.5)
    followers = [defaultdict(dict) for _ in levels]
    for level, table in zip(levels, followers, strict=True):
        for g, c in level.items():
            table[g[:-1]][g[-1]] = c
    for w in words:
        framed = language.START * 3 + w + language.END
        for i in range(3, len(framed)):
            p = 1 / alphabet
            for k in (3, 2, 1, 0):  # shortest contexts first
                seen = followers[k].get(framed[i - (3 - k) : i], {})
                if seen:
                    size = sum(seen.values())
                    p = max(seen.get(framed[i], 0) - discounts[k], 0) / size + discounts[k] * len(seen) / size * p
            total -= math.log(p)
            n += 1
    return total / n if n else 0.0


def test_languages_by_a_plain_kneser_ney(spark):
    words = {"de": "der hund und die katze laufen über straßen schnell", "en": "the dog and a cat are running over streets quickly", "es": "el perro y la gata corren por calles muy rápido"}
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(words[lang].split(), rng.integers(3, 12))), lang) for i, lang in enumerate(["de", "en", "es"] * 60)]
    rows += [(1000 + i, t, None) for i, t in enumerate(["der hund", "the cat runs", "gata muy y calles", "1 2", "Straßen, CATS", "zzz"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.predict_languages(df).collect()}
    learnt = language.train(df.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    held = {r["doc_id"] for r in df.where("xxhash64(doc_id, 'calibration') % 5 = 0").collect()}
    own = {x: [t for i, t, lang in rows if lang == x and fold(i) != 0 and i not in held] for x in words}
    models = {x: _plain_kneser_ney(t) for x, t in own.items()}
    alphabet = len({g[-1] for m in models.values() for g in m[0]}) + 1
    memo = learnt.memo()
    for i, t, _ in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        entropy, chars = learnt.entropies(data, np.array([0, len(data)]), memo)
        plain = [_plain_entropy(models[x], alphabet, t) for x in learnt.languages]
        assert entropy[0].tolist() == pytest.approx(plain, rel=1e-9)
        assert got[i]["lang_pred"] == (learnt.languages[int(np.argmin(plain))] if chars[0] else "und")


def test_equal_entropies_go_to_the_first_language(spark):
    rows = [(i, "gleich und same", lang) for i, lang in enumerate(["xx", "aa"] * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    same = language.Identifier(["aa", "xx"], [language.kneser_ney({"\x02\x02\x02a": 2, "\x02\x02a\x03": 1}, 9)] * 2)
    assert {r["lang_pred"] for r in language.identify(df, same).collect()} == {"aa"}


# operator 5


def _plain_ppm(training, text):
    """log10 probability by method C with exclusion, orders 3 to 0."""
    counts = defaultdict(Counter)
    for t in training:
        framed = bytes([ppm.BEFORE] * 3) + t.encode() + bytes([ppm.AFTER])
        for i in range(3, len(framed)):
            for order in range(4):
                counts[order, framed[i - order : i]][framed[i]] += 1
    # below order 2 every training byte counts, so the tables follow from the longer ones
    framed, total = bytes([ppm.BEFORE] * 3) + text.encode() + bytes([ppm.AFTER]), 0.0
    for i in range(3, len(framed)):
        excluded, p, done = set(), 1.0, False
        for order in (3, 2, 1, 0):
            here = counts.get((order, framed[i - order : i]), Counter())
            left = {b: n for b, n in here.items() if b not in excluded}
            if not left:
                continue
            size = sum(left.values()) + len(left)
            if framed[i] in left:
                p *= left[framed[i]] / size
                done = True
                break
            p *= len(left) / size
            excluded |= set(here)
        if not done:
            p /= max(1, 256 - len(counts.get((0, b""), ())))
        total += math.log10(p)
    return total


def test_scores_by_a_plain_trie(spark, sf_dir, rows):
    some = [(i, t) for i, t in rows if len(t) < 3000][:40] + [(10**9, ""), (10**9 + 1, "Zzé\n"), (10**9 + 2, "the THE the")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in some], SCHEMA)
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r for r in ppm.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1).collect()}
    training = [t for i, t in some if fold(i) != 1]
    words = lambda t: re.findall(f"[^{SPACE}]+", ascii_lower(t))
    counts = Counter(w for t in training for w in words(t))
    n, v, ends = sum(counts.values()) + len(training), len(counts) + 1, len(training)
    assert len(got) == len(some)
    for doc_id, text in some:
        r, cs = got[doc_id], [*(counts[w] for w in words(text)), ends]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(doc_id) == 1, len(cs), sum(c > 0 for c in cs), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in cs), rel=1e-9)
        assert r["score"] == pytest.approx(_plain_ppm(training, text), rel=1e-9)


def test_scores_of_odd_rows(clashing, none):
    from pyspark.sql import functions as F

    got = ppm.score(clashing, F.col("doc_id") % 2 == 0).collect()
    assert len(got) == clashing.count() and ppm.score(none, F.lit(True)).count() == 0
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert all(r["score"] < 0 and math.isfinite(r["base_score"]) for r in got)
    assert ppm.score(clashing, F.lit(None).cast("boolean")).count() == clashing.count()


def test_a_row_repeated_ten_thousand_times_is_dealt_over_all_blocks(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 10_000, 1, 4).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same words").alias("text"))
    rows = rows.unionByName(spark.range(100, 140).select(F.col("id").alias("doc_id"), F.concat(F.lit("others "), F.col("id").cast("string")).alias("text")))
    sizes = [r["count"] for r in ppm.dealt(rows, 64).groupBy("block").count().collect()]
    assert sum(sizes) == 10_040 and len(sizes) == 64 and max(sizes) < 300
    got = ppm.score(rows, F.col("doc_id") != 100).collect()
    repeated = [r for r in got if r["doc_id"] == 7]
    assert len(got) == 10_040 and len(repeated) == 10_000
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in repeated} == {(4, 4, 10_000 * 4 + 39 * 3)}
    assert len({round(r["score"], 9) for r in repeated}) == 1


# operator 7


def _fingerprint(text):
    words = re.findall(f"[^{SPACE}]+", ascii_lower(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints):
    label = {i: i for i, _ in prints}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, (i, a) in enumerate(prints):
        for j, b in prints[:k]:
            if (a ^ b).bit_count() <= 4:
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in prints}


def test_near_duplicates_by_all_pairs(spark, sf_dir, rows):
    prints = [(i, _fingerprint(t)) for i, t in rows]
    wanted = _components(prints)
    got = queries.op7_simhash_near_dup(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((i, f"{p:016x}", wanted[i]) for i, p in prints)


@pytest.mark.parametrize(("n", "hot"), [(60, 1 << 15), (3000, 1 << 15), (3000, 40)])
def test_trees_find_all_links(spark, monkeypatch, n, hot):
    for name, value in (("HOT", hot), ("SHARE", 1), ("AT_ONCE", 500)):  # many cells and small tables
        monkeypatch.setattr(near_dup, name, value)
    rng = np.random.default_rng(n)
    seeds = rng.integers(0, 2**63, n // 6, dtype=np.int64)
    values = seeds[rng.integers(0, len(seeds), n)]
    for _ in range(5):
        values = np.where(rng.random(n) < 0.5, values ^ (np.int64(1) << rng.integers(0, 62, n)), values)
    values = np.unique(values)
    prints = [(i, int(v)) for i, v in enumerate(values.tolist())]
    wanted = _components(prints)
    found = near_dup.components(near_dup.links(spark.createDataFrame(prints, "id long, fp long"), len(prints))).collect()
    got = {i: i for i, _ in prints} | {r["id"]: r["component"] for r in found}
    assert got == wanted


def test_groups_stay_whole_whatever_the_batches():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    key = np.sort(rng.integers(0, 40, 700))
    batches = [pa.record_batch({"key": key[i : i + 13], "at": np.arange(i, min(i + 13, 700))}) for i in range(0, 700, 13)]
    old, near_dup.AT_ONCE = near_dup.AT_ONCE, 50
    try:
        tables = list(near_dup.whole_groups(iter(batches), ("key",)))
    finally:
        near_dup.AT_ONCE = old
    assert len(tables) > 5 and np.concatenate([t.column("at").to_numpy() for t in tables]).tolist() == list(range(700))
    seen = [set(t.column("key").to_pylist()) for t in tables]
    assert sum(map(len, seen)) == len(set(key.tolist()))
    assert all((np.unique(t.column("key").to_numpy(), return_inverse=True)[1] == t.column("group").to_numpy()).all() for t in tables)
    assert list(near_dup.whole_groups(iter([]), ("key",))) == []


def test_near_duplicates_of_odd_rows(clashing, none):
    got = near_dup.near_duplicates(clashing).collect()
    assert len(got) == clashing.count() and near_dup.near_duplicates(none).count() == 0
    by_id = {r["doc_id"]: r for r in got}
    assert {by_id[i]["component_id"] for i in (1, 2, 3)} == {1} and by_id[1]["fingerprint"] == "0" * 16
    kept = near_dup.keep_one(clashing)
    assert kept.columns == clashing.columns and kept.where("doc_id IN (2, 3)").count() == 0 and kept.where("doc_id = 4").count() == 2


# operator 8


def test_media_are_read_back(spark, sf_dir, rows):
    got = {r["doc_id"]: r for r in queries.op8_png_media(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        body = text.encode()
        payload = body + bytes(max(1, -(-len(body) // 64)) * 64 - len(body))
        r = got[doc_id]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    by_text = defaultdict(set)
    for doc_id, text in rows:
        by_text[text].add((got[doc_id]["media_sha256"], got[doc_id]["feature"]))
    assert all(len(x) == 1 for x in by_text.values())


def test_all_filters_are_undone():
    rng = np.random.default_rng(3)
    samples = rng.integers(0, 256, (25, 9)).astype(np.uint8)
    kinds = [0, 1, 2, 3, 4, 3, 3, 3, 4, 4, 4, 2, 2, 1, 4, 0, 3, 4, 2, 4, 4, 4, 4, 4, 3]
    above, lines = [0] * 9, []
    for y, line in enumerate(samples.tolist()):
        kind, out = kinds[y], []
        for x, value in enumerate(line):
            a, b, c = (line[x - 1] if x else 0), above[x], (above[x - 1] if x else 0)
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((value - (0, a, b, (a + b) // 2, nearest)[kind]) % 256)
        lines.append(bytes([kind, *out]))
        above = line
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    packed = zlib.compress(b"".join(lines))
    png = media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 25, 8, 0, 0, 0, 0)) + chunk(b"IDAT", packed[:20]) + chunk(b"IDAT", packed[20:]) + chunk(b"IEND", b"")
    assert (media.decode_png(png) == samples).all()
    with pytest.raises(ValueError):
        media.decode_png(png[:60] + bytes([png[60] ^ 1]) + png[61:])
    assert (media.decode_png(media.encode_png(samples)) == samples).all()


@pytest.mark.parametrize("shape", [(64, 64), (3, 64), (100, 64)])
def test_feature_by_plain_loops(shape):
    x = np.random.default_rng(sum(shape)).integers(97, 123, shape).astype(np.uint8)

    def ranges(length):
        edges = [i * length // 32 for i in range(33)]
        return [range(a, max(b, a + 1)) for a, b in zip(edges, edges[1:], strict=False)]

    rows, columns = ranges(shape[0]), ranges(shape[1])
    means = [[sum(int(x[i, j]) for i in r for j in c) / len(r) / len(c) for c in columns] for r in rows]
    waves = []
    for u in range(8):
        for v in range(8):
            waves.append(round(sum(means[i][j] * math.cos(math.pi * u * (2 * i + 1) / 64) * math.cos(math.pi * v * (2 * j + 1) / 64) for i in range(32) for j in range(32)), 6))
    middle = sum(sorted(waves)[31:33]) / 2
    bits = "".join("1" if w > middle else "0" for w in waves)
    assert media.low_frequencies(x) == int(bits, 2).to_bytes(8, "big")


def test_feature_of_slight_changes():
    x = np.random.default_rng(4).integers(97, 123, (64, 64)).astype(np.uint8)  # all frequencies have some share
    y = x.copy()
    y[5, 5] ^= 3
    a, b = (int.from_bytes(media.low_frequencies(v), "big") for v in (x, y))
    assert (a ^ b).bit_count() <= 4


def test_media_of_odd_rows(clashing, none):
    got = media.digests(media.read_media(media.store_media(clashing))).collect()
    assert len(got) == clashing.count() and {r["payload_bytes"] for r in got if r["doc_id"] in (1, 2)} == {64}
    assert media.digests(media.read_media(media.store_media(none))).count() == 0


# the pipeline


def test_pipeline_stages_by_plain_versions(spark, sf_dir, docs, rows):
    stage = dict(corpus_pipeline.STAGES)
    own = docs.columns
    good = stage["quality_rules"](spark, docs, sf_dir)
    verdicts = {r["doc_id"]: r["kept"] for r in queries.op3_quality_rules(spark, sf_dir).collect()}
    assert good.columns == own and {r["doc_id"] for r in good.collect()} == {i for i, k in verdicts.items() if k}
    known = stage["language_id"](spark, good, sf_dir)
    assert known.columns == own and known.count() >= 0.95 * good.count()
    text = dict(rows)
    wanted = alike_components([(r["doc_id"], text[r["doc_id"]]) for r in known.collect()])
    one = stage["simhash_near_dup"](spark, known, sf_dir)
    assert one.columns == own and sorted(r["doc_id"] for r in one.collect()) == sorted(set(wanted.values()))
    packed = stage["best_fit_packing"](spark, one, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == set(wanted.values())
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()
