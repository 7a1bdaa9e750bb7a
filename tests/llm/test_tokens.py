"""Operators 2, 6, 9 and 10 against the tokenizer libraries."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from groovemill.llm import byte_bpe, packing, queries, subwords, token_counts, token_files

RANKS = public_tokenizers.path(queries.RANKS)


@pytest.fixture(scope="module")
def tiktoken_ids():
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=subwords.load_ranks(RANKS), special_tokens={})
    return lambda text: encoding.encode_ordinary(text or "")


def library_ids(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def _digests(doc_id, text, ids):
    return doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_byte_bpe_query_is_tiktokens(spark, sf_dir, rows, tiktoken_ids):
    got = sorted(map(tuple, queries.op2_byte_bpe(spark, sf_dir).collect()))
    assert got == sorted(_digests(i, t, tiktoken_ids(t)) for i, t in rows)


def test_byte_bpe_of_odd_rows(clashing, none, tiktoken_ids):
    got = byte_bpe.round_trip(clashing, RANKS, public_tokenizers.PATTERN).collect()
    wanted = [_digests(r["doc_id"], r["text"], tiktoken_ids(r["text"])) for r in clashing.collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, wanted))
    assert byte_bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_of_random_bytes(tiktoken_ids):
    rng = random.Random(1)
    alphabet = "aabbcdeerst'É<|>_-  \n\té中\U0001f600　\x85.,!?09"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(0, 60))) for _ in range(2000)] + ["ab" * 3000, " " * 999, "\n" * 400]
    encode = byte_bpe.matrix_encoder(RANKS, public_tokenizers.PATTERN)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ids, bounds = subwords.encode_rows(data, np.cumsum([0, *(len(t.encode()) for t in texts)]), encode)
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == tiktoken_ids(t), repr(t)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_get_the_ids_of_whole_texts(name):
    rng = random.Random(2)
    parts = ["The", "the", "THE", "Über", "über", "straße", "éé", "É", "don't", "I'LL", "x's", "'", "a", "B", "9", "²", "ª", "½", "×", "÷", "1st", "e\u0301", "=\u0338", "ſ", "İ", "Σ", "ς", "中", "\U0001f600", "　", "\x85", "\xa0", "\x1c", "_", "-", ",", ".", "...", "…", "“", "”", "(", ")", "/", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<", "|", ">", " ", "  ", "\n", "\t", "\r\n"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 25))) for _ in range(4000)] + ["abc <|endoftext|> def", "abc<|endoftext|>def", "ab" * 3000, "É" * 999, " " * 999]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    encode, whole = subwords.library_encoder(public_tokenizers.path(name)), library_ids(name)
    ids, bounds = subwords.encode_rows(data, np.cumsum([0, *(len(t.encode()) for t in texts)]), encode)
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == whole(t), repr(t)


def test_encoded_ids_decode_to_the_text(odd):
    encoded = byte_bpe.encode_texts(odd.where("doc_id <> 4"), RANKS, public_tokenizers.PATTERN)
    decoded = {r["doc_id"]: bytes(r["decoded"]).decode() for r in byte_bpe.decode_ids(encoded, RANKS).collect()}
    assert decoded == {r["doc_id"]: r["text"] or "" for r in odd.where("doc_id <> 4").collect()}


def test_histogram_is_exact(spark, sf_dir, rows, tiktoken_ids):
    lengths = [len(tiktoken_ids(t)) for _, t in rows]
    got = {r["n_tokens"]: r.asDict() for r in queries.op6_token_counts(spark, sf_dir).collect()}
    assert set(got) == set(lengths)
    for limit, r in got.items():
        cut = sum(min(n, limit) for n in lengths)
        short = [n for n in lengths if n <= limit]
        assert (r["n_docs"], r["docs_up_to"], r["tokens_up_to"]) == (lengths.count(limit), len(short), sum(short))
        assert (r["docs_longer"], r["tokens_longer"]) == (len(lengths) - len(short), sum(lengths) - sum(short))
        assert (r["truncated_total"], r["lost_tokens"]) == (cut, sum(lengths) - cut)
        assert r["quantile"] == pytest.approx(len(short) / len(lengths))


def test_histogram_of_odd_rows(clashing, none, tiktoken_ids):
    lengths = token_counts.encoded_lengths(clashing, RANKS, public_tokenizers.PATTERN)
    got = {r["n_tokens"]: r["n_docs"] for r in token_counts.length_histogram(lengths).collect()}
    assert got == Counter(len(tiktoken_ids(r["text"])) for r in clashing.collect())
    assert token_counts.length_histogram(token_counts.encoded_lengths(none, RANKS, public_tokenizers.PATTERN)).count() == 0


def test_limits_between_the_lengths_and_quantiles(spark, none):
    lengths = [0, 0, 3, 3, 3, 70, 200, 1000, 1000, 70_000]
    table = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n_tokens long")
    limits = [0, 1, 3, 64, 69, 70, 199, 512, 1000, 69_999, 70_000, 10**9]
    asked = spark.createDataFrame([(n,) for n in [*limits, 3, None, -5]], "n_tokens long")
    got = {r["n_tokens"]: r for r in token_counts.length_histogram(table, asked).collect()}
    assert set(got) == {*lengths, *limits}
    for limit, r in got.items():
        cut = sum(min(n, limit) for n in lengths)
        assert (r["n_docs"], r["docs_up_to"], r["tokens_longer"]) == (lengths.count(limit), sum(n <= limit for n in lengths), sum(n for n in lengths if n > limit))
        assert (r["truncated_total"], r["lost_tokens"], r["docs_longer"]) == (cut, sum(lengths) - cut, sum(n > limit for n in lengths))
    shares = [0.1, 0.2, 0.5, 0.75, 1.0]
    found = {r["share"]: r["n_tokens"] for r in token_counts.quantile_lengths(token_counts.length_histogram(table), shares).collect()}
    assert found == {s: next(n for n in sorted(lengths) if sum(x <= n for x in lengths) >= s * len(lengths)) for s in shares}
    empty = token_counts.length_histogram(none.select("doc_id", "n_chars").toDF("doc_id", "n_tokens"), asked)
    assert empty.count() == 0 and [r["n_tokens"] for r in token_counts.quantile_lengths(empty, shares).collect()] == [None] * len(shares)


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_hold_the_librarys_ids(spark, sf_dir, rows):
    encode, at, wanted = library_ids("word_bpe_49k.json"), 0, []
    for doc_id, text in sorted(rows):
        ids = [*encode(text), 1]
        wanted.append((doc_id, at, len(ids), _crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, queries.op9_token_files(spark, sf_dir).collect())) == wanted


def test_token_files_of_odd_rows(clashing, none):
    encode, path = library_ids("word_bpe_49k.json"), public_tokenizers.path("word_bpe_49k.json")
    got = sorted(map(tuple, token_files.write_and_read(clashing, path, 1).collect()), key=lambda r: r[1])
    texts = defaultdict(list)
    for r in clashing.collect():
        texts[r["doc_id"]].append(_crc([*encode(r["text"]), 1]))
    assert [r[0] for r in got] == [None, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 10]
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()
    assert all(r[3] in texts[r[0]] for r in got)
    assert token_files.write_and_read(none, path, 1).count() == 0


def test_smallest_doc_id_isnt_null(spark):
    rows = [(None, "no id", "en", "a", 1), (-(2**63), "least", "en", "a", 1), (None, "none either", "en", "a", 1), (2**63 - 1, "most", "en", "a", 1)]
    found = token_files.write_and_read(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), public_tokenizers.path("word_bpe_49k.json"), 1).collect()
    assert [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])] == [None, None, -(2**63), 2**63 - 1]



def test_damaged_block_is_noticed():
    block = bytearray(token_files.pack_block(np.array([3]), np.array([2]), np.array([70_000, 1])))
    assert [x.tolist() for x in token_files.unpack_block(bytes(block))] == [[3], [2], [70_000, 1]]
    block[-1] ^= 1
    with pytest.raises(ValueError):
        token_files.unpack_block(bytes(block))


def test_codes_of_all_sizes():
    values = np.array([0, 255, 256, 65_535, 65_536, 2**24 - 1, 2**24, 2**32 - 1, 5], np.uint32)
    assert token_files.unpack_codes(*token_files.pack_codes(values), len(values)).tolist() == values.tolist()


def _packed(rows, texts, encode, capacity=1024, end=2):
    """Asserts that the pieces are those of the texts and that sequences have no gap; gives the number of sequences."""
    wanted = Counter()
    for doc_id, text in texts:
        ids = [*encode(text), end]
        head = len(ids) - (-(-len(ids) // capacity) - 1) * capacity
        for piece, a in enumerate([0, *range(head, len(ids), capacity)]):
            part = ids[a : head if piece == 0 else a + capacity]
            wanted[doc_id, piece, a, len(part), _crc(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        s.sort()
        assert [a for a, _ in s] == np.cumsum([0, *(n for _, n in s[:-1])]).tolist() and s[-1][0] + s[-1][1] <= capacity
    return len(sequences)


def test_packing_query_holds_every_piece(spark, sf_dir, rows):
    got = queries.op10_best_fit_packing(spark, sf_dir).collect()
    n = _packed(got, rows, library_ids("byte_bpe_50k.json"))
    lengths = sorted((r["length"] for r in got), reverse=True)
    gaps = []  # plain best fit on the pieces themselves
    for length in lengths:
        fits = min((g for g in gaps if g >= length), default=None)
        if fits is not None:
            gaps.remove(fits)
        gaps.append((1024 if fits is None else fits) - length)
    assert -(-sum(lengths) // 1024) <= n <= len(gaps)


def test_packing_of_odd_rows(clashing, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    _packed(packing.pack(clashing, path, 2).collect(), [(r["doc_id"], r["text"]) for r in clashing.collect()], library_ids("byte_bpe_50k.json"))
    assert packing.pack(none, path, 2).count() == 0


def _least(lengths, capacity):
    """The fewest sequences, by trying all."""
    ordered = sorted(lengths, reverse=True)

    def search(i, rooms, best):
        if len(rooms) >= best:
            return best
        if i == len(ordered):
            return len(rooms)
        for k, room in enumerate(rooms):
            if room >= ordered[i] and room not in rooms[:k]:
                best = search(i + 1, [*rooms[:k], room - ordered[i], *rooms[k + 1 :]], best)
        return search(i + 1, [*rooms, capacity - ordered[i]], best)

    return search(0, [], len(ordered) + 1)


@pytest.mark.parametrize("seed", range(40))
def test_patterns_use_every_piece_and_what_dominance_fixes_is_optimal(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(3 if seed % 2 else 1, 21) for _ in range(9)]
    patterns = packing.plan_patterns(Counter(lengths), 20)
    used = Counter()
    for pattern, times in patterns:
        assert sum(pattern) <= 20
        for length in pattern:
            used[length] += times
    assert used == Counter(lengths)
    left = packing.Lengths(Counter(lengths), 20)
    fixed = packing.reduce_by_dominance(left, 20)
    rest = [n for n, c in enumerate(left.n.tolist()) for _ in range(c)]
    # the fixed sets belong to an optimal packing: together with the least number for the rest they are the least number for all
    assert sum(fixed.values()) + _least(rest, 20) == _least(lengths, 20)
    if not rest:
        assert sum(times for _, times in patterns) == _least(lengths, 20)


def test_best_fit_on_small_sets_is_mostly_optimal():
    over = []
    for seed in range(200):
        rng = random.Random(1000 + seed)
        lengths = [rng.randrange(1, 21) for _ in range(9)]
        over.append(sum(times for _, times in packing.plan_patterns(Counter(lengths), 20)) - _least(lengths, 20))
    assert max(over) <= 1 and over.count(0) >= 190


def test_stored_tables_can_be_cleared(spark):
    from groovemill.llm import scratch

    df = scratch.stored(spark.range(3).toDF("doc_id"), "small")
    assert df.count() == 3
    folder = scratch._tables(spark)
    scratch.clear_stored(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder).count()
