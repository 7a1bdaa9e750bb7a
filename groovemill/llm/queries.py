"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, fim, html_text, language, license_scan, media, merkle, near_dup, packing, ppm, quality_rules, token_counts, token_files

RANKS = "byte_bpe_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of each document. A null or empty text has no words, no places and score 0; rows that repeat stay; no rows give no rows."""
    return license_scan.summarise(license_scan.scan(_documents(spark, sf_dir)))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the bytes that they decode to. A null or empty text has no ids; rows that repeat stay; no rows give no rows."""
    return byte_bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of each document. A null or empty text has zero counts and fails; rows that repeat stay; no rows give no rows."""
    return quality_rules.judge(_documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document. A null text or one without letters is ``und`` with score 0; equal costs go to the language that sorts first; a null doc_id is held out; rows that repeat stay; no rows give no rows."""
    return language.predict_languages(_documents(spark, sf_dir))


def op5_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each document. A null or empty text has just its end; a null doc_id is held out; rows that repeat stay and count as often; no rows give no rows."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return ppm.score(_documents(spark, sf_dir), fold != 1)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each length in tokens that occurs, read as a context limit. A null or empty text has length 0; rows that repeat count as often; no rows give no rows."""
    lengths = token_counts.encoded_lengths(_documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return token_counts.length_histogram(lengths)


def op7_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document. Texts without words have fingerprint 0 and are one component; a null doc_id names no component; rows that repeat stay; no rows give no rows."""
    return near_dup.near_duplicates(_documents(spark, sf_dir))


def op8_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's PNG file and of what is read back. A null or empty text has 64 zero bytes; equal texts have equal files; rows that repeat stay; no rows give no rows."""
    return media.digests(media.read_media(media.store_media(_documents(spark, sf_dir))))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document lies in the files of ids, read back from them. A null or empty text has just the end id; a null doc_id stands first; rows of one doc_id go by their texts; no rows give no rows."""
    return token_files.write_and_read(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 1)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each piece of each document. A null or empty text is one piece of the end id; rows that repeat are packed as often; equal lengths go by task and place; no rows give no rows."""
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page. Null or empty html has an empty text; rows that repeat stay; no rows give no rows."""
    return html_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and proof of each document. Nulls are encoded as such; a null doc_id stands first and isn't tampered with; rows that repeat are leaves of their own; no rows give no rows."""
    docs = _documents(spark, sf_dir)
    return merkle.digests(merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form of each document and digests of its output and of what is rebuilt from it. A null or empty text is plain; a null doc_id counts as an empty number; rows that repeat stay; no rows give no rows."""
    return fim.digests(fim.transform(_documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_byte_bpe, op3_quality_rules, op4_language_id, op5_ppm_score, op6_token_counts, op7_simhash_near_dup, op8_png_media, op9_token_files, op10_best_fit_packing, op11_html_text, op12_merkle_manifest, op13_fill_in_middle)
}


def _quality_sql() -> str:
    ratios = {"mean_word_chars": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "stop_word_ratio": ("n_stop_words", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "mean_line_words": ("n_words", "n_lines")}
    tests = []
    for rule in quality_rules.RULES:
        part, whole = ratios[rule.feature]
        value = f"CASE WHEN {whole} > 0 THEN {part}::DOUBLE / {whole} ELSE 0 END"
        tests += [f"{value} {sign} {bound}::DOUBLE" for sign, bound in ((">=", rule.least), ("<=", rule.most)) if bound is not None]
    stop = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, doc_id, t, [x FOR x IN regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS words,
                 [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM d),
    g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM w, unnest(range(1, len(words) - 1)) AS u(i)),
    c AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g),
    v AS (SELECT r, count(DISTINCT i + k) AS n FROM c, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY r),
    q AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
                 (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
                 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                 len([x FOR x IN words IF x IN ({stop})])::BIGINT AS n_stop_words, coalesce(v.n, 0)::BIGINT AS n_repeat_words
          FROM w LEFT JOIN v USING (r)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q)
    SELECT *, NOT base_failed AND {" AND ".join(tests)} AS kept FROM b
    """


#: Levels of SQL's tree; SQL_LEVELS levels hold 8 to that power of documents.
SQL_LEVELS = 7


def _merkle_sql() -> str:
    """Each level is a query of its own: nodes ``u``, and on the way down proofs ``p`` as lists of (left, right)."""
    fields = lambda text: " || ".join(f"coalesce(octet_length(encode({x}))::VARCHAR || ':' || {x}, '-')" for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))
    # DuckDB has no crc32: eight steps of a bit for each byte of the decimal number
    crc = f"xor(list_reduce([4294967295::BIGINT] || [ord(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')], lambda c, x: list_reduce([xor(c, x)] || range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)), 4294967295)"
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    parts = [
        f"""d AS (SELECT doc_id, lang, sha256({fields("text")}) AS h, CASE WHEN coalesce({crc} % 3 = 0, false) THEN sha256({fields(f"translate(text, '{capitals}', '{capitals.lower()}')")}) END AS other FROM documents),
    u0 AS (SELECT *, coalesce('=' || lang, '-') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d)"""
    ]

    def ups(u: str) -> None:
        for k in range(SQL_LEVELS):
            parts.append(f"{u}{k + 1} AS (SELECT g, i // 8 AS i, (n + 7) // 8 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h, list(h ORDER BY i) AS c FROM {u}{k} WHERE n > 1 GROUP BY g, i // 8, (n + 7) // 8)")

    ups("u")
    parts.append("v0 AS (SELECT '' AS g, g AS lang_key, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM (" + " UNION ALL ".join(f"SELECT g, h FROM u{k} WHERE n = 1" for k in range(SQL_LEVELS + 1)) + "))")
    ups("v")
    parts.append("w AS (SELECT g, {'root': h, 'subroot': ''} AS t, []::STRUCT(l VARCHAR, r VARCHAR)[] AS p FROM (" + " UNION ALL ".join(f"SELECT g, h FROM v{k} WHERE n = 1" for k in range(SQL_LEVELS + 1)) + "))")

    def downs(u: str, p: str, base: str) -> None:
        parts.append(f"{p}{SQL_LEVELS} AS (SELECT u.*, b.t, b.p FROM {u}{SQL_LEVELS} u JOIN {base} b USING (g) WHERE n = 1)")
        for k in range(SQL_LEVELS - 1, -1, -1):
            above = f"[{{'l': coalesce(array_to_string(a.c[1 : u.i % 8], ''), ''), 'r': coalesce(array_to_string(a.c[u.i % 8 + 2 :], ''), '')}}] || a.p"
            parts.append(f"{p}{k} AS (SELECT u.*, b.t, b.p FROM {u}{k} u JOIN {base} b USING (g) WHERE n = 1 UNION ALL SELECT u.*, a.t, {above} FROM {u}{k} u JOIN {p}{k + 1} a ON u.g = a.g AND u.i // 8 = a.i WHERE u.n > 1)")

    downs("v", "q", "w")
    parts.append("b AS (SELECT lang_key AS g, {'root': t.root, 'subroot': h} AS t, p FROM q0)")
    downs("u", "p", "b")
    parts.append("f AS (SELECT doc_id, h AS leaf, t.subroot AS subroot, t.root AS root, sha256(coalesce(array_to_string([x.l || x.r FOR x IN p], ''), '')) AS proof_sha256, list_reduce([{'l': coalesce(other, h), 'r': ''}] || p, lambda a, x: {'l': sha256(x.l || a.l || x.r), 'r': ''}).l AS folded_root FROM p0)")
    return "WITH " + ",\n    ".join(parts) + "\n    SELECT *, folded_root = root AS verified FROM f"


def _fill_sql() -> str:
    h = [f"('0x' || substr(x, {8 * i + 1}, 8))::BIGINT" for i in range(4)]
    joined = lambda a, b: f"coalesce(array_to_string(u[{a} + 1 : {b}], ''), '')"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
    e AS (SELECT doc_id, t, {", ".join(f"{v} AS h{i + 1}" for i, v in enumerate(h))}, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM d),
    f AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM e),
    g AS (SELECT *, {joined("0", "a")} AS p, {joined("a", "b")} AS m, {joined("b", "n")} AS s FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
    FROM g
    """


ORACLE_SQL: dict[str, str] = {"op3_quality_rules": _quality_sql(), "op12_merkle_manifest": _merkle_sql(), "op13_fill_in_middle": _fill_sql()}
