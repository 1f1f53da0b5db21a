"""One query for each training-data operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, compression_classifier, embedding_dedup, lexical_search, license_scan, mixing, quality, sharding, simhash, suffix_dedup, token_alignment, url_cascade

#: The rules of the URL query, in the form verdict, host and path.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary() -> tuple[bytes, str]:
    """Ranks and pre-token pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark, _read(spark, sf_dir, "embeddings"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(spark, _read(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_cascade.parse_rule(*r) for r in URL_RULES]
    return url_cascade.filter_urls(spark, _read(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(spark, _read(spark, sf_dir, "documents"), *vocabulary())


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(spark, _read(spark, sf_dir, "conversations"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(spark, _read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(spark, _read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(spark, _read(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(spark, _read(spark, sf_dir, "documents"))


def tokenizers() -> token_alignment.Tokenizers:
    """The two public tokenizers that are aligned."""
    import public_tokenizers

    read = lambda name: bpe.read_ranks(public_tokenizers.path(name))
    return token_alignment.Tokenizers(read("byte_bpe_50k.json"), public_tokenizers.PATTERN, read("piece_bpe_32k.model"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(spark, _read(spark, sf_dir, "documents"), tokenizers())


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_classifier.classify(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_simhash_dedup, op3_url_filter, op4_bpe, op5_chat_format, op6_quality_rules, op7_license_scan, op8_sharding, op9_mixing, op10_suffix_dedup, op11_token_alignment, op12_lexical_search, op13_quality_classifier)}
_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_STOP_WORDS = ", ".join(f"'{w}'" for w in sorted({w for words in quality.STOP_WORDS.values() for w in words.split()}))
_RULES = ", ".join("('{}', '{}', '{}')".format(r.verdict, r.host, r.path) for r in (url_cascade.parse_rule(*x) for x in URL_RULES))

#: SQL for DuckDB; the other operators hash, sort suffixes or solve knapsacks and are tested
#: against brute force instead.
ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": rf"""
        WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_LETTERS}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
        m AS (SELECT page_id, r.verdict, r.host || r.path AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
              FROM h JOIN (VALUES {_RULES}) r(verdict, host, path) ON (h.host = r.host OR suffix(h.host, '.' || r.host)) AND starts_with(h.path, r.path))
        SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m ON m.page_id = h.page_id AND m.place = 1""",
    "op6_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
        win AS (SELECT doc_id, i, w[i:i + 7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
        rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
        cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, range(8) r(j) WHERE c > 1 GROUP BY doc_id),
        m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
                len(l) AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_dots,
                len(w) < {quality.STOP_WORD_TEXT} OR len(list_filter(w, lambda x: translate(regexp_replace(x, '[.,;:!?]+$', ''), {_LETTERS}) IN ({_STOP_WORDS}))) > 0 AS prose
              FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id),
        b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 40 AND n_symbols / n_words <= 0.5 AND n_dup_lines / n_lines <= 0.7 AND n_dots / n_lines <= 0.9 AND prose AS kept FROM b""",
    "op12_lexical_search": rf"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY ALL),
        s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM n),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // l)))) AS BIGINT) AS score
              FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), s GROUP BY ALL)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 50""",
}
