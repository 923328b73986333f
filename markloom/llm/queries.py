"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, html_text, langid, licenses, media, neardup, packing, pii, quality, warc
from .common import table


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_round_trip(table(spark, sf_dir, "documents"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_minhash_near_dedup, op3_html_extraction, op4_quality_rules, op5_warc, op6_pii, op7_language_id, op8_packing, op9_media_chunks, op10_bpe_round_trip)}

def _quality_sql() -> str:
    """The counts, the rules of ``quality.RULES`` and the verdict, as SQL."""
    ratios = {
        "mean_word_chars": "word_chars / nullif(n_words, 0)",
        "symbol_ratio": "n_symbols / nullif(n_words, 0)",
        "shout_ratio": "len(list_filter(w, lambda x: regexp_matches(x, '[!?][!?]$'))) / nullif(n_words, 0)",
        "letter_word_ratio": "len(list_filter(w, lambda x: regexp_matches(x, '\\p{L}'))) / nullif(n_words, 0)",
        "stop_word_ratio": f"len(list_filter(w, lambda x: lower(x) IN ({', '.join(repr(x) for x in dict.fromkeys(quality.STOP_WORDS))}))) / nullif(n_words, 0)",
        "dup_line_ratio": "n_dup_lines / nullif(len(l), 0)",
        "bullet_line_ratio": "len(list_filter(l, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•‣●]'))) / nullif(len(l), 0)",
        "ellipsis_line_ratio": "len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) / nullif(len(l), 0)",
        "longest_word_chars": "coalesce(list_max(list_transform(w, lambda x: length(x))), 0)",
        "n_words": "n_words",
    }
    broken = []
    for r in quality.RULES:
        tests = [f"({ratios[r.measure]}) {op} {bound}" for op, bound in (("<", r.low), (">", r.high)) if bound is not None]
        broken.append(f"CASE WHEN {' OR '.join(tests)} THEN '{r.measure}' END")
    return f"""
    WITH split AS (
        SELECT doc_id, coalesce(text, '') AS t,
            list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
        FROM documents
    ), windows AS (
        SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM split)
    ), again AS (
        SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM windows) WHERE c > 1
    ), covered AS (
        SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, 5) AS r(k) GROUP BY doc_id
    ), counted AS (
        SELECT split.doc_id, w, l, cast(len(w) AS BIGINT) AS n_words, cast(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
            cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
            cast(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, cast(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
        FROM split LEFT JOIN covered ON split.doc_id = covered.doc_id
    ), judged AS (
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
            concat_ws(',', {', '.join(broken)}) AS broken_rules
        FROM counted
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND broken_rules = '' AS kept, broken_rules
    FROM judged"""


_WARC_SQL = f"""
    WITH payloads AS (SELECT page_id, cast(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    kept AS (SELECT payload_digest, max(page_id) AS page FROM payloads WHERE payload_bytes >= {warc.DEDUP} GROUP BY 1)
    SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN page <> page_id THEN page END AS refers_to
    FROM payloads p LEFT JOIN kept ON p.payload_digest = kept.payload_digest"""

#: The tables' pages have one template and few character references, so SQL can cut out their articles.
_HTML_SQL = r"""
    WITH cut AS (
        SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS a FROM pages
    ), bare AS (
        SELECT page_id, url, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(a, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'),
            '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&middot;', '·'), '&amp;', '&') AS a FROM cut
    ), text AS (
        SELECT page_id, url, trim(regexp_replace(a, '\s+', ' ', 'g')) AS text FROM bare
    ) SELECT *, cast(length(text) AS BIGINT) AS n_chars FROM text"""

ORACLES: dict[str, str] = {"op3_html_extraction": _HTML_SQL, "op4_quality_rules": _quality_sql(), "op5_warc": _WARC_SQL}
