"""The operators over whole tables, as the driver runs them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_format, lang_id, media, mixing, ngram_join, pii, quality, secrets, toxicity
from .common import read

#: Name of the public vocabulary file that texts are encoded with.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.render(read(spark, sf_dir, "conversations"))


def op2_bpe_encoding_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.code_round_trip(read(spark, sf_dir, "documents"), vocabulary_path())


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(read(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.predict(read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_chat_formatting, op2_bpe_encoding_decoding, op3_media_columns, op4_ngram_jaccard_join, op5_language_id, op6_quality_rules, op7_secret_scans, op8_toxicity, op9_source_mixing, op10_pii)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": CHAT_SQL, "op6_quality_rules": quality_sql(), "op9_source_mixing": MIXING_SQL}


def quality_sql() -> str:
    """Counts, cutoffs by exact binomial sums, and verdicts, with the rules' constants filled in."""
    badness = {"symbols": "n_symbols / greatest(word_chars, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)", "word_length": "word_chars / greatest(n_words, 1)"}
    levels = {r: " + ".join(f"CAST({badness[r]} >= CAST({c} AS DOUBLE) AS INTEGER)" for c in cuts) for r, cuts in quality.RULES.items()}
    rules = len(quality.RULES)
    return QUALITY_SQL.format(
        levels=", ".join(f"{v} AS level_{r}" for r, v in levels.items()),
        tested=" UNION ALL ".join(f"SELECT stratum, '{r}' AS rule, unnest(range(1, {len(cuts) + 1})) AS level, list(level_{r}) AS seen FROM good GROUP BY stratum" for r, cuts in quality.RULES.items()),
        rejected=" OR ".join(f"level_{r} >= coalesce((SELECT level FROM chosen c WHERE c.rule = '{r}' AND c.stratum IS NOT DISTINCT FROM v.stratum), 99)" for r in quality.RULES),
        p=quality.ALPHA / rules, delta=quality.DELTA, rules=rules, least=quality.MIN_WORDS, percent=quality.REPEAT_PERCENT, symbols=quality.SYMBOLS,
    )


QUALITY_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), g AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
m AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS times FROM g) WHERE times > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM m, (VALUES (0), (1), (2)) o(k) GROUP BY rid),
n AS (
  SELECT doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^{symbols}]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN r USING (rid)
), v AS (SELECT *, n_words < {least} OR 100 * n_repeat_words > {percent} * n_words AS base_failed, {levels} FROM n),
q AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
good AS (SELECT v.* FROM v JOIN q USING (doc_id) WHERE NOT base_failed),
tested AS ({tested}),
k AS (SELECT stratum, rule, level, len(seen) AS n, len(list_filter(seen, lambda x: x >= level)) AS k FROM tested),
b AS (
  SELECT *, CASE WHEN k >= n * {p} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
    lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))) END AS tail
  FROM k
), h AS (
  SELECT *, min(CAST(tail <= {delta} / ({rules} * (SELECT count(*) FROM (SELECT DISTINCT stratum FROM good))) AS INTEGER)) OVER (PARTITION BY stratum, rule ORDER BY level DESC) AS holds FROM b
), chosen AS (SELECT stratum, rule, min(level) AS level FROM h WHERE holds = 1 GROUP BY stratum, rule)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({rejected}) AS kept
FROM v
"""


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1) // 1024 AS BIGINT) AS part
  FROM conversations
), s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
r AS (
  SELECT t.conv_id, perspective, part, turn, role, text,
    '<|im_start|>' || CASE WHEN role = 'system' THEN role WHEN role = perspective THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), p AS (
  SELECT *, coalesce(sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start,
    row_number() OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, text) AS rn
  FROM r
)
SELECT conv_id, perspective, part, count(*) AS n_turns,
  string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY rn) AS text,
  coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(text) + 10 AS BIGINT), ',' ORDER BY rn) FILTER (WHERE role = perspective), '') AS mask
FROM p GROUP BY conv_id, perspective, part
"""

MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(concat_ws('|', '17', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(source, ''), md5(coalesce(text, '')))), 1, 13) AS BIGINT) / 4503599627370496.0 AS draw
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM s),
f AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS full_at FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM f
), t AS (
  SELECT source, source_size, least(coalesce(x.level * weight, cap), cap) AS target
  FROM l, (SELECT min_by(level, full_at) FILTER (WHERE level <= full_at) AS level FROM l) x
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.draw, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
  CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM r
"""
