"""The registered queries of this subpackage: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplane, chat, decontamination, html_crf, jaccard, packing, quality, resharding, token_counts, url_filter
from .common import shared_dir, store, table

SQL: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies; a parameter of the operators, read on executors too."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-ids")
    bitplane.write_ids(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return bitplane.documents_of(bitplane.read_ids(spark, path))


def op2_crf_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = resharding.lay_out(docs, 16, F.coalesce(F.octet_length("text"), F.lit(0)) + 8)
    new, _ = resharding.reshard(old, 24)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return new.slots().select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), payload=False)


# The rules of op 3.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, RULES))


SQL["op3_url_rules"] = """
WITH rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
parts AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts)
SELECT s.page_id, s.host, s.path, max_by(r.h || r.p, length(r.h || r.p)) AS rule,
  coalesce(max_by(r.verdict, length(r.h || r.p)), 'allow') AS verdict
FROM split s LEFT JOIN rules r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p)
GROUP BY s.page_id, s.host, s.path
"""


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    ours = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.read_back(store(chat.format_windows(turns.unionByName(ours)), "chat-windows"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.rate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL["op8_quality_rules"] = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM base),
windows AS (SELECT doc_id, unnest(range(0, len(w) - 4)) AS i, w FROM split WHERE len(w) >= 5),
named AS (SELECT doc_id, i, w[i+1:i+5] AS g FROM windows),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM named) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2, i+3, i+4]) AS p FROM again) GROUP BY doc_id),
measured AS (SELECT s.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
  coalesce(c.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^!]+', '', 'g')) AS shouts,
  len(list_filter(w, lambda x: x IN ({", ".join(repr(y) for x in quality.STOP_WORDS for y in (x, x.capitalize()))}))) AS stop,
  len(list_filter(w, lambda x: regexp_full_match(x, '[^\\p{{Ll}}]*\\p{{Lu}}[^\\p{{Ll}}]*\\p{{Lu}}[^\\p{{Ll}}]*'))) AS upper_words
  FROM split s LEFT JOIN covered c USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.1 AND shouts / n_words <= 0.1
  AND upper_words / n_words <= 0.5 AND (n_words < 40 OR stop / n_words >= 0.03) AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.5) AS kept
FROM judged
"""

def op9_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bitplane_ids, op2_crf_extraction, op3_url_rules, op4_flow_resharding, op5_token_counts, op6_mixture_packing, op7_chat_windows, op8_quality_rules, op9_template_leaks, op10_ngram_jaccard)}
