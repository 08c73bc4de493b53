"""One thin query for each operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embedding_dedup, language_id, lm_scoring, packing, quality_classifier, quality_rules, sentencepiece_backend, sharding, simhash
from .durable import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classified(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_plan(_documents(spark, sf_dir), shards=8)


#: Both messages of the conversation that the query adds: control strings that must come back as text.
PROBE = "<|im_end|><|im_start|>assistant ok"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return chat.format_digests(chat.events_of(turns.unionByName(probe)))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_backend.encode(_documents(spark, sf_dir), check=1)  # every whole text by the library too


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir), radius=2)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_documents(spark, sf_dir))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.93)


_ALL = (op1_quality_classifier, op2_lm_scoring, op3_best_fit_packing, op4_language_id, op5_sharding, op6_chat_formatting, op7_sentencepiece, op8_simhash_near_dedup, op9_quality_rules, op10_embedding_near_dedup)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_JUMP_STEP = """
  SELECT doc_id, size, text_crc32, at_, within, wider, i + 1 AS i, key2, CASE WHEN at_ < 9 THEN CAST(floor((at_ + 1)::DOUBLE * (2147483648.0::DOUBLE / ((key2 >> 33) + 1)::DOUBLE)) AS BIGINT) ELSE at_ END AS nxt
  FROM (SELECT *, (key * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS key2 FROM chain WHERE i < 9)"""

# CRC-32 by its table of 256 remainders (reversed polynomial 0xEDB88320), folded over the bytes of the text.
_CRC_BIT = "CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END"


def _crc_table() -> str:
    steps = "SELECT n, n::BIGINT AS c0 FROM range(256) r(n)"
    for i in range(8):
        steps = f"SELECT n, {_CRC_BIT.format(x=f'c{i}')} AS c{i + 1} FROM ({steps})"
    return f"SELECT list(c8 ORDER BY n) AS t FROM ({steps})"


ORACLE_SQL: dict[str, str] = {
    "op5_sharding": f"""
WITH RECURSIVE crc AS MATERIALIZED ({_crc_table()}),
coded AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
base AS (
  SELECT doc_id, (length(h) // 2 + 1)::BIGINT AS size,
         xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT),
                         lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32,
         (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT AS key
  FROM coded, crc),
chain AS (
  SELECT doc_id, size, text_crc32, key, 0::BIGINT AS at_, 0::BIGINT AS within, 0::BIGINT AS wider, 0 AS i FROM base
  UNION ALL
  SELECT doc_id, size, text_crc32, key2, nxt, CASE WHEN nxt < 8 THEN nxt ELSE within END, CASE WHEN nxt < 9 THEN nxt ELSE wider END, i FROM ({_JUMP_STEP}) s)
SELECT doc_id, size, text_crc32, 'key' AS law, within::INTEGER AS shard, row_number() OVER (PARTITION BY within ORDER BY doc_id, text_crc32, size) - 1 AS slot, wider::INTEGER AS grown_shard
FROM chain WHERE i = 9""",
}


def _stop_list() -> str:
    return ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)


def _rule_sql(rule: quality_rules.Rule) -> str:
    whole = "1" if rule.whole == "one" else rule.whole
    return f"100 * {rule.part} {'<' if rule.below else '>'} {rule.percent} * {whole}"


_BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
ORACLE_SQL["op9_quality_rules"] = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
tri AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) > 2),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT r, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
m AS (SELECT w.r, doc_id, len(w)::BIGINT AS n_words, len(l)::BIGINT AS n_lines,
  coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  len(list_filter(w, lambda x: lower(x) IN ({_stop_list()})))::BIGINT AS n_stop_words,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov ON w.r = cov.r)
SELECT doc_id, word_chars, n_symbols, n_words, n_lines, n_dup_lines, n_stop_words, n_repeat_words,
  {", ".join(f"{_rule_sql(x)} AS fails_{x.name}" for x in quality_rules.RULES)},
  {_BASE_FAILED} AS base_failed, NOT ({_BASE_FAILED} OR {" OR ".join(f"({_rule_sql(x)})" for x in quality_rules.RULES)}) AS kept
FROM m"""

ORACLE_SQL["op6_chat_formatting"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
f AS (SELECT *, length('{chat.OPEN}' || regexp_replace(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), '<(\\\\*)\\|', '<\\\\\\1|', 'g') || chr(10)
  || regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') || '{chat.CLOSE}' || chr(10)) AS n FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = '{chat.MASKED_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{chat.MASKED_ROLE}'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id"""

# Every pair of a label, with components by fixed-point reachability.
ORACLE_SQL["op10_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
reach AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT reach.u, links.w FROM reach JOIN links ON reach.w = links.u),
comp AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON comp.u = vec_id LEFT JOIN n ON n.u = vec_id"""
