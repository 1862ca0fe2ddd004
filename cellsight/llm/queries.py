"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from cellsight.llm import decontaminate, embedding_dedup, hyperminhash, mixing, ngram_lm, paragraph_dedup, prefix_trie, quality, suffix_dedup, token_counts, toxicity, warc, whitening
from cellsight.llm.common import table
from cellsight.session import scratch_path

TOKENIZER = "piece_bpe_32k.model"


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked_vectors(table(spark, sf_dir, "embeddings"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_texts(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.pareto_mix(table(spark, sf_dir, "documents"))
    return mixed.selectExpr("_id AS doc_id", "size", "source_size", "target", "taken", "copies", "_source AS source")


def op5_tokens(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    model = token_counts.model_bytes(tokenizer or public_tokenizers.path(TOKENIZER))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), model)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_key")


def op7_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_paragraphs(table(spark, sf_dir, "documents"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents"))


def op9_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.clusters(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.describe(warc.reconstruct(spark, path))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_embeddings": op1_embeddings,
    "op2_language_model": op2_language_model,
    "op3_quality": op3_quality,
    "op4_mix": op4_mix,
    "op5_tokens": op5_tokens,
    "op6_decontaminate": op6_decontaminate,
    "op7_paragraphs": op7_paragraphs,
    "op8_suffixes": op8_suffixes,
    "op9_hyperminhash": op9_hyperminhash,
    "op10_archive": op10_archive,
    "op11_trie": op11_trie,
    "op12_toxicity": op12_toxicity,
    "op13_whitening": op13_whitening,
}

ORACLE = {
    "op4_mix": r"""
WITH sized AS (
  SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || '|mix-1|' || coalesce(source, '-') || '|' || md5(coalesce(text, ''))), 1, 13)) AS BIGINT) + 0.5::DOUBLE)
      / 4503599627370496::DOUBLE AS u
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) AS DOUBLE) * 2 AS cap,
    [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS INT) + 1] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, cap / weight AS ratio,
    (sum(cap) OVER () * 0.75::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM sources WINDOW before AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(cap, weight * coalesce((SELECT min_by(level, ratio) FROM levels WHERE ratio > level), 1e308::DOUBLE)) AS target FROM levels),
rated AS (
  SELECT s.*, source_size, target, coalesce(target / nullif(source_size, 0), 0) AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
drawn AS (
  SELECT rid, source, size, (u / (1 - u)) * (1 - (rate - floor(rate))) / (rate - floor(rate)) AS draw, target - floor(rate) * source_size AS room
  FROM rated WHERE rate - floor(rate) > 0 AND size > 0),
first AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY draw, rid ROWS UNBOUNDED PRECEDING) <= room AS fits FROM drawn),
gap1 AS (
  SELECT source, any_value(room) - sum(CASE WHEN fits THEN size ELSE 0 END) AS gap FROM first GROUP BY source),
second AS (
  SELECT f.rid, f.source, f.size, draw, gap, sum(f.size) OVER (PARTITION BY f.source ORDER BY draw, rid ROWS UNBOUNDED PRECEDING) <= gap AS fits
  FROM first f JOIN gap1 g ON f.source IS NOT DISTINCT FROM g.source WHERE NOT f.fits AND f.size <= gap),
gap2 AS (
  SELECT source, min(gap) AS gap FROM (
    SELECT * FROM gap1 UNION ALL SELECT source, any_value(gap) - sum(CASE WHEN fits THEN size ELSE 0 END) FROM second GROUP BY source) GROUP BY source),
last AS (
  SELECT rid FROM (
    SELECT f.rid, row_number() OVER (PARTITION BY f.source ORDER BY abs(gap - size), draw, f.rid) AS place
    FROM first f JOIN gap2 g ON f.source IS NOT DISTINCT FROM g.source
    WHERE NOT fits AND abs(gap - size) < gap AND f.rid NOT IN (SELECT rid FROM second WHERE fits)) WHERE place = 1),
extra AS (SELECT rid FROM first WHERE fits UNION ALL SELECT rid FROM second WHERE fits UNION ALL SELECT rid FROM last)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies, source FROM (
  SELECT r.*, CASE WHEN size > 0 THEN CAST(floor(rate) AS BIGINT) + CASE WHEN e.rid IS NULL THEN 0 ELSE 1 END ELSE 0 END AS copies
  FROM rated r LEFT JOIN extra e ON r.rid = e.rid)
""",
    "op10_archive": """
WITH paid AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
ranked AS (
  SELECT *, row_number() OVER same AS place, first_value(page_id) OVER same AS newest
  FROM paid WINDOW same AS (PARTITION BY payload ORDER BY page_id DESC NULLS LAST))
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST(('0x' || substr(hex, CAST(k // 4 AS INT) * 5 + 1, 5)) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31 AS INT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN newest END AS refers_to
FROM ranked
""",
    # h: crc32 by shifts, eight for each byte of the decimal id.
    "op11_trie": r"""
WITH given AS (
  SELECT conv_id, turn, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn IS NOT NULL, turn, digest) AS place FROM given),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM given)),
turns AS (
  SELECT c.conv_id, 0 AS part, place, digest, words FROM convs c JOIN placed p ON p.conv_id = c.base AND place <= h
  UNION ALL SELECT c.conv_id, 1, place, digest, words FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND place > h),
whole AS (
  SELECT c.conv_id, coalesce(list(digest ORDER BY part, place) FILTER (digest IS NOT NULL), []) AS ds, coalesce(list(words ORDER BY part, place) FILTER (digest IS NOT NULL), []) AS ws
  FROM convs c LEFT JOIN turns t ON c.conv_id = t.conv_id GROUP BY c.conv_id),
prefixes AS (
  SELECT conv_id, d, array_to_string(ds[1:d], '') AS p, CASE WHEN d > 0 THEN array_to_string(ds[1:d - 1], '') END AS up, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, d = len(ds) AS ending
  FROM (SELECT *, unnest(range(len(ds) + 1)) AS d FROM whole)),
nodes AS (
  SELECT p, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ending), '')) AS ends_sha256
  FROM prefixes GROUP BY p),
kids AS (SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
full_nodes AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.p = k.up),
sums AS (
  SELECT substr(p, 1, 64 * k) AS top, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * w) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS k FROM full_nodes) GROUP BY 1)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON s.top = n.p LEFT JOIN nodes u ON u.p = n.up
""",
}
