"""The queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .bpe import token_digests
from .common import table
from .exact import duplicate_groups
from .innerproducts import top_products
from .langid import predict_languages
from .lines import drop_boilerplate
from .media import document_media
from .minhash import near_duplicates
from .mixing import mix_blocks
from .negatives import hard_negatives
from .phrases import mine_phrases
from .repair import read_documents, write_shards
from .sharding import shard_documents
from .substring import substring_dedup

#: Target weights of the sources; any other source has weight 1.
TARGETS = {f"src{i}": 1 + i % 4 for i in range(20)}


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), k=20).drop("is_copy")


def op2_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"), keep="max")


def op4_bpe_tree(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("word_bpe_49k.json")) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), path)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "n_lines", "n_dropped", F.sha2(F.concat_ws("\n", "kept"), 256).alias("kept_sha256"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80).drop("node", "root", "th")


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_blocks(table(spark, sf_dir, "documents"), TARGETS)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op10_repair_tokens(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_50k.json")) -> DataFrame:
    return read_documents(write_shards(table(spark, sf_dir, "documents"), path, end_id=2))


def op11_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), modulus=50, k=5)


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), modulus=100, label=label)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_media_sequences, op3_exact_dedup, op4_bpe_tree, op5_line_dedup, op6_minhash_near_dedup, op7_pfair_mixing, op8_language_id, op9_virtual_slots, op10_repair_tokens, op11_top_products, op12_phrase_mining, op13_hard_negatives)}

ORACLES = {
    "op1_substring_dedup": r"""
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(list_slice(ws, p, p + 19), ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM docs WHERE len(ws) >= 20)
), again AS (
  SELECT doc_id, p FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1
), gone AS (
  SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT doc_id, unnest(range(p, p + 20)) AS q FROM again) GROUP BY doc_id
), cut AS (
  SELECT doc_id, ws, coalesce(qs, []) AS qs FROM docs LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, len(ws) AS n_words, len(qs) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(qs, i)), ' '), '')) AS kept_sha256
FROM cut
""",
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op6_minhash_near_dedup": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS ws
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS s
  FROM docs
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents
  UNION
  SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), comp AS (
  SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u
)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN comp USING (doc_id)
""",
    "op5_line_dedup": sql.LINES,
    "op7_pfair_mixing": sql.MIXING,
    "op9_virtual_slots": sql.SHARDS,
    "op11_top_products": sql.TOP_PRODUCTS,
    "op12_phrase_mining": sql.PHRASES,
    "op13_hard_negatives": sql.NEGATIVES,
}
