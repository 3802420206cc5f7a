"""Queries of the corpus operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftscan.llm import byte_bpe, chat, conversation_repair, exact_dedup, importance, lattice, minhash, packing, quality, sharding, token_counts, token_files, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_on_labels(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model, threshold=0.3)
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        F.col("toxic_predicted").alias("predicted"),
        F.size("toxic_passages").cast("long").alias("n_passages"),
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op4_lattice_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lattice_near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op5_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(_table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = chat.format_chat(_table(spark, sf_dir, "conversations"))
    digest = F.crc32(F.encode("formatted", "UTF-8")).alias("formatted_crc32")
    return messages.select("conv_id", "turn", "role", "n_quotes", "n_linked", "source_conv", "source_turn", "parent_turn", "thread", "depth", F.length("body").cast("long").alias("body_chars"), digest)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.cost_balanced_packing(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=1024)


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(_table(spark, sf_dir, "documents"), shards=40)


def op10_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_cascade(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damaged_and_repaired(_table(spark, sf_dir, "conversations"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000, percent=10, least_words=20, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


_QUERIES = (
    op1_token_counts,
    op2_toxicity,
    op3_token_files,
    op4_lattice_near_duplicates,
    op5_minhash_near_duplicates,
    op6_chat_format,
    op7_byte_bpe,
    op8_packing,
    op9_hilbert_shards,
    op10_quality_cascade,
    op11_conversation_repair,
    op12_exact_dedup,
    op13_importance_resampling,
)

#: Links between all pairs of a label by cosine in double precision, and their components.
LATTICE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98
), reach(id, least) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.id
), component AS (
  SELECT id, min(least) AS component_id FROM reach GROUP BY id
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN component ON id = v.vec_id LEFT JOIN counts ON a = v.vec_id
"""

#: Exact Jaccard of 2-word shingle sets over pairs that share a shingle, and components.
MINHASH_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+1], ' ') AS g FROM w, unnest(range(1, greatest(len(w), 2))) AS t(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), half AS (
  SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * n_shared >= 80 * (p.n + q.n - n_shared)
), links AS (
  SELECT a, b FROM half UNION ALL SELECT b, a FROM half
), reach(id, least) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.id
), component AS (
  SELECT id, min(least) AS component_id FROM reach GROUP BY id
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN component ON id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_lattice_near_duplicates": LATTICE_SQL, "op5_minhash_near_duplicates": MINHASH_SQL, "op10_quality_cascade": quality.QUALITY_SQL, "op12_exact_dedup": exact_dedup.EXACT_SQL}
