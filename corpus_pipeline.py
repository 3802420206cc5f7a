"""From raw documents to packed training sequences, in four stages.

Each stage reads what its predecessor wrote and works on all of it. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftscan.llm import minhash, packing, quality, store, toxicity


def _column(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def _kept(docs: DataFrame, judged: Callable[[DataFrame], DataFrame], verdict: Column) -> DataFrame:
    """The rows of ``docs`` with a verdict, and its columns as they are, whatever columns an operator adds.

    While it runs, all columns but the text have names of their own.
    """
    own = {c: "text" if c == "text" else f"_input_{k}" for k, c in enumerate(docs.columns)}
    renamed = docs.select(*[_column(c).alias(name) for c, name in own.items()])
    return judged(renamed).where(verdict).select(*[F.col(name).alias(c) for c, name in own.items()])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    A null, empty or blank text has too few words and goes. Rows are judged one by one: a null or repeated doc_id
    does not matter, and equal rows stay or go together. An empty table gives an empty table.
    """
    return _kept(docs, quality.quality_cascade, F.col("kept"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by a model of the labels of documents still here.

    A null or empty text scores low and stays; equal texts stay or go together, whatever their doc_id; rows
    that share a doc_id share its label in training. Without labels of both classes, and in an empty table, no row
    is rejected.
    """
    model = toxicity.train_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _kept(docs, lambda rows: toxicity.score_documents(rows, model, threshold=0.3), F.col("toxic_predicted") == 0)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    Rows without a doc_id link with nothing and stay. Rows that share doc_id (or have none) and text are copies
    and become one of them; rows that share a doc_id but not a text are one document and stay or go together.
    """
    kept = minhash.minhash_components(docs, shingle_words=5, percent=80).where("kept and doc_id is not null")
    kept = store.materialize(kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")))
    single = docs.join(kept.where("rows = 1"), "doc_id", "left_semi").select(*map(_column, docs.columns))
    repeated = docs.join(kept.where("rows > 1"), "doc_id", "left_semi").select(*map(_column, docs.columns))
    # only these are dealt by their texts, which is nothing where doc_id is a key
    copies = repeated.unionByName(docs.where("doc_id is null"))
    return single.unionByName(copies.dropDuplicates(["doc_id", "text"]))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens.

    A null or empty text is the end id alone; a null doc_id stays null; repeated rows are packed each by itself; an empty
    table gives no rows.
    """
    return packing.cost_balanced_packing(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=1024)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: Training, MinHash and tokenization are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store.materialize(docs)
    return docs
