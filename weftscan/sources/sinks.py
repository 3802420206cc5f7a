"""Where evidence, texts, findings and claims are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_bundles(bundles: DataFrame, path: str) -> None:
    """Evidence bundles as JSON, one site a line, which ``read_bundles(lines=True)`` reads back."""
    bundles.write.mode("overwrite").json(path)


def texts_by_content(pages: DataFrame) -> DataFrame:
    """(text_hash, text): each text of ``pages`` (text) once, under its SHA-256; nulls go. Equal texts are cut to one before the shuffle."""
    hashed = pages.where("text is not null").select(F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"), "text")
    return hashed.groupBy("text_hash").agg(F.any_value("text").alias("text"))


def write_texts(pages: DataFrame, path: str) -> None:
    """The texts of pages, addressed by content, as Parquet in order of their hash, so one hash is found by row group statistics."""
    texts_by_content(pages).sortWithinPartitions("text_hash").write.mode("overwrite").parquet(path)


def save_texts(pages: DataFrame, table: str, buckets: int = 64) -> None:
    """The texts of pages, addressed by content, as a table in ``buckets`` buckets of their hash: joins by hash read each bucket where it lies."""
    texts_by_content(pages).repartition(buckets, "text_hash").write.mode("overwrite").bucketBy(buckets, "text_hash").sortBy("text_hash").saveAsTable(table)


def with_texts(pages: DataFrame, table: str, hash_column: str, name: str = "text") -> DataFrame:
    """``pages`` with the texts of ``save_texts`` by hash; null where there is none. Only pages are dealt out, into the buckets that the texts lie in."""
    texts = pages.sparkSession.table(table).select(F.col("text_hash").alias(hash_column), F.col("text").alias(name))
    return pages.join(texts.hint("merge"), hash_column, "left")


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines, a folder for each skill."""
    findings.write.mode("overwrite").partitionBy("skill").json(path)


def merge_claims(bundles: DataFrame, claims: DataFrame) -> DataFrame:
    """``bundles`` with canonical_claims replaced by those of ``claims`` (as ``claims.promote`` gives them), in their order.

    A site without claims gets an empty list. Claims of a site are few: promotion keeps a dozen.
    """
    kind = next(p for p in bundles.schema if p.name == "canonical_claims").dataType.simpleString()
    one = F.struct(
        "seq", F.struct("id", "from_candidates", "kind", F.col("value").alias("value_normalized"), F.col("confidence").alias("first_party_confidence"), F.col("ambiguity").alias("entity_ambiguity")).alias("c")
    )
    listed = claims.groupBy("site_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]).cast(kind).alias("_claims"))
    joined = bundles.join(listed, "site_id", "left")
    return joined.withColumn("canonical_claims", F.coalesce("_claims", F.array().cast(kind))).drop("_claims").select(*bundles.columns)
