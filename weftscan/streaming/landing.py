"""Pages that arrive as a stream, through the same code as batches.

The audit itself is a batch over a site; a stream of landed responses keeps parsed evidence up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftscan.functions import html, urls

SCHEMA = "page_id long, url string, html string, landed_at timestamp"


def landed_pages(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of page files (Parquet with ``SCHEMA``) as they appear in ``folder``."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def parsed_stream(pages: DataFrame) -> DataFrame:
    """Measurements of each page; no state is kept."""
    return html.page_evidence(html.parse_pages(pages))


def arrivals(pages: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Pages by registrable domain and window of landing time; rows later than ``late`` are left out, so state is bounded."""
    domain = urls.registrable_domain(urls.host(F.col("url")))
    return pages.withWatermark("landed_at", late).groupBy(F.window("landed_at", width), domain.alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


def write_evidence(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends parsed pages to ``out``, each batch once: its folder is named by the batch and is overwritten when it is retried."""

    def save(batch: DataFrame, number: int) -> None:
        parsed_stream(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
