"""What a crawl of a site did and could not do, from landed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The sources of addresses, in the order in which a strategy names them.
SOURCES = ["sitemap", "nav", "linkgraph"]


def counters(sites: DataFrame, frontier: DataFrame, pages: DataFrame, errors: DataFrame) -> DataFrame:
    """(site_id, discovered, fetched, blocked_by_robots, errors, strategy) for each of ``sites``.

    ``frontier`` has (site_id, url, source, allowed), a row for each way an address was found, and counts addresses once; an
    address without a decision is allowed. A site without rows has zeros and the strategy of none.
    """
    found = frontier.groupBy("site_id", "url").agg(F.bool_and(F.coalesce("allowed", F.lit(True))).alias("allowed"), F.collect_set("source").alias("by"))
    counted = found.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if(~F.col("allowed")).alias("blocked_by_robots"), *[F.bool_or(F.array_contains("by", s)).alias(f"_{s}") for s in SOURCES]
    )
    numbers = [rows.groupBy("site_id").agg(F.count(F.lit(1)).alias(name)) for rows, name in ((pages, "fetched"), (errors, "errors"))]
    joined = sites.select("site_id").join(counted, "site_id", "left").join(numbers[0], "site_id", "left").join(numbers[1], "site_id", "left")
    used = F.concat_ws("+", *[F.when(F.col(f"_{s}"), F.lit(s)) for s in SOURCES])
    return joined.select(
        "site_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("discovered", "fetched", "blocked_by_robots", "errors")], F.concat(F.lit("stratified:"), F.when(used == "", "none").otherwise(used)).alias("strategy")
    )


def shell_sites(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """(site_id, what, reason): sites without rendering where each successful page is what a path that cannot exist answers.

    ``sites`` has site_id, js_render and soft404_hash; ``pages`` site_id, status and raw_hash. A site without a baseline or
    without successful pages has no row.
    """
    held = pages.where("status between 200 and 299").join(sites.where("soft404_hash is not null and not js_render").select("site_id", "soft404_hash"), "site_id")
    shells = held.groupBy("site_id").agg(F.bool_and(F.coalesce(F.col("raw_hash") == F.col("soft404_hash"), F.lit(False))).alias("all"), F.count(F.lit(1)).alias("n")).where("all")
    return shells.select("site_id", F.lit("page-content").alias("what"), F.format_string("all %d pages repeat the answer to a path that cannot exist, and none was rendered", "n").alias("reason"))


def fetched_at(asked: DataFrame, pages: DataFrame, sites: DataFrame) -> DataFrame:
    """``asked`` (site_id, url) with fetched_at: that of the first page with this or this final address, else the start of the audit."""
    named = [pages.select("site_id", F.col(c).alias("url"), "page_seq", "fetched_at") for c in ("url", "final_url")]
    first = named[0].union(named[1]).groupBy("site_id", "url").agg(F.min_by("fetched_at", "page_seq").alias("_page"))
    joined = asked.join(first, ["site_id", "url"], "left").join(sites.select("site_id", "started_at"), "site_id", "left")
    return joined.withColumn("fetched_at", F.coalesce("_page", "started_at")).drop("_page", "started_at")


def head(rows: DataFrame, by: list[str], order: list, limit: int, what: str) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` rows of each group, and (by, what, kept, total) for each group that has more."""
    from pyspark.sql import Window

    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    beyond = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total")).where(F.col("total") > limit)
    return ranked.where(F.col("_k") <= limit).drop("_k"), beyond.select(*by, F.lit(what).alias("what"), F.lit(limit).alias("kept"), "total")
