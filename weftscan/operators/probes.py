"""Landed probe responses: missing-page baselines, well-known files and user-agent identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sizes and limits of probes.
LEAST_BYTES, MOST_ROWS = 256, 16
WELL_KNOWN = ["/llms.txt", "/agents.md", "/.well-known/ucp"]


def probe_path(host: Column, number: int) -> Column:
    """A path that no site has, the same in every run: part of a digest of the host."""
    return F.concat(F.lit("/"), F.substring(F.sha2(F.concat(F.lit(f"missing page {number} "), host), 256), 1, 16))


def missing_page_baseline(responses: DataFrame) -> DataFrame:
    """(site_id, detected, baseline_hash) from two ``responses`` (site_id, status, bytes, text_hash) at paths that cannot exist.

    detected: both are 2xx and substantial; the baseline is their text if it is the same.
    """
    good = F.coalesce(F.col("status").between(200, 299) & (F.col("bytes") >= LEAST_BYTES), F.lit(False))
    agg = responses.groupBy("site_id").agg((F.count_if(good) >= 2).alias("two"), F.bool_and(good).alias("all"), F.min("text_hash").alias("a"), F.max("text_hash").alias("b"))
    detected = F.col("two") & F.col("all")
    return agg.select("site_id", detected.alias("detected"), F.when(detected & (F.col("a") == F.col("b")), F.col("a")).alias("baseline_hash"))


def well_known_files(responses: DataFrame, baselines: DataFrame) -> DataFrame:
    """(site_id, path, status, present) from ``responses`` (site_id, path, status, bytes, text_hash); refused ones give no row."""
    kept = responses.where(F.col("status").isNull() | ~F.col("status").isin(401, 403)).join(baselines.select("site_id", "baseline_hash"), "site_id", "left")
    present = F.col("status").between(200, 299) & (F.col("bytes") > 0) & ~F.coalesce(F.col("text_hash") == F.col("baseline_hash"), F.lit(False))
    return kept.select("site_id", "path", "status", F.coalesce(present, F.lit(False)).alias("present"))


def probe_targets(pages: DataFrame) -> DataFrame:
    """(site_id, url, target_seq): the first page of a site and the one with the longest text among the others; the later address on ties."""
    home = pages.where("page_seq = 0").select("site_id", "url", F.lit(0).alias("target_seq"))
    deep = pages.where("page_seq > 0 and status between 200 and 299").groupBy("site_id").agg(F.max_by("url", F.struct("raw_len", "url")).alias("url"))
    return home.unionByName(deep.withColumn("target_seq", F.lit(1)))


def _free(targets: DataFrame, agents: list[str], allowed: DataFrame) -> DataFrame:
    asked = targets.select("*", F.posexplode(F.array(*map(F.lit, agents))).alias("agent_seq", "agent"))
    return asked.join(allowed.where("not allowed").select("site_id", "url", "agent"), ["site_id", "url", "agent"], "left_anti")


def probe_plan(targets: DataFrame, agents: list[str], allowed: DataFrame, most: int | None = MOST_ROWS) -> DataFrame:
    """(site_id, url, agent) to request: each target under each identity that policy allows, the first ``most`` of each site (None: all).

    ``allowed`` has (site_id, url, agent, allowed); identities without a row there are free to ask.
    """
    free = _free(targets, agents, allowed)
    if most is not None:
        free = free.withColumn("k", F.row_number().over(Window.partitionBy("site_id").orderBy("target_seq", "agent_seq"))).where(F.col("k") <= most)
    return free.select("site_id", "url", "agent")


def probe_cuts(targets: DataFrame, agents: list[str], allowed: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """(site_id, what, kept, total) of sites whose plan of ``most`` requests leaves some out."""
    counts = _free(targets, agents, allowed).groupBy("site_id").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") > most)
    return counts.select("site_id", F.lit("probe").alias("what"), F.lit(most).alias("kept"), "total")


def best_render(attempts: DataFrame) -> DataFrame:
    """The attempt (site_id, url, attempt, html) with the longest document for each page, the first of equal ones."""
    return attempts.groupBy("site_id", "url").agg(F.max_by(F.struct("attempt", "html"), F.struct(F.length("html").alias("n"), (-F.col("attempt")).alias("a"))).alias("b")).select("site_id", "url", "b.*")


def delta_ratio(raw_len: Column, rendered_len: Column) -> Column:
    """The share of the rendered text that the response lacks, in thousandths; null without rendered text."""
    return F.when(rendered_len > 0, F.round(F.greatest((rendered_len - raw_len) / rendered_len, F.lit(0.0)), 3))
