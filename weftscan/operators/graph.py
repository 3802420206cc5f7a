"""The link graph of sites: edges, orphans and depth."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftscan.functions import urls
from weftscan.sources.shared import landed

EDGE_CAP = 5000


def in_scope(targets: DataFrame, sites: DataFrame) -> DataFrame:
    """``targets`` (site_id, target) on the host of the site or its www twin, the twin rewritten; resources other than pages go.

    ``sites`` has (site_id, place), place being the host and port.
    """
    joined = targets.join(sites.select("site_id", "place", urls.twin_netloc(F.col("place")).alias("twin")), "site_id")
    target = urls.normalise(F.col("target"))
    joined = joined.withColumn("target", target).where(F.col("target").isNotNull() & urls.is_page_address(F.col("target")))
    where = urls.netloc(F.col("target"))
    moved = F.when(where == F.col("twin"), urls.with_netloc(F.col("target"), F.col("place"))).when(where == F.col("place"), F.col("target"))
    return joined.withColumn("target", moved).where("target is not null").drop("place", "twin")


def link_edges(pages: DataFrame, sites: DataFrame, cap: int | None = EDGE_CAP) -> tuple[DataFrame, DataFrame]:
    """Distinct edges (site_id, src, dst) without loops, at most ``cap`` for each site in page order, and (site_id, total) beyond it.

    ``pages`` has site_id, page_seq, url and targets (addresses in order). With ``cap`` None every edge is
    returned, no site's edges are put in order, and nothing is beyond it.
    """
    exploded = pages.select("site_id", "page_seq", F.col("url").alias("src"), F.posexplode("targets").alias("at", "target"))
    scoped = in_scope(exploded, sites).where("target <> src")
    if cap is None:
        edges = scoped.select("site_id", "src", F.col("target").alias("dst")).distinct()
        return edges, edges.groupBy("site_id").agg(F.count(F.lit(1)).alias("total")).where(F.lit(False))
    edges = scoped.groupBy("site_id", "src", F.col("target").alias("dst")).agg(F.min(F.struct("page_seq", "at")).alias("first"))
    ranked = edges.withColumn("k", F.row_number().over(Window.partitionBy("site_id").orderBy("first")))
    over = edges.groupBy("site_id").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") > cap)
    return ranked.where(F.col("k") <= cap).select("site_id", "src", "dst"), over


def orphans(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """(site_id, url) of pages, save the first of a site, that no edge leads to."""
    reached = edges.select("site_id", F.col("dst").alias("url"))
    return pages.where("page_seq > 0").select("site_id", "url").join(reached, ["site_id", "url"], "left_anti")


def depths(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """(site_id, url, depth) of pages reached from the first page of each site, breadth first for all sites at once.

    Each round is a join of the last layer with the edges, until nothing new is found; what it finds is written to the shared folder.
    """
    members = pages.select("site_id", F.col("url").alias("dst")).distinct()
    # every round reads them
    inner = landed(edges.join(members, ["site_id", "dst"], "left_semi").select("site_id", "src", "dst").distinct())
    layer = pages.where("page_seq = 0").select("site_id", "url", F.lit(0).alias("depth")).distinct()
    seen = layer
    for level in itertools.count(1):
        near = layer.select("site_id", F.col("url").alias("src")).join(inner, ["site_id", "src"]).select("site_id", F.col("dst").alias("url")).distinct()
        layer = landed(near.join(seen.select("site_id", "url"), ["site_id", "url"], "left_anti").withColumn("depth", F.lit(level)))
        if layer.isEmpty():
            return seen
        # many short layers would make a long plan
        seen = seen.unionByName(layer) if level % 20 else landed(seen.unionByName(layer))


def max_depth(pages: DataFrame, edges: DataFrame) -> DataFrame:
    return depths(pages, edges).groupBy("site_id").agg(F.max("depth").alias("max_depth_from_home"))


def aliases(pages: DataFrame) -> DataFrame:
    """(site_id, url, alias_of): a page that repeats an earlier one, with equal text and a canonical link between the two.

    ``pages`` has site_id, page_seq, url, status, canonical and raw_hash.
    """
    ok = pages.where("status between 200 and 299 and raw_hash is not null").select("site_id", "raw_hash", "page_seq", "url", "canonical")
    names = ok.select("*", F.explode(F.array_distinct(F.filter(F.array("url", "canonical"), lambda x: x.isNotNull()))).alias("name"))
    page = F.struct("page_seq", "url")
    points, lives = F.coalesce(F.col("canonical") == F.col("name"), F.lit(False)), F.col("url") == F.col("name")
    # a link needs the canonical of one page: of all pages with a name only the first that points to it and the first that lives there count
    first = names.groupBy("site_id", "raw_hash", "name").agg(F.min(F.when(points, page)).alias("pointing"), F.min(F.when(lives, page)).alias("living"))
    earliest = F.when(points, F.least("pointing", "living")).otherwise(F.col("pointing"))
    met = names.join(first, ["site_id", "raw_hash", "name"]).select("site_id", "page_seq", "url", earliest.alias("e")).where("e.page_seq < page_seq")
    return met.groupBy("site_id", "url").agg(F.min("e").alias("e")).select("site_id", "url", F.col("e.url").alias("alias_of"))
