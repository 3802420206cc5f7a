"""Connected components of links, as a DataFrame iteration.

Alternates large-star and small-star steps (Kiveris et al., 2014): every edge is moved
towards the smallest id that its ends know, until the edges are stars around the smallest id of
each component. A step needs one aggregation and one join on narrow rows, and the number of
steps grows with the logarithm of the component size. The links never leave the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftscan.llm.store import materialize


def _star(directed: DataFrame) -> DataFrame:
    """For rows (u, v): edges (v, least of u and its vs) for every v, without loops."""
    least = directed.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return directed.join(least, "u").select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _star(down)
    moved = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).union(starred.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of every id in some link, component_id being the smallest id reachable.

    Loops and repeated links are ignored, so ids with only a loop are absent; null ends link nothing.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = materialize(edges)
    while True:
        moved = materialize(_small_star(_large_star(edges)))
        # stars around the least id of a component: no id is both an end and a centre, and each end has one
        # centre. That state is a fixed point of both steps.
        ends = moved.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        if ends.where("n > 1").isEmpty() and moved.join(ends.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        edges = moved
    centres = moved.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return moved.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(centres)
