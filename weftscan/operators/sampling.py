"""Stratified samples of known addresses."""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftscan.functions import urls
from weftscan.operators import shapes


def sample_key():
    """Plain addresses before those with a query, shallow before deep, short before long."""
    u = F.col("url")
    return [urls.query(u) != "", F.length(urls.path(u)) - F.length(F.replace(urls.path(u), F.lit("/"), F.lit(""))), F.length(u), u]


def _within(rows: DataFrame, name: str, by: list[str], order: list, limit: int | None) -> DataFrame:
    """``rows`` with their place in groups from 1 on; those beyond ``limit`` go, and Spark cuts them before it deals groups out."""
    numbered = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return numbered if limit is None else numbered.where(F.col(name) <= limit)


def round_robin(rows: DataFrame, strata: list[str], sections: list[str], order: list, limit: int | None = None, group: list[str] | None = None) -> DataFrame:
    """Rows in turns: one of each stratum, in it one of each section, in a section by ``order``; pick is the place in a group.

    It deals evenly but does not weigh what is left of a stratum. A row among the first of its group is among as many first ones of
    its stratum and of its section, so with a limit each step leaves no more than that of a group.
    """
    group = group or []
    inside = _within(rows, "_a", [*group, *strata, *sections], order, limit)
    turn = _within(inside, "_b", [*group, *strata], ["_a", *sections], limit)
    return _within(turn, "pick", group, ["_b", *strata], limit).drop("_a", "_b")


def greedy_order(rows: list[tuple], limit: int | None = None) -> list[str]:
    """The exact greedy order of (url, stratum, section, key) rows.

    Each pick is of the stratum picked least so far, then of the one with most left, then by name; within it
    the same for sections; within a section by key.
    """
    heaps: dict = defaultdict(lambda: defaultdict(list))
    for url, stratum, section, key in rows:
        heaps[stratum][section].append((key, url))
    for sections in heaps.values():
        for heap in sections.values():
            heapq.heapify(heap)
    left = {s: sum(map(len, sections.values())) for s, sections in heaps.items()}
    taken, taken_in, out = defaultdict(int), defaultdict(int), []
    while left and (limit is None or len(out) < limit):
        s = min(left, key=lambda s: (taken[s], -left[s], s))
        sections = heaps[s]
        sec = min(sections, key=lambda c: (taken_in[s, c], -len(sections[c]), c))
        out.append(heapq.heappop(sections[sec])[1])
        taken[s] += 1
        taken_in[s, sec] += 1
        left[s] -= 1
        if not sections[sec]:
            del sections[sec]
        if not left[s]:
            del left[s]
    return out


def greedy_picks(rows: DataFrame, group: list[str], stratum: str, sections: list[str], order: list[Column], limit: int | None = None) -> DataFrame:
    """``rows`` with pick, the place of ``greedy_order`` in each group, for groups of any size; with a limit only so many.

    A stratum is filled in rounds: in round t each stratum with more than t rows gives one, those with most left first. All of them have given
    t by then, so most left is most rows, and what a stratum gives when follows from the numbers of rows alone. The same
    holds for sections in a stratum. Sizes are counted by partial aggregation; of the rows themselves only the first ``limit`` of a
    section, a stratum and a group go on. Rows that ``order`` does not tell apart are picked in any order.
    """
    cell = [*group, stratum, *sections]
    sizes = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_in_section"))
    strata = sizes.groupBy(*group, stratum).agg(F.sum("_in_section").alias("_in_stratum"))
    inside = _within(rows, "_j", cell, order, limit)
    inside = shapes.met(inside, shapes.met(sizes, strata, [*group, stratum]), cell)
    turn = _within(inside, "_t", [*group, stratum], ["_j", F.desc("_in_section"), *sections], limit)
    return _within(turn, "pick", group, ["_t", F.desc("_in_stratum"), stratum], limit).drop("_j", "_t", "_in_section", "_in_stratum")


def greedy_sample(frontier: DataFrame, limit: int) -> DataFrame:
    """(site_id, url, page_type, pick): the exact greedy sample of ``limit`` addresses of each site of ``frontier`` (site_id, url)."""
    typed = frontier.select("site_id", "url", urls.page_type(F.col("url"))["page_type"].alias("page_type"), urls.section_of(F.col("url")).alias("s"))
    keyed = typed.select("site_id", "url", "page_type", F.lower("s.section").alias("section"), F.col("s.depth").alias("depth"))
    return greedy_picks(keyed, ["site_id"], "page_type", ["section", "depth"], sample_key(), limit).select("site_id", "url", "page_type", "pick")


def render_order(pages: DataFrame) -> DataFrame:
    """Adds render_rank: the first page of each type, in page order, before all others."""
    first = F.row_number().over(Window.partitionBy("site_id", "page_type").orderBy("page_seq")) > 1
    flagged = pages.withColumn("_later", first)
    return flagged.withColumn("render_rank", F.row_number().over(Window.partitionBy("site_id").orderBy("_later", "page_seq"))).drop("_later")
