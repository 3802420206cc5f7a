"""From landed responses to the evidence that rules read, for all sites at once."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftscan.functions import html, robots, urls
from weftscan.operators import crawl, graph, probes, shapes
from weftscan.plans import claims
from weftscan.sources.bundle import TABLES, Evidence
from weftscan.sources.shared import landed, landed_counting

#: Columns of responses that may be absent, with their types.
OPTIONAL = {
    "final_url": "string", "status": "int", "content_type": "string", "x_robots": "string", "ttfb": "double", "connect": "double", "fetched_at": "string", "rendered_html": "string",
}


def site_of(url: Column) -> Column:
    """The origin of an address, by which its site is known."""
    return F.concat(F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1)), F.lit("://"), urls.netloc(url))


def page_table(responses: DataFrame, order: str = "page_id", log: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, dropped) of landed responses with url, html, ``order`` (a whole number, unique) and any of ``OPTIONAL``.

    Each page is parsed once, where it is read, and is known by its final address: of pages with one final address the first
    by ``order`` is kept, and a page that repeats an earlier one under a canonical address both share goes as well. dropped has
    (site_id, redirected, repeated) for sites that lost pages. page_seq is ``order`` counted from the first page of the
    site, with gaps. A row without a usable address is no page; a null status is taken as 200, and a null content type as
    HTML, as landed tables often leave them out. A row without a number of its ``order`` is no page either. ``log`` receives what was observed while pages were
    read: pages, errors (answers that are no success), truncated (pages of which something was cut) and the seconds it took.
    """
    began = time.monotonic()
    given = responses.select("url", "html", F.col(order).cast("long").alias("_order"), *[(F.col(c) if c in responses.columns else F.lit(None)).cast(t).alias(c) for c, t in OPTIONAL.items()])
    final = urls.normalise(F.coalesce("final_url", "url"))
    named = given.withColumns({"url": urls.normalise(F.col("url")), "final_url": final}).where("url is not null and final_url is not null and _order is not null").withColumn("site_id", site_of(F.col("final_url")))
    # addresses are aggregated without the documents, which move once, to meet the numbers of those that are kept
    first = named.groupBy("site_id", "final_url").agg(F.min("_order").alias("_order"), F.count(F.lit(1)).alias("copies"))
    start = first.groupBy("site_id").agg(F.min("_order").alias("_start"), F.sum(F.col("copies") - 1).alias("redirected"))
    kept = named.join(first.select("site_id", "_order").join(start.select("site_id", "_start"), "site_id").drop("site_id"), "_order")
    raw = html.page_evidence(html.parse_pages(kept, url="final_url").drop("html")) if "rendered_html" not in responses.columns else _both(kept)
    p = lambda name: F.col(f"parsed.{name}")
    shown = F.col("seen.text_len") if "seen" in raw.columns else F.lit(None).cast("int")
    pages = raw.select(
        "site_id",
        (F.col("_order") - F.col("_start")).alias("page_seq"),
        "url",
        "final_url",
        F.coalesce("status", F.lit(200)).alias("status"),
        F.coalesce("content_type", F.lit("text/html")).alias("content_type"),
        "page_type",
        "type_confidence",
        p("canonical").alias("canonical"),
        (urls.normalise(p("canonical")) == F.col("final_url")).alias("canonical_self"),
        p("meta_robots").alias("meta_robots"),
        "x_robots",
        p("lang").alias("lang"),
        p("text_len").alias("raw_len"),
        p("hidden_text_len").alias("hidden_len"),
        p("text_hash").alias("raw_hash"),
        shown.isNotNull().alias("rendered"),
        shown.alias("rendered_len"),
        probes.delta_ratio(p("text_len"), shown).alias("delta"),
        p("word_count").alias("words"),
        F.size(p("headings")).alias("n_headings"),
        F.size(p("visible_dates")).alias("n_dates"),
        p("date_modified").alias("date_modified"),
        p("date_published").alias("date_published"),
        "ttfb",
        "connect",
        p("microdata").alias("microdata"),
        p("text").alias("raw_text"),
        (F.col("seen.text") if "seen" in raw.columns else F.lit(None).cast("string")).alias("rendered_text"),
        F.transform(p("nodes"), lambda n: F.struct(*[n[c].alias(c) for c in ("type", "valid", "fields", "vals", "contradicts")])).alias("nodes"),
        p("headings").alias("headings"),
        "fetched_at",
        p("targets").alias("targets"),
        p("truncated").alias("truncated"),
    )
    failed = ~F.coalesce(F.col("status").between(200, 299), F.lit(False))
    pages, seen = landed_counting(pages, pages=F.count(F.lit(1)), errors=F.count_if(failed), truncated=F.count_if(F.size("truncated") > 0))
    if log is not None:
        log |= seen | {"seconds": round(time.monotonic() - began, 3)}
    again = landed(graph.aliases(pages.where("not rendered").select("site_id", "page_seq", "url", "status", "canonical", "raw_hash")))
    repeated = again.groupBy("site_id").agg(F.count(F.lit(1)).alias("repeated"))
    lost = start.select("site_id", "redirected").join(repeated, "site_id", "left").na.fill(0).where("redirected + repeated > 0")
    return pages.join(again.select("site_id", "url"), ["site_id", "url"], "left_anti").select(*pages.columns), lost


def _both(kept: DataFrame) -> DataFrame:
    """Responses and rendered documents parsed; the rendered one is null where there is none."""
    raw = html.parse_pages(kept, url="final_url").drop("html").withColumnRenamed("parsed", "_raw")
    seen = html.parse_pages(raw, html="rendered_html", url="final_url").withColumn("seen", F.when(F.col("rendered_html").isNotNull(), F.col("parsed"))).drop("parsed", "rendered_html")
    return html.page_evidence(seen.withColumnRenamed("_raw", "parsed"))


def to_evidence(responses: DataFrame, started_at: str, policies: DataFrame | None = None, order: str = "page_id", edge_cap: int | None = None, log: dict | None = None, **tables: DataFrame) -> tuple[Evidence, DataFrame]:
    """Evidence of landed ``responses`` (see ``page_table``), and (site_id, what, reason) of what it lacks.

    ``policies`` has (site_id, status, body) of /robots.txt; without a row there a site's policy was not asked for. ``tables`` are
    further tables of ``Evidence`` (probe, hits, sitemaps, well_known) with the columns of ``TABLES``; those not given are empty, and
    rules on them are not assessed. Sites are those with a page. An empty table of responses gives empty tables.
    """
    spark = responses.sparkSession
    pages, lost = page_table(responses, order, log)
    can_render = "rendered_html" in responses.columns
    found = pages.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))
    asked = landed(policies.select("site_id", F.col("status").cast("int").alias("status"), F.col("body").cast("string").alias("body"))) if policies is not None else spark.createDataFrame([], "site_id string, status int, body string")
    policy = landed(asked.select("site_id", F.col("status").cast("int").alias("robots_status"), robots.parse_reason(F.col("status"), F.col("body")).alias("robots_reason"), robots.parse_robots(F.col("body")).alias("parsed")))
    host = urls.host(F.col("site_id"))
    sites = landed(
        found.join(policy.drop("parsed"), "site_id", "left").select(
            "site_id",
            urls.registrable_domain(host).alias("domain"),
            F.col("site_id").alias("origin"),
            F.lit(started_at).alias("started_at"),
            F.col("robots_reason").isNotNull().alias("robots_fetched"),
            "robots_status",
            (F.col("robots_reason") == "ok").alias("robots_ok"),
            "robots_reason",
            F.lit(can_render).alias("js_render"),
            F.lit("probe" in tables).alias("egress"),
            F.lit("hits" in tables).alias("attempted"),
            F.lit(None).cast("string").alias("soft404_hash"),
        )
    )
    groups = policy.where("robots_reason = 'ok'").select("site_id", F.posexplode("parsed.groups").alias("seq", "g"))
    patterns = lambda allow: F.transform(F.filter("g.rules", lambda r: r["allow"] == F.lit(allow)), lambda r: r["pattern"])
    with_text = pages.withColumn("text", F.coalesce("rendered_text", "raw_text"))
    named = landed(claims.candidates(claims.observations(with_text)))
    edges, cut = graph.link_edges(pages.select("site_id", "page_seq", "url", "targets"), sites.select("site_id", urls.netloc(F.col("site_id")).alias("place")), edge_cap)
    empty = {name: spark.createDataFrame([], TABLES[name]) for name in ("sitemaps", "probe", "well_known", "hits")}
    ev = Evidence(
        **(empty | tables),
        sites=sites,
        pages=pages,
        groups=landed(groups.select("site_id", "seq", F.explode("g.agents").alias("user_agent"), patterns(True).alias("allow"), patterns(False).alias("disallow"))),
        agents=landed(robots.verdicts(asked)),
        declared=policy.where("robots_reason = 'ok'").select("site_id", F.posexplode("parsed.sitemaps").alias("seq", "url")),
        claims=landed(claims.promote(named).drop("from_candidates", "beyond")),
        candidates=named.drop("dropped"),
        edges=edges,
    )
    return ev, degradations(ev, lost, named, cut)


def degradations(ev: Evidence, lost: DataFrame, named: DataFrame, cut: DataFrame) -> DataFrame:
    """(site_id, what, reason): shells, pages cut short, pages left out, claims absent or beyond the limit, edges beyond it."""
    why = lambda rows, what, reason: rows.select("site_id", F.lit(what).alias("what"), reason.alias("reason"))
    short = ev.pages.select("site_id", F.explode("truncated").alias("field")).groupBy("site_id", "field").agg(F.count(F.lit(1)).alias("n"))
    silent = ev.sites.select("site_id").join(named.select("site_id").distinct(), "site_id", "left_anti")
    beyond = named.groupBy("site_id").agg(F.max("dropped").alias("dropped")).where("dropped > 0")
    parts = [
        crawl.shell_sites(ev.sites, ev.pages),
        why(short, "extract", F.format_string("%s, on %d pages", "field", "n")),
        why(lost, "duplicates", F.format_string("%d pages led to the address of another and %d repeat an earlier one", "redirected", "repeated")),
        why(silent, "claims", F.lit("no page states a claim that could be read")),
        why(beyond, "claims", F.format_string("%d further claims are beyond the limit", "dropped")),
        why(cut, "links", F.format_string("of %d links only the first are kept", "total")),
        why(ev.sites.where("not js_render"), "render", F.lit("pages were not rendered")),
        why(ev.sites.where("not robots_fetched"), "robots", F.lit("no answer for /robots.txt was landed")),
    ]
    return reduce(DataFrame.unionByName, parts)


def strata_of(ev: Evidence, frontier: DataFrame) -> DataFrame:
    """(site_id, page_type, discovered, sampled) of the addresses known of each site and of its pages."""
    known = frontier.select("site_id", urls.page_type(F.col("url"))["page_type"].alias("page_type"))
    return shapes.strata(known, ev.pages.select("site_id", "page_type"), ["site_id", "page_type"])
