"""The queries of the library and the SQL that checks them.

Three kinds: queries on the ``pages`` table; operators with parameters on other tables, which stand in for sites
and pages (they test the operator and not a web rule); and rules, reports and claims over evidence made of the given tables.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftscan.functions import html, robots, urls
from weftscan.operators import crawl, graph, sampling, shapes
from weftscan.plans import claims, compose, landing, rule_sql, stand_in
from weftscan.plans import rules as R
from weftscan.sources import json_schema
from weftscan.sources.shared import landed

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Pages


def page_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by registrable domain and page type."""
    u = F.col("url")
    typed = table(spark, sf_dir, "pages").select(urls.registrable_domain(urls.host(u)).alias("domain"), urls.page_type(u).alias("t"))
    return typed.groupBy("domain", F.col("t.page_type").alias("page_type"), F.col("t.confidence").alias("confidence")).agg(F.count(F.lit(1)).alias("discovered"))


def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical address, host, domain, www twin, section and depth of each page."""
    n = urls.normalise(F.col("url"))
    s = urls.section_of(n)
    return table(spark, sf_dir, "pages").select(
        "page_id",
        n.alias("normalised"),
        urls.host(n).alias("host"),
        urls.registrable_domain(urls.host(n)).alias("domain"),
        urls.twin_netloc(urls.netloc(n)).alias("twin"),
        urls.path_and_query(n).alias("path_and_query"),
        s["section"].alias("section"),
        s["depth"].cast("long").alias("depth"),
    )


def page_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each canonical address and the number of its copies."""
    rows = table(spark, sf_dir, "pages").select(urls.normalise(F.col("url")).alias("normalised"), "page_id")
    return shapes.keep_first(rows, ["normalised"], ["page_id"])


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_evidence(html.parse_pages(table(spark, sf_dir, "pages")))


def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of level one, language and forms of each page, by the parser."""
    p = _parsed(spark, sf_dir)
    return p.select("page_id", F.size(F.filter("parsed.headings", lambda h: h["level"] == 1)).cast("long").alias("n_h1"), F.col("parsed.lang").alias("lang"), F.col("parsed.forms").cast("long").alias("forms"))


def page_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text measurements of each page."""
    columns = ["text_len", "hidden_text_len", "text_hash", "word_count", "boilerplate_ratio", "longest_block_words", "heading_density_per_1k", "link_total", "image_total", "microdata"]
    return _parsed(spark, sf_dir).select("page_id", "url", "page_type", "type_confidence", *[F.col(f"parsed.{c}").alias(c) for c in columns], html.excerpt(F.col("parsed.text")).alias("excerpt"), F.size("parsed.visible_dates").alias("n_dates"), F.size("parsed.nodes").alias("n_nodes"))


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).groupBy(F.col("parsed.lang").alias("lang")).agg(F.count(F.lit(1)).alias("pages"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links of each site to its own pages, all of them, and their distinct sources and targets."""
    pages = table(spark, sf_dir, "pages")
    place = urls.netloc(F.col("url"))
    own = html.parse_pages(pages).select(place.alias("site_id"), F.lit(0).alias("page_seq"), urls.normalise(F.col("url")).alias("url"), F.col("parsed.targets").alias("targets"))
    sites = pages.select(place.alias("site_id"), place.alias("place")).distinct()
    return graph.link_edges(own, sites, cap=None)[0].groupBy("site_id").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


def page_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy stratified sample of thirty addresses of the whole table as one frontier for each top domain."""
    u = urls.normalise(F.col("url"))
    frontier = table(spark, sf_dir, "pages").select(F.substring_index(urls.host(u), ".", -1).alias("site_id"), u.alias("url")).distinct()
    return sampling.greedy_sample(frontier, 30)


def landed_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct addresses of each site of the whole table, and the pages that only lead to one of them again."""
    pages, lost = landing.page_table(table(spark, sf_dir, "pages"))
    counts = pages.groupBy("site_id").agg(F.count(F.lit(1)).alias("kept")).join(lost, "site_id", "left").na.fill(0)
    return counts.select("site_id", (F.col("kept") + F.col("repeated")).alias("addresses"), "redirected")


_POLICIES = ["User-agent: *\nDisallow: /\nAllow: /en/", "User-agent: *\nDisallow: /de/\n\nUser-agent: Bingbot\nDisallow: /", "User-agent: PerplexityBot\nDisallow: /*?page=\n", ""]


def _landed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The table of pages as responses whose status and time their numbers decide, and an answer for /robots.txt of most sites, which their names decide."""
    k = F.col("page_id")
    responses = table(spark, sf_dir, "pages").withColumns({"status": F.when(k % 9 == 0, 404).when(k % 31 == 0, 500).otherwise(200), "ttfb": (k * 37 % 4000).cast("double"), "connect": F.when(k % 2 == 0, 10.0)})
    n = F.length("site_id")
    bodies = F.element_at(F.array(*map(F.lit, _POLICIES)), n % len(_POLICIES) + 1)
    sites = responses.select(landing.site_of(urls.normalise(F.col("url"))).alias("site_id")).distinct().where(n % 7 > 0)
    return responses, sites.select("site_id", F.when(n % 5 == 0, 503).otherwise(200).alias("status"), bodies.alias("body"))


def landed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of every rule on the sites of the whole table of pages."""
    responses, policies = _landed(spark, sf_dir)
    ev, _ = landing.to_evidence(responses, "2024-05-01T00:00:00Z", policies)
    return compose.run_rules_apart(ev, columns=["site_id", "rule_id", "outcome"]).groupBy("rule_id", "outcome").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("site_id").alias("sites"))


def landed_degradations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the evidence of the whole table of pages lacks, by kind."""
    _, lacks = landing.to_evidence(table(spark, sf_dir, "pages"), "2024-05-01T00:00:00Z")
    return lacks.groupBy("what").agg(F.countDistinct("site_id").alias("sites"))


# Operators on other tables


def user_error_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.share_of_group(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "error", 2, 0.2)


def user_error_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of each hour with many large values: one row for the hour if several types fire over half of it."""
    events = table(spark, sf_dir, "events").withColumn("hour", F.hour("ts"))
    total = events.groupBy("hour").agg(F.count(F.lit(1)).alias("total"))
    shares = shapes.share_of_group(events, ["hour", "event_type"], F.col("value") > 20, 2, 0.5).join(total, "hour")
    return shapes.roll_up(shares, "hour", "event_type", F.col("total"))


def user_value_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.median_against(table(spark, sf_dir, "events"), ["user_id"], F.col("value"), 60.0, 5)


def user_type_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.pivot_compare(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value", "view", ["click", "error", "purchase", "signup"])


def user_top_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = shapes.top_n(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")], 5)
    return ranked.withColumn("rank", F.col("rank").cast("long"))


def document_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text, by its digest."""
    rows = table(spark, sf_dir, "documents").select(F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "doc_id", "lang", "source")
    return shapes.keep_first(rows, ["digest"], ["doc_id"])


def document_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and labelled documents, by language and source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return shapes.strata(docs, docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi"), ["lang", "source"])


def document_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred documents dealt in turns over languages and sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    picked = sampling.round_robin(docs, ["lang"], ["source"], [F.col("doc_id")], 200)
    return picked.select("doc_id", "lang", "source", F.col("pick").cast("long").alias("pick"))


# Evidence of the given tables


def _case(value: str, names: list[str]) -> str:
    """One of ``names`` by a whole number."""
    return f"CASE {value} % {len(names)} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names)) + " END"


_INPUTS = {
    "blocking": "l_returnflag = 'R'", "breadth": _case("l_linenumber", ["site", "section", "page"]), "importance": "CASE l_linestatus WHEN 'F' THEN 'primary' ELSE 'secondary' END", "confidence": _case("l_partkey", ["high", "medium", "low"]),
    "effort": _case("l_suppkey", compose.EFFORTS), "status": _case("l_orderkey", ["found", "risk", "proactive"]),
}


def severity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines by six inputs of severity, and the severity and priority of each combination that occurs."""
    rows = table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(k) for k, e in _INPUTS.items()]).groupBy(*_INPUTS).agg(F.count(F.lit(1)).alias("lines"))
    raw = compose.severity(F.col("blocking"), F.col("breadth"), F.col("importance"), F.col("confidence"))
    rows = rows.withColumn("severity", compose.capped_severity(raw, F.col("status"))).withColumn("priority", compose.priority(F.col("severity"), F.col("effort"), F.col("status")))
    return rows.withColumn("impossible", compose.violation(F.col("severity"), F.col("priority"), F.col("status")).isNotNull())


def rule_query(rule_id: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = R.CATALOGUE[rule_id].judge(stand_in.evidence(spark, sf_dir)).drop("detail")
        return found.withColumns({"page_types": F.array_join("page_types", ","), "urls": F.array_join("urls", " ")})

    query.__name__ = "rule_" + rule_id.lower().replace("-", "_")
    return query


def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of all sites in report order."""
    found = compose.findings_of(stand_in.landed_evidence(spark, sf_dir, R.READ, R.with_signals))
    return found.select("site_id", "id", "rule_id", "severity", "priority", "status", "confidence", "breadth", "pages_affected", "pages_examined", F.array_join("page_types", ",").alias("page_types"), F.array_join("conditional_on", ",").alias("conditional_on"))


def reports_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.markdown(compose.assemble(stand_in.landed_evidence(spark, sf_dir, R.READ, R.with_signals), completed_at="2024-05-01T00:05:00Z"))


def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that reports rest on."""
    return compose.page_rows(stand_in.evidence(spark, sf_dir))


def report_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that were not assessed, and why."""
    return compose.gaps(stand_in.landed_evidence(spark, sf_dir, R.READ, R.with_signals))


def report_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What contradicts itself in reports into which, by the site's number, faults are written."""
    reports = compose.assemble(stand_in.landed_evidence(spark, sf_dir, R.READ, R.with_signals))
    fault = F.substring("site_id", 2, 20).cast("int") % 5
    silent = F.transform("not_assessed", lambda g: F.when(fault == 4, g.withField("reason", F.lit(""))).otherwise(g))
    faulty = reports.withColumns({
        "total_findings": F.col("total_findings") + (fault == 1).cast("int"), "high": F.col("high") + (fault == 2).cast("int"), "not_assessed": silent,
        "checks_passed": F.when(fault == 3, F.filter("checks_passed", lambda _: F.lit(False))).otherwise(F.col("checks_passed")),
    })
    return compose.report_violations(faulty)


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = stand_in.landed_evidence(spark, sf_dir, R.READ, R.with_signals)
    return compose.summary_of(ev, compose.findings_of(ev))


def claims_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim of the sites' candidates, without a limit for a site."""
    out = claims.promote(stand_in.evidence(spark, sf_dir).candidates, None)
    return out.withColumn("from_candidates", F.array_join("from_candidates", ",")).withColumn("seq", F.col("seq").cast("long"))


def claim_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in the texts, headings and markup of the sites' pages."""
    pages = stand_in.evidence(spark, sf_dir).pages.withColumn("text", F.coalesce("rendered_text", "raw_text"))
    # markup, addresses, headings and texts are read from the same pages, which are made once
    return claims.candidates(claims.observations(landed(pages.select("site_id", "page_seq", "url", "status", "page_type", "nodes", "headings", "text").where("status between 200 and 299"))), None)


def site_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = stand_in.evidence(spark, sf_dir)
    return graph.orphans(ev.pages, ev.edges)


def site_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = stand_in.evidence(spark, sf_dir)
    return graph.depths(landed(ev.pages.select("site_id", "page_seq", "url")), ev.edges).withColumn("depth", F.col("depth").cast("long"))


def robots_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that applies to a page of its site, for the crawlers that retrieve."""
    ev = stand_in.evidence(spark, sf_dir)
    rules = robots.governing_rules(ev.groups, ev.agents.where(F.col("agent").isin(R.RETRIEVAL_AGENTS)))
    found = robots.applying(ev.pages.select("site_id", urls.path_and_query(F.col("final_url")).alias("path")).distinct(), rules)
    return found.select("site_id", "agent", "path", "allow", "pattern")


def robots_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest rule that applies decides for each agent, site and page."""
    ev = stand_in.evidence(spark, sf_dir)
    rules = robots.governing_rules(ev.groups, ev.agents)
    paths = ev.pages.select("site_id", urls.path_and_query(F.col("final_url")).alias("path"))
    return robots.decide(paths, rules).groupBy("site_id", "agent").agg(F.count_if("allowed").alias("open"), F.count_if(~F.col("allowed")).alias("closed"))


def page_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that repeat an earlier one of their site."""
    return graph.aliases(stand_in.evidence(spark, sf_dir).pages.select("site_id", "page_seq", "url", "status", "canonical", "raw_hash"))


def claim_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages of a site have a text, and how many of these state each claim."""
    ev = stand_in.evidence(spark, sf_dir)
    texts = ev.pages.select("site_id", F.concat_ws(" ", "raw_text", "rendered_text").alias("text"))
    stated = claims.asserts(F.col("text"), F.col("kind"), F.col("value"))
    return ev.claims.join(texts, "site_id").groupBy("site_id", "id", "kind", "value").agg(F.count(F.lit(1)).alias("pages"), F.count_if(stated).alias("stating"))


_SOURCES = ["wikidata.org", "en.wikipedia.org", "notwikipedia.org", "x.com", "amazon.in", "dailynews.test", "news", "fern.test", "old.reddit.com", "web.archive.org", "timescale.test", "yelp.com"]


def source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the domain that their number stands for, and what kind of source it is."""
    rows = table(spark, sf_dir, "events").select(F.expr(_case("event_id", _SOURCES)).alias("domain"), claims.origin_type(F.expr(_case("event_id", _SOURCES))).alias("origin_type"))
    return rows.groupBy("domain", "origin_type").agg(F.count(F.lit(1)).alias("events"))


def declared_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by their type before and after the types that they declare."""
    pages = stand_in.evidence(spark, sf_dir).pages
    typed = pages.select("page_type", urls.refined_type(F.col("page_type"), F.col("type_confidence"), F.transform("nodes", lambda n: n["type"])).alias("t"))
    return typed.groupBy("page_type", F.col("t.page_type").alias("refined"), F.col("t.confidence").alias("confidence")).agg(F.count(F.lit(1)).alias("pages"))


#: Addresses of pages as a crawl may have found them.
_FOUND = f"""SELECT site_id, url, {_case("page_seq", ["nav", "sitemap", "linkgraph", "seed"])} AS source, CASE WHEN page_seq % 5 = 0 THEN false WHEN page_seq % 5 = 1 THEN NULL ELSE true END AS allowed FROM {{0}}
  UNION ALL SELECT site_id, url, 'sitemap', page_seq % 7 <> 0 FROM {{0}} WHERE page_seq % 3 = 0"""


def crawl_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was found, fetched, closed and failed on the sites."""
    ev = stand_in.evidence(spark, sf_dir)
    frontier = spark.sql(_FOUND.format("{pages}"), pages=ev.pages.select("site_id", "url", "page_seq"))
    return crawl.counters(ev.sites, frontier, ev.pages, ev.pages.where("status >= 400"))


def shell_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites that show only one shell."""
    ev = stand_in.evidence(spark, sf_dir)
    return crawl.shell_sites(ev.sites, ev.pages)


def probe_fetched_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the probed addresses were fetched."""
    ev = stand_in.evidence(spark, sf_dir)
    pages = ev.pages.withColumn("fetched_at", F.format_string("page %d", "page_seq"))
    return crawl.fetched_at(ev.probe.select("site_id", "url").distinct(), pages, ev.sites)


def document_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers' documents have that their schema does not allow."""
    return json_schema.violations(stand_in.documents(spark, sf_dir), stand_in.DOCUMENT_SCHEMA, ["c_custkey"])


_HEADERS = [
    "noindex", "otherbot: noindex", "googlebot: noindex, nosnippet", "otherbot: noindex, nofollow, googlebot: none", "max-snippet: 0", "unavailable_after: 25 Jun 2030 15:00:00 PST, NoSnippet", "googlebot: max-snippet : 0, otherbot: nosnippet",
    "oai-searchbot: NOINDEX, max-image-preview: large", "googlebot:, noindex", " , ,nosnippet", "", "a: b: c, googlebot: x: y", "googlebot : noindex",
]
#: A header for each order, of two parts that its keys choose; some orders have none.
_HEADER = f"CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN {_case('o_orderkey', _HEADERS)} ELSE {_case('o_orderkey', _HEADERS)} || ', ' || {_case('o_custkey', _HEADERS)} END"


def header_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directives of robots headers that are in force for indexing and for snippets, a header for each order."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_HEADER).alias("x_robots"), F.array().cast("array<string>").alias("meta_robots"))
    joined = lambda scopes: F.array_join(F.array_sort(R.directives(scopes)), ",")
    return rows.select("o_orderkey", joined(R.INDEX_SCOPES).alias("indexing"), joined(R.SNIPPET_SCOPES).alias("snippets"))


_TABLE = (
    page_strata, page_addresses, page_duplicates, page_headings, page_measurements, page_languages, page_links, page_sample, landed_sites, landed_outcomes, landed_degradations, user_error_share, user_error_rollup, user_value_median,
    user_type_pivot, user_top_events, document_copies, document_strata, document_round_robin, severity_table, report_findings, reports_markdown, report_pages, report_gaps, report_problems, report_summary, claims_promoted,
    claim_candidates, site_orphans, site_depths, page_aliases, crawl_counters, shell_sites, probe_fetched_at, claim_assertions, source_types, declared_types, robots_matches, header_directives, robots_decisions, document_problems,
)


def queries() -> dict[str, Query]:
    found = {f.__name__: f for f in _TABLE}
    return found | {q.__name__: q for q in map(rule_query, R.CATALOGUE)}


# SQL

_WORDS = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_ADDRESS = rf"""
raw AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS place,
  regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS rawpath, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
part AS (SELECT *, coalesce(nullif(rawpath, ''), '/') AS path, array_to_string(list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_')
  AND lower(split_part(p, '=', 1)) NOT IN {_WORDS(urls.TRACKING_NAMES)}), '&') AS kept FROM raw),
addr AS (SELECT *, scheme || '://' || place || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS normalised, string_split(place, '.') AS labels,
  list_filter(string_split(path, '/'), lambda s: s <> '') AS segments FROM part),
dom AS (SELECT *, CASE WHEN len(labels) >= 3 AND array_to_string(labels[-2:], '.') IN {_WORDS(urls.TWO_LABEL_SUFFIXES)} THEN array_to_string(labels[-3:], '.')
  WHEN len(labels) >= 2 THEN array_to_string(labels[-2:], '.') ELSE place END AS domain FROM addr)"""


def _type_sql() -> str:
    parts = "list_transform(list_filter(string_split(lower(path), '/'), lambda s: s <> ''), lambda s: regexp_replace(s, '\\.(html?|php|aspx?|jsp)$', ''))"
    cases = []
    for kind, words in urls.SEGMENT_WORDS.items():
        names = [w for w in words if w not in urls.AMBIGUOUS_POLICY] if kind == "policy" else words
        cases.append(f"WHEN len(list_filter(p, lambda s: s IN {_WORDS(names)})) > 0" + (f" OR (len(p) <= 2 AND len(list_filter(p, lambda s: s IN {_WORDS(words)})) > 0)" if kind == "policy" else "") + f" THEN '{kind}'")
    lead = " ".join(f"WHEN '{w}' THEN '{k}'" for w, k in urls.LEADING_WORDS.items())
    first = f"list_filter(p, lambda s: split_part(s, '-', 1) IN {_WORDS(urls.LEADING_WORDS)} AND (len(p) <= 2 OR split_part(s, '-', 1) NOT IN ('terms', 'shipping', 'returns', 'refund')))[1]"
    return f"""WITH {_ADDRESS}, typed AS (SELECT domain, path, {parts} AS p FROM dom)
SELECT domain, page_type, CASE page_type WHEN 'home' THEN 0.95::DOUBLE WHEN 'other' THEN 0.3::DOUBLE ELSE 0.6::DOUBLE END AS confidence, count(*) AS discovered FROM (
  SELECT domain, CASE WHEN lower(path) IN {_WORDS(urls.HOME_PATHS)} OR (len(p) = 1 AND regexp_matches(p[1], '{urls.LOCALE}')) THEN 'home' {' '.join(cases)}
    WHEN {first} IS NOT NULL THEN CASE split_part({first}, '-', 1) {lead} END
    WHEN len(p) <= 2 AND len(list_filter(p, lambda s: list_has_any(regexp_split_to_array(s, '[-_]'), ['warranty', 'grievance', 'grievances']))) > 0 THEN 'policy'
    WHEN regexp_matches(lower(path), '{urls.DATED}') THEN 'article' ELSE 'other' END AS page_type FROM typed) GROUP BY ALL"""


_SEVERITY_SQL = f"""
WITH c AS (SELECT {", ".join(f"{e} AS {k}" for k, e in _INPUTS.items())} FROM lineitem), n AS (SELECT *, count(*) AS lines FROM c GROUP BY ALL),
s AS (SELECT *, greatest(CASE WHEN blocking AND breadth = 'site' AND importance = 'primary' THEN 1 WHEN blocking AND breadth <> 'page' THEN 2
    WHEN NOT blocking AND breadth = 'site' AND importance = 'primary' THEN 2 WHEN breadth <> 'page' THEN 3 ELSE 4 END,
  CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, CASE status WHEN 'proactive' THEN 3 ELSE 1 END) AS r FROM n),
t AS (SELECT *, ['critical', 'high', 'medium', 'low'][r] AS severity FROM s)
SELECT blocking, breadth, importance, confidence, effort, status, lines, severity,
  CASE WHEN status = 'proactive' THEN CASE effort WHEN 'high' THEN 'P3' ELSE 'P2' END WHEN r = 1 THEN 'P0' WHEN r = 2 THEN CASE effort WHEN 'high' THEN 'P2' ELSE 'P1' END
    WHEN r = 3 THEN 'P2' ELSE 'P3' END AS priority, status = 'risk' AND r = 1 AS impossible FROM t"""


def _sample_sql(limit: int) -> str:
    """The greedy order by turns and sizes, a frontier for each top domain."""
    key = "contains(normalised, '?'), length(path) - length(replace(path, '/', '')), length(normalised), normalised"
    parts = _type_sql().split("typed AS", 1)[1]
    typed = parts[: parts.index("SELECT domain, page_type")]
    kind = parts[parts.index("SELECT domain, CASE WHEN lower(path)") + len("SELECT domain, ") : parts.index(" AS page_type FROM typed")]
    return f"""WITH {_ADDRESS}, typed AS {typed.replace("SELECT domain, path,", "SELECT DISTINCT split_part(place, '.', -1) AS site_id, normalised, path, lower(CASE WHEN len(segments) > 1 THEN segments[1] ELSE '' END) AS section, len(segments) AS depth,")},
f AS (SELECT site_id, normalised, path, section, depth, {kind} AS page_type FROM typed),
a AS (SELECT *, row_number() OVER (PARTITION BY site_id, page_type, section, depth ORDER BY {key}) AS j, count(*) OVER (PARTITION BY site_id, page_type, section, depth) AS n, count(*) OVER (PARTITION BY site_id, page_type) AS m FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY site_id, page_type ORDER BY j, n DESC, section, depth) AS t FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY t, m DESC, page_type) AS pick FROM b)
SELECT site_id, normalised AS url, page_type, CAST(pick AS INTEGER) AS pick FROM c WHERE pick <= {limit}"""


def _rows(values) -> str:
    """Tuples as the rows of VALUES."""
    literal = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in values)


@functools.cache
def oracle_sql() -> dict[str, str]:
    out = {
        "page_strata": _type_sql(),
        "page_addresses": rf"""WITH {_ADDRESS} SELECT page_id, normalised, place AS host, domain,
            CASE WHEN starts_with(place, 'www.') THEN place[5:] ELSE 'www.' || place END AS twin, path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS path_and_query,
            CASE WHEN len(segments) > 1 THEN segments[1] ELSE '' END AS section, CAST(len(segments) AS BIGINT) AS depth FROM dom""",
        "page_duplicates": f"WITH {_ADDRESS} SELECT normalised, min(page_id) AS page_id, count(*) AS copies FROM dom GROUP BY normalised",
        "landed_sites": f"""WITH {_ADDRESS} SELECT scheme || '://' || place AS site_id, count(DISTINCT normalised) AS addresses, count(*) - count(DISTINCT normalised) AS redirected FROM dom GROUP BY 1""",
        "page_headings": r"""SELECT page_id, CAST(len(regexp_extract_all(html, '<h1[ >]')) AS BIGINT) AS n_h1, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
            CAST(len(regexp_extract_all(html, '<form[ >]')) AS BIGINT) AS forms FROM pages""",
        "page_languages": """SELECT regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, count(*) AS pages FROM pages GROUP BY 1""",
        "page_links": rf"""WITH {_ADDRESS}, l AS (SELECT a.place, a.normalised AS src, a.scheme || '://' || a.place || unnest(regexp_extract_all(p.html, '<a href="(/[^"]*)"', 1)) AS dst FROM addr a JOIN pages p ON p.page_id = a.page_id),
            e AS (SELECT DISTINCT * FROM l WHERE src <> dst AND NOT regexp_matches(lower(dst), '{urls.NON_PAGE}')) SELECT place AS site_id, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM e GROUP BY place""",
        "page_sample": _sample_sql(30),
        "user_error_share": "SELECT *, hits >= 2 AND hits >= 0.2 * members AS fires FROM (SELECT user_id, count(*) AS members, count(*) FILTER (WHERE event_type = 'error') AS hits FROM events GROUP BY user_id)",
        "user_error_rollup": """WITH s AS (SELECT hour(ts) AS hour, event_type, count(*) AS members, count(*) FILTER (WHERE value > 20) AS hits FROM events GROUP BY 1, 2),
            f AS (SELECT s.*, sum(members) OVER (PARTITION BY hour) AS total FROM s), g AS (SELECT * FROM f WHERE hits >= 2 AND hits >= 0.5 * members),
            m AS (SELECT *, count(*) OVER (PARTITION BY hour) >= 2 AND sum(hits) OVER (PARTITION BY hour) >= 0.5 * total AS merged FROM g)
            SELECT CAST(hour AS INTEGER) AS hour, CASE WHEN merged THEN '*' ELSE event_type END AS part, count(*) AS parts, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(members) AS BIGINT) AS members FROM m GROUP BY 1, 2""",
        "user_value_median": """SELECT user_id, n, median, "over", CASE WHEN n < 5 THEN 'not_assessed' WHEN median > 60 THEN 'above' ELSE 'within' END AS verdict FROM (
            SELECT user_id, count(value) AS n, median(value) AS median, count(*) FILTER (WHERE value > 60) AS "over" FROM events GROUP BY user_id)""",
        "user_type_pivot": "SELECT * FROM (SELECT user_id, " + ", ".join(f"max(value) FILTER (WHERE event_type = '{t}') AS \"{t}\"" for t in ("view", "click", "error", "purchase", "signup")) + " FROM events GROUP BY user_id) WHERE view IS NOT NULL",
        "user_top_events": "SELECT * FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5",
        "document_copies": "SELECT md5(coalesce(text, '')) AS digest, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source, count(*) AS copies FROM documents GROUP BY 1",
        "document_strata": "SELECT lang, source, count(*) AS discovered, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS sampled FROM documents GROUP BY ALL",
        "document_round_robin": """WITH a AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS a FROM documents),
            b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY a, source) AS b FROM a), c AS (SELECT *, row_number() OVER (ORDER BY b, lang) AS pick FROM b)
            SELECT doc_id, lang, source, pick FROM c WHERE pick <= 200""",
        "severity_table": _SEVERITY_SQL,
        "claims_promoted": f"""WITH {stand_in.ctes("candidates")}, g AS (SELECT site_id, kind, value_normalized AS value, bool_or(extraction_method = 'jsonld') AS marked, sum(observed_count) AS total,
            array_to_string(list_sort(list(DISTINCT id)), ',') AS from_candidates, list_filter(string_split(value_normalized, ' '), lambda w: w NOT IN {_WORDS(claims.GENERIC_WORDS)}) AS w
            FROM fx_candidates WHERE kind IN {_WORDS(claims.CORROBORABLE)} GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY kind <> 'legal_name', NOT marked, total DESC, kind, value) AS seq FROM g)
            SELECT site_id, seq, 'C-' || lpad(CAST(seq AS VARCHAR), 3, '0') AS id, from_candidates, kind, value,
            CASE WHEN kind = 'founded_year' AND NOT marked THEN 'low' WHEN marked AND total >= 2 THEN 'high' WHEN marked OR total >= 2 THEN 'medium' ELSE 'low' END AS confidence,
            CASE WHEN kind <> 'legal_name' THEN 'low' WHEN len(w) = 0 OR (len(w) = 1 AND length(w[1]) <= 5) THEN 'high' WHEN len(w) = 1 THEN 'medium' ELSE 'low' END AS ambiguity, CAST(0 AS BIGINT) AS beyond FROM r""",
        "report_pages": f"WITH {stand_in.ctes('pages')} SELECT site_id, page_seq, url, status, page_type, raw_len AS text_chars, rendered_len AS rendered_chars, words, n_headings, ttfb FROM fx_pages",
        "site_orphans": f"WITH {stand_in.ctes('pages', 'edges')} SELECT site_id, url FROM fx_pages p WHERE page_seq > 0 AND NOT EXISTS (SELECT 1 FROM fx_edges e WHERE e.site_id = p.site_id AND e.dst = p.url)",
        "site_depths": f"""WITH RECURSIVE {stand_in.ctes("pages", "edges")}, walk(site_id, url, depth) AS (SELECT site_id, url, 0 FROM fx_pages WHERE page_seq = 0
            UNION SELECT e.site_id, e.dst, depth + 1 FROM walk w JOIN fx_edges e ON e.site_id = w.site_id AND e.src = w.url JOIN fx_pages p ON p.site_id = e.site_id AND p.url = e.dst WHERE depth < 20)
            SELECT site_id, url, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY 1, 2""",
        "page_aliases": f"""WITH {stand_in.ctes("pages")}, p AS (SELECT * FROM fx_pages WHERE status BETWEEN 200 AND 299)
            SELECT b.site_id, b.url, arg_min(a.url, a.page_seq) AS alias_of FROM p a JOIN p b ON a.site_id = b.site_id AND a.raw_hash = b.raw_hash AND a.page_seq < b.page_seq
              AND (a.canonical IN (b.url, b.canonical) OR b.canonical IN (a.url, a.canonical)) GROUP BY 1, 2""",
        "crawl_counters": f"""WITH {stand_in.ctes("sites", "pages")}, f AS ({_FOUND.format("fx_pages")})
            SELECT s.site_id, (SELECT count(DISTINCT url) FROM f WHERE f.site_id = s.site_id) AS discovered, (SELECT count(*) FROM fx_pages p WHERE p.site_id = s.site_id) AS fetched,
              (SELECT count(DISTINCT url) FROM f WHERE f.site_id = s.site_id AND NOT allowed) AS blocked_by_robots, (SELECT count(*) FROM fx_pages p WHERE p.site_id = s.site_id AND status >= 400) AS errors,
              'stratified:' || coalesce((SELECT string_agg(w, '+' ORDER BY k) FROM (VALUES (1, 'sitemap'), (2, 'nav'), (3, 'linkgraph')) AS o(k, w) WHERE EXISTS (SELECT 1 FROM f WHERE f.site_id = s.site_id AND f.source = w)), 'none') AS strategy
            FROM fx_sites s""",
        "shell_sites": f"""WITH {stand_in.ctes("sites", "pages")} SELECT s.site_id, 'page-content' AS what, 'all ' || count(*) || ' pages repeat the answer to a path that cannot exist, and none was rendered' AS reason
            FROM fx_sites s JOIN fx_pages p ON p.site_id = s.site_id WHERE p.status BETWEEN 200 AND 299 AND s.soft404_hash IS NOT NULL AND NOT s.js_render GROUP BY s.site_id HAVING count(*) FILTER (WHERE p.raw_hash IS DISTINCT FROM s.soft404_hash) = 0""",
        "probe_fetched_at": f"""WITH {stand_in.ctes("sites", "pages", "probe")} SELECT DISTINCT b.site_id, b.url, coalesce((SELECT 'page ' || min(p.page_seq) FROM fx_pages p WHERE p.site_id = b.site_id AND b.url IN (p.url, p.final_url)), s.started_at) AS fetched_at
            FROM fx_probe b JOIN fx_sites s ON s.site_id = b.site_id""",
        "claim_assertions": rf"""WITH {stand_in.ctes("pages", "claims")}, t AS (SELECT site_id, trim(regexp_replace(lower(concat_ws(' ', raw_text, rendered_text)), '\s+', ' ', 'g')) AS body FROM fx_pages)
            SELECT c.site_id, id, kind, value, count(*) AS pages, count(*) FILTER (WHERE body <> '' AND CASE WHEN kind = 'founded_year' THEN regexp_matches(body, '{claims.FOUNDING}\D{{0,40}}' || value) ELSE contains(body, value) END) AS stating
            FROM fx_claims c JOIN t ON t.site_id = c.site_id GROUP BY 1, 2, 3, 4""",
        "source_types": f"""SELECT domain, coalesce((SELECT k.kind FROM (VALUES {_rows((d, n) for n, ds in claims.SOURCE_TYPES.items() for d in ds.split())}) AS k(known, kind) WHERE domain = known OR ends_with(domain, '.' || known)),
            CASE WHEN contains(domain, '.') AND regexp_matches(domain, '{"|".join(claims.PRESS_WORDS)}') THEN 'news' ELSE 'directory' END) AS origin_type, events FROM (SELECT {_case("event_id", _SOURCES)} AS domain, count(*) AS events FROM events GROUP BY 1) s""",
        "declared_types": f"""WITH {stand_in.ctes("pages")}, n AS (SELECT site_id, page_seq, generate_subscripts(nodes, 1) AS k, unnest(nodes).type AS name FROM fx_pages),
            s AS (SELECT site_id, page_seq, arg_min(mapped, CASE WHEN mapped IN ('product', 'article') THEN k ELSE k + 1000 END) AS chosen FROM n JOIN (VALUES {_rows(urls.DECLARED_TYPES.items())}) AS m(name, mapped) USING (name) GROUP BY 1, 2),
            r AS (SELECT p.page_type, CASE WHEN page_type = 'home' OR chosen IS NULL THEN page_type ELSE chosen END AS refined,
              CASE WHEN page_type = 'home' OR chosen IS NULL THEN type_confidence WHEN chosen = page_type THEN 0.9::DOUBLE WHEN page_type = 'other' THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM fx_pages p LEFT JOIN s ON s.site_id = p.site_id AND s.page_seq = p.page_seq)
            SELECT page_type, refined, confidence, count(*) AS pages FROM r GROUP BY 1, 2, 3""",
        "report_findings": f"SELECT site_id, id, rule_id, severity, priority, status, confidence, breadth, pages_affected, pages_examined, page_types, conditional_on FROM ({rule_sql.findings(stand_in.ctes)})",
        "report_summary": f"""WITH {stand_in.ctes("sites")}, f AS ({rule_sql.findings(stand_in.ctes)}) SELECT s.site_id, count(*) FILTER (WHERE status <> 'proactive') AS total_findings,
            {", ".join(f"count(*) FILTER (WHERE status <> 'proactive' AND severity = '{v}') AS {v}" for v in compose.SEVERITIES)}, count(*) FILTER (WHERE status = 'proactive') AS proactive
            FROM fx_sites s LEFT JOIN f ON f.site_id = s.site_id GROUP BY s.site_id""",
        "header_directives": f"""WITH rows AS (SELECT o_orderkey, {_HEADER} AS x_robots FROM orders), {rule_sql.header_tokens("SELECT * FROM rows", "o_orderkey")} SELECT r.o_orderkey, """
            + ", ".join(f"coalesce(string_agg(DISTINCT token, ',' ORDER BY token) FILTER (WHERE scope IS NULL OR scope IN {_WORDS(scopes)}), '') AS {name}" for scopes, name in ((R.INDEX_SCOPES, "indexing"), (R.SNIPPET_SCOPES, "snippets")))
            + " FROM rows r LEFT JOIN tokens t ON t.o_orderkey = r.o_orderkey GROUP BY r.o_orderkey",
        "robots_decisions": f"""WITH {stand_in.ctes("pages", "groups", "agents")}, {rule_sql.decisions("SELECT site_id, agent FROM fx_agents")}
            SELECT site_id, agent, count(*) FILTER (WHERE allowed) AS open, count(*) FILTER (WHERE NOT allowed) AS closed FROM decided GROUP BY 1, 2""",
        "document_problems": stand_in.DOCUMENT_SQL,
        "robots_matches": f"""WITH {stand_in.ctes("pages", "groups", "agents")}, {rule_sql.decisions(f"SELECT site_id, agent FROM fx_agents WHERE agent IN {_WORDS(R.RETRIEVAL_AGENTS)}")}
            SELECT DISTINCT h.site_id, h.agent, h.path, h.allow, h.pattern FROM held h WHERE h.pattern IS NOT NULL""",
    }
    judged = {"rule_" + k.lower().replace("-", "_"): v for k, v in rule_sql.oracle(stand_in.ctes).items()}
    by_rule = {k: f"SELECT * FROM ({v})" for k, v in judged.items()}
    each = " UNION ALL ".join(f"SELECT site_id, rule_id, outcome FROM ({sql})" for sql in by_rule.values())
    out["report_gaps"] = f"SELECT DISTINCT site_id, rule_id, reason FROM ({each}) JOIN (VALUES {_rows(compose.NEEDS.items())}) AS n(rule_id, reason) USING (rule_id) WHERE outcome = 'not_assessed'"
    faults = {1: "the summary does not count its findings", 2: "the counts by severity do not add up", 3: "a rule has no outcome", 4: "a rule that was not assessed gives no reason"}
    out["report_problems"] = f"""WITH o AS MATERIALIZED (SELECT DISTINCT * FROM ({each})), s AS (SELECT 'c' || CAST(c_custkey AS STRING) AS site_id, c_custkey % 5 AS fault FROM customer)
        SELECT s.site_id, problem FROM s JOIN (VALUES {_rows(faults.items())}) AS f(fault, problem) USING (fault)
        WHERE fault < 3 OR EXISTS (SELECT 1 FROM o WHERE o.site_id = s.site_id AND outcome = CASE fault WHEN 3 THEN 'passed' ELSE 'not_assessed' END)"""
    return out | judged
