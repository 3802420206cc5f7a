"""Evidence made of the given tables, by one SELECT for each evidence table that Spark and DuckDB both run.

A site is a customer, its pages are the customer's orders, what stands on a page is the order's lines, and what was probed or said
elsewhere are the events of the user with the customer's number. Rules over it do their whole work on tables of any size; what
they find says nothing about any real site. Facts that the tables lack are derived from keys, so that every kind of site
occurs: shops, journals and manuals by market segment, policies by customer number, markup and habits by nation.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftscan.functions import robots
from weftscan.sources.bundle import TABLES, Evidence
from weftscan.sources.shared import landed

GIVEN = ["customer", "orders", "lineitem", "events"]


@dataclass(frozen=True)
class Dialect:
    """How an engine writes nested values and ordered lists."""

    name: str

    def array(self, *values: str) -> str:
        return f"array({', '.join(values)})" if self.name == "spark" else f"[{', '.join(values)}]"

    def no_strings(self) -> str:
        return "CAST(array() AS ARRAY<STRING>)" if self.name == "spark" else "CAST([] AS VARCHAR[])"

    def struct(self, **values: str) -> str:
        if self.name == "spark":
            return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")"
        return "{" + ", ".join(f"'{k}': {v}" for k, v in values.items()) + "}"

    def map(self, *pairs: tuple[str, str]) -> str:
        if self.name == "spark":
            return f"map({', '.join(f'{k}, {v}' for k, v in pairs)})" if pairs else "CAST(map() AS MAP<STRING, STRING>)"
        return "MAP {" + ", ".join(f"{k}: {v}" for k, v in pairs) + "}" if pairs else "CAST(MAP {} AS MAP(VARCHAR, VARCHAR))"

    def ordered(self, value: str, order: str) -> str:
        if self.name == "spark":
            compare = "(a, b) -> CASE WHEN a.k < b.k THEN -1 WHEN a.k > b.k THEN 1 ELSE 0 END"
            return f"transform(array_sort(collect_list(named_struct('k', {order}, 'v', {value})), {compare}), x -> x.v)"
        return f"list({value} ORDER BY {order})"

    def head(self, rows: str, n: int) -> str:
        return f"slice({rows}, 1, {n})" if self.name == "spark" else f"({rows})[1:{n}]"


SPARK, DUCKDB = Dialect("spark"), Dialect("duckdb")

_SITE = "'c' || CAST({0} AS STRING)"
_DOMAIN = "'c' || CAST({0} AS STRING) || '.test'"
#: Of some customers the site is not the domain's own.
_HOST = "CASE WHEN {0} % 6 = 2 THEN 'shop.c' ELSE 'c' END || CAST({0} AS STRING) || '.test'"
_ORIGIN = "'https://' || " + _HOST
_CODE = "CASE WHEN {0} % 50 = 3 THEN 200 WHEN {0} % 10 < 6 THEN 200 WHEN {0} % 10 = 6 THEN 404 WHEN {0} % 10 = 7 THEN 503 WHEN {0} % 10 = 8 THEN 429 END"
_REASON = "CASE WHEN {0} % 50 = 3 THEN 'not_plausibly_robots' WHEN {0} % 10 < 6 THEN 'ok' WHEN {0} % 10 = 6 THEN 'absent_4xx' WHEN {0} % 10 = 7 THEN 'server_error' WHEN {0} % 10 = 8 THEN 'rate_limited' ELSE 'unreachable' END"
_MARKED = "(l_partkey + l_linenumber) % 40"


def _lines(d: Dialect) -> str:
    """What stands on each order's page: a node and a heading for each line, in order."""
    kind = f"CASE {_MARKED} WHEN 0 THEN 'Organization' WHEN 1 THEN 'Product' WHEN 2 THEN 'Product' WHEN 3 THEN '' WHEN 4 THEN 'NewsArticle' WHEN 5 THEN 'Person' WHEN 6 THEN 'Offer' WHEN 7 THEN 'Corporation' WHEN 8 THEN 'Store' ELSE 'WebPage' END"
    profile = "CASE l_linenumber % 3 WHEN 0 THEN 'https://x.com/shopify' WHEN 1 THEN 'https://x.com/own |  https://profiles.test/' || CAST(l_partkey AS STRING) ELSE 'no address' END"
    price = "CAST(l_partkey % 90 + 1 AS STRING)"
    name = "'Part ' || CAST(l_partkey % 50 AS STRING)"
    vals = f"CASE {_MARKED} WHEN 0 THEN {d.map(("'name'", name), ("'sameAs'", profile))} WHEN 1 THEN {d.map(("'name'", name), ("'offers.price'", price))} WHEN 2 THEN {d.map(("'name'", name), ("'offers.price'", price))} WHEN 3 THEN {d.map()} WHEN 6 THEN {d.map(("'price'", "'1,' || " + price))} WHEN 8 THEN {d.map(("'name'", name), ("'sameAs'", profile))} ELSE {d.map(("'name'", name))} END"
    names = f"CASE {_MARKED} WHEN 0 THEN {d.array("'name'", "'sameAs'")} WHEN 1 THEN {d.array("'name'", "'offers.price'")} WHEN 2 THEN {d.array("'name'", "'offers.price'")} WHEN 3 THEN {d.no_strings()} WHEN 6 THEN {d.array("'price'")} WHEN 8 THEN {d.array("'name'", "'sameAs'")} ELSE {d.array("'name'")} END"
    node = d.struct(type=kind, valid=f"{_MARKED} <> 3", fields=names, vals=vals, contradicts=f"{_MARKED} = 2 AND l_discount > 5e-2")
    heading = d.struct(level="CAST(1 + l_linenumber % 6 AS INT)", text="'Part ' || CAST(l_partkey % 50 AS STRING)")
    order = "l_linenumber * 1e6 + l_extendedprice"
    if d.name == "spark":
        # five numbers of a line are dealt out and put in order; nodes and headings are made of them afterwards
        made = lambda value: f"transform(lines, x -> {re.sub(r'\b(l_partkey|l_linenumber|l_discount)\b', r'x.\1', value.replace(_MARKED, 'x.marked'))})"
        return f"""SELECT l_orderkey, n, {made(node)} AS nodes, {made(heading)} AS headings
      FROM (SELECT l_orderkey, count(*) AS n, sort_array(collect_list(named_struct('k', {order}, 'l_linenumber', l_linenumber, 'l_partkey', l_partkey, 'l_discount', l_discount, 'marked', {_MARKED}))) AS lines FROM lineitem GROUP BY l_orderkey)"""
    return f"""SELECT l_orderkey, count(*) AS n, {d.ordered(node, order)} AS nodes, {d.ordered(heading, order)} AS headings FROM lineitem GROUP BY l_orderkey"""


def _orders(d: Dialect) -> str:
    """Orders with what their customers decide about pages, the kind of page and its address."""
    kind = """CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 'home' WHEN c_mktsegment IN ('FURNITURE', 'MACHINERY') AND o_orderkey % 6 > 0 THEN 'product' WHEN c_mktsegment = 'BUILDING' AND o_orderkey % 6 > 0 THEN 'article'
      WHEN c_mktsegment = 'AUTOMOBILE' AND o_orderkey % 6 > 0 THEN 'doc' WHEN substr(o_orderpriority, 1, 1) = '2' THEN 'product' WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'article' WHEN o_orderkey % 2 = 0 THEN 'about' ELSE 'other' END"""
    return f"""SELECT k.*, CASE kind WHEN 'home' THEN '/' WHEN 'product' THEN '/shop/' || CAST(o_orderkey % 3 AS STRING) || '/' || CAST(o_orderkey AS STRING) WHEN 'article' THEN '/blog/' || CAST(o_orderkey AS STRING) WHEN 'doc' THEN '/docs/en/' || CAST(o_orderkey AS STRING) || '/view'
      ELSE '/' || kind || '/' || CAST(o_orderkey AS STRING) || CASE WHEN o_orderkey % 4 = 0 THEN '?page=2' ELSE '' END END AS path
    FROM (SELECT o.*, c.c_nationkey AS nation, {_ORIGIN.format("o_custkey")} AS origin, CAST(o_orderkey - f.first AS INT) AS page_seq, {kind} AS kind
      FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN (SELECT o_custkey AS k, min(o_orderkey) AS first FROM orders GROUP BY o_custkey) f ON f.k = o.o_custkey) k"""


def selects(d: Dialect) -> dict[str, str]:
    """A SELECT over the given tables for each table of ``Evidence`` (and what several of them are made of, under names of their own)."""
    site, origin, host = _SITE.format("c_custkey"), _ORIGIN.format("c_custkey"), _DOMAIN.format("c_custkey")
    can_render = "o_custkey % 4 <> 0"
    seen = f"({can_render} AND o_orderkey % 9 <> 0 AND status BETWEEN 200 AND 299)"
    scripted, thin = "(nation % 5 = 3 AND kind <> 'doc')", "o_custkey % 8 = 4"
    none = "CAST(NULL AS STRING)"
    pages = f"""SELECT {_SITE.format("o_custkey")} AS site_id, page_seq, origin || path AS url, origin || path AS final_url, status, CASE WHEN o_orderkey % 23 = 0 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type,
      kind AS page_type, (55 + 5 * (o_orderkey % 10)) / 100e0 AS type_confidence, canonical, canonical = origin || path AS canonical_self,
      CASE WHEN nation % 6 = 1 AND kind IN ('article', 'product') THEN {d.array("' NoIndex'")} WHEN o_orderkey % 13 = 0 THEN {d.array("'noindex'", "'nofollow'")} WHEN o_orderkey % 29 = 1 THEN NULL ELSE {d.no_strings()} END AS meta_robots,
      CASE WHEN nation % 7 = 2 AND kind <> 'home' THEN 'otherbot: noindex, googlebot: max-snippet: 0' WHEN o_orderkey % 17 = 3 THEN 'NoSnippet' WHEN o_orderkey % 17 = 4 THEN 'googlebot: noarchive, perplexitybot: none' END AS x_robots,
      CASE WHEN nation % 5 = 0 THEN 'de-DE' WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'en' END AS lang, raw_len, CAST(o_orderkey % 3 * 10 AS INT) AS hidden_len,
      CASE WHEN o_custkey % 16 = 4 THEN 'same' ELSE 'h' || CAST(o_orderkey % 50 AS STRING) END AS raw_hash, seen AS rendered, rendered_len, CASE WHEN rendered_len > 0 THEN floor(1e3 * (rendered_len - raw_len) / rendered_len) / 1e3 END AS delta,
      CAST(floor(o_totalprice / 150e0) AS INT) AS words, CAST(CASE WHEN nation % 3 = 0 THEN 1 ELSE coalesce(n, 0) END AS INT) AS n_headings, CAST(CASE WHEN nation % 4 = 1 THEN 0 ELSE coalesce(n, 0) % 3 END AS INT) AS n_dates,
      CASE WHEN o_orderkey % 6 = 0 AND nation % 4 <> 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date_modified, CASE WHEN nation % 4 NOT IN (1, 2) THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN o_orderkey % 5 = 0 THEN '' END AS date_published,
      CASE WHEN o_orderkey % 19 <> 0 THEN o_totalprice / CASE WHEN nation % 2 = 0 THEN 1e2 ELSE 3e2 END END AS ttfb, CASE WHEN o_orderkey % 4 <> 0 THEN 20e0 END AS connect, o_custkey % 10 = 7 AND kind = 'home' AS microdata,
      CASE WHEN o_orderkey % 31 = 0 THEN {none} WHEN nation % 3 = 1 AND kind = 'product' THEN 'no price' WHEN o_orderkey % 2 = 0 THEN 'now $' || CAST(o_orderkey % 90 AS STRING) || ' from Customer  ' || CAST(o_custkey AS STRING) ELSE 'now $' || CAST(o_orderkey % 90 AS STRING) END AS raw_text,
      CASE WHEN seen THEN 'now $' || CAST(o_orderkey % 90 AS STRING) || ', a shop since ' || CAST(1900 + nation + o_orderkey % 3 AS STRING) END AS rendered_text,
      CASE WHEN o_custkey % 8 = 6 THEN NULL ELSE nodes END AS nodes, headings
    FROM (SELECT *, {scripted} AND seen AS built, CASE WHEN seen THEN CAST(CASE WHEN {scripted} THEN 2000 ELSE raw_len + 50 END AS INT) END AS rendered_len
      FROM (SELECT *, {seen} AS seen, CAST(CASE WHEN {scripted} OR {thin} THEN floor(o_totalprice / 5e3) ELSE 300 + floor(o_totalprice / 5e2) END AS INT) AS raw_len,
          CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN nation % 4 = 0 AND o_orderkey % 5 < 4 THEN origin || '/' ELSE origin || path END AS canonical
        FROM (SELECT p.*, l.n, l.nodes, l.headings, CAST(CASE WHEN o_orderstatus = 'P' AND o_orderkey % 7 = 0 THEN 404 WHEN o_orderstatus = 'P' AND o_orderkey % 7 = 1 THEN 500 WHEN o_orderstatus = 'O' AND o_orderkey % 11 = 0 THEN NULL ELSE 200 END AS INT) AS status
          FROM order_pages p LEFT JOIN order_lines l ON l.l_orderkey = p.o_orderkey)))"""
    star = f"""CASE c_nationkey % 6 WHEN 0 THEN {d.array("'/'")} WHEN 1 THEN {d.array("'/private'", "'/shop/*/1'", "'/*.pdf$'")} WHEN 2 THEN {d.array("'/blog/1'", "'/*?page='")} ELSE {d.no_strings()} END"""
    group = lambda seq, agent, allow, disallow, where: f"SELECT {site} AS site_id, CAST({seq} AS INT) AS seq, '{agent}' AS user_agent, {allow} AS allow, {disallow} AS disallow FROM customer WHERE {_CODE.format('c_custkey')} = 200 AND c_custkey % 50 <> 3 AND {where}"
    named = {"Googlebot": ("c_custkey % 5 = 0", "'allowed'"), "PerplexityBot": ("c_custkey % 7 = 0", "'disallowed'"), "Bingbot": ("c_custkey % 11 = 0", "'disallowed'")}
    verdict = f"CASE WHEN {_REASON.format('c_custkey')} IN ('unreachable', 'server_error', 'rate_limited') THEN 'disallowed' WHEN {_REASON.format('c_custkey')} <> 'ok' THEN 'unspecified' " + " ".join(f"WHEN agent = '{a}' AND {w} THEN {v}" for a, (w, v) in named.items())
    verdict += " WHEN c_nationkey % 6 = 0 THEN 'disallowed' WHEN c_nationkey % 6 < 3 THEN 'allowed' ELSE 'unspecified' END"
    user = _SITE.format("user_id")
    agent = "CASE event_type WHEN 'view' THEN 'browser-ua' WHEN 'click' THEN 'GPTBot' WHEN 'error' THEN 'CCBot' WHEN 'purchase' THEN 'Googlebot' ELSE 'ClaudeBot' END"
    worth = "CASE l_returnflag WHEN 'R' THEN 'product_name' WHEN 'A' THEN 'legal_name' ELSE CASE WHEN l_linenumber < 4 THEN 'founded_year' ELSE 'tagline' END END"
    value = "CASE l_returnflag WHEN 'R' THEN 'part ' || CAST(l_partkey % 7 AS STRING) WHEN 'A' THEN CASE l_partkey % 4 WHEN 0 THEN 'shop' WHEN 1 THEN 'fern online ltd' WHEN 2 THEN 'fern and moss' ELSE 'cloverfield' END ELSE CAST(1950 + l_partkey % 9 AS STRING) END"
    return {
        "order_lines": _lines(d),
        "order_pages": _orders(d),
        "sites": f"""SELECT {site} AS site_id, CASE WHEN c_custkey % 15 = 8 THEN NULL ELSE {host} END AS domain, {origin} AS origin, '2024-05-01T00:00:00Z' AS started_at, c_custkey % 10 <> 9 OR c_custkey % 50 = 3 AS robots_fetched, CAST({_CODE.format("c_custkey")} AS INT) AS robots_status,
          {_REASON.format("c_custkey")} = 'ok' AS robots_ok, {_REASON.format("c_custkey")} AS robots_reason, c_custkey % 4 <> 0 AS js_render, c_custkey % 3 <> 1 AS egress, c_custkey % 5 <> 2 AS attempted, CASE WHEN c_custkey % 16 = 4 THEN 'same' END AS soft404_hash FROM customer""",
        "pages": pages,
        "groups": " UNION ALL ".join([
            group(0, "*", f"CASE WHEN c_nationkey % 12 = 0 THEN {d.array("'/blog/'")} ELSE {d.no_strings()} END", star, "c_nationkey % 6 < 3"), group(1, "Googlebot", d.array("'/'"), d.no_strings(), named["Googlebot"][0]),
            group(2, "PerplexityBot/1.0", d.no_strings(), d.array("'/'"), named["PerplexityBot"][0]), group(3, " bingbot", d.array("'/shop/*/1'"), d.array("'/'", "'/docs/$'"), named["Bingbot"][0]),
        ]),
        "agents": f"SELECT {site} AS site_id, agent, {verdict} AS verdict FROM customer CROSS JOIN (VALUES {', '.join(f"('{a}')" for a in robots.AI_AGENTS)}) AS a(agent)",
        "declared": f"SELECT {site} AS site_id, CAST(0 AS INT) AS seq, {origin} || '/s.xml' AS url FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT {site}, CAST(1 AS INT), {origin} || '/t.xml' FROM customer WHERE c_custkey % 9 = 0",
        "sitemaps": f"""SELECT {site} AS site_id, {origin} || '/s.xml' AS url, CAST(CASE c_nationkey % 5 WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 2 THEN 500 WHEN 3 THEN 403 ELSE 404 END AS INT) AS status, c_nationkey % 5 = 0 AS parse_ok FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0
          UNION ALL SELECT {site}, {origin} || '/t.xml', CAST(200 AS INT), c_custkey % 2 = 0 FROM customer WHERE c_custkey % 9 = 0""",
        "probe": f"""SELECT {user} AS site_id, {_ORIGIN.format("user_id")} || CASE WHEN odd = 0 THEN '/' ELSE '/p' END AS url, agent, CAST(CASE WHEN agent = 'browser-ua' THEN CASE WHEN least_value < 1 THEN 503 ELSE 200 END WHEN most > 12e1 THEN 403 WHEN most > 11e1 THEN NULL ELSE 200 END AS INT) AS status
          FROM (SELECT user_id, event_id % 2 AS odd, {agent} AS agent, min(value) AS least_value, max(value) AS most FROM events GROUP BY user_id, event_id % 2, {agent}) e""",
        "well_known": f"SELECT {user} AS site_id, '/llms.txt' AS path, CAST(CASE WHEN n % 4 = 0 THEN NULL WHEN n % 2 = 0 THEN 404 ELSE 200 END AS INT) AS status, n % 2 = 1 AS present FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY user_id) e",
        "claims": f"""SELECT {site} AS site_id, CAST(1 AS INT) AS seq, 'C-001' AS id, 'legal_name' AS kind, CASE WHEN c_custkey % 9 = 4 THEN lower(c_name) ELSE 'customer ' || CAST(c_custkey AS STRING) END AS value,
          CASE c_nationkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, CASE c_nationkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS ambiguity FROM customer WHERE c_custkey % 7 <> 6
          UNION ALL SELECT {site}, CAST(2 AS INT), 'C-002', 'founded_year', CAST(1900 + c_nationkey AS STRING), CASE c_nationkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END, CASE WHEN c_custkey % 9 = 1 THEN 'high' ELSE 'low' END FROM customer WHERE c_custkey % 4 <> 3
          UNION ALL SELECT {site}, CAST(3 + c_custkey % 3 AS INT), 'C-003', 'product_name', 'part ' || CAST(c_custkey % 40 AS STRING), 'medium', 'low' FROM customer WHERE c_custkey % 2 = 0""",
        "hits": f"""SELECT {user} AS site_id, CAST(event_id AS INT) AS seq, CASE WHEN event_id % 4 = 0 THEN 'C-001' ELSE 'C-002' END AS claim_id, CASE event_id % 3 WHEN 0 THEN 'wikidata.org' WHEN 1 THEN 'news.test' ELSE 'en.wikipedia.org' END AS origin,
          'inception ' || CAST(1900 + event_id % 25 AS STRING) AS asserted, value < 9e1 AS matches FROM events WHERE event_type = 'click' AND user_id % 7 <> 3""",
        "candidates": f"""SELECT site_id, CAST(1 AS INT) AS seq, 'CC-' || substr(kind, 1, 2) || '-' || value AS id, kind, value AS value_raw, value AS value_normalized, 'https://' || site_id || '.test/' AS source_url, 'text' AS locator, CASE WHEN marked = 1 THEN 'jsonld' ELSE 'visible_text' END AS extraction_method, CAST(n AS INT) AS observed_count
          FROM (SELECT {_SITE.format("o_custkey")} AS site_id, {worth} AS kind, {value} AS value, min(l_linenumber) AS marked, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, {worth}, {value}) c""",
        "edges": f"""SELECT {_SITE.format("o.o_custkey")} AS site_id, h.url AS src, o.origin || o.path AS dst FROM order_pages o JOIN page_hubs h ON h.o_custkey = o.o_custkey AND h.hub = o.o_orderkey % 4 JOIN order_lines l ON l.l_orderkey = o.o_orderkey WHERE l.n >= 3 AND h.url <> o.origin || o.path
          UNION SELECT {_SITE.format("a.o_custkey")}, a.url, b.url FROM page_hubs a JOIN page_hubs b ON b.o_custkey = a.o_custkey AND b.hub = (a.hub + 1) % 4 WHERE a.url <> b.url""",
        "page_hubs": "SELECT o_custkey, o_orderkey % 4 AS hub, min(origin || path) AS url FROM order_pages GROUP BY o_custkey, o_orderkey % 4",
    }


#: What the selects of others read, in order.
_PARTS = {"pages": ["order_lines", "order_pages"], "edges": ["order_lines", "order_pages", "page_hubs"]}


def _select(spark: SparkSession, frames: dict[str, DataFrame], name: str, texts: dict[str, str]) -> DataFrame:
    """The rows of one SELECT; the tables are views for as long as it is analysed."""
    parts = ", ".join(f"{p} AS ({texts[p]})" for p in _PARTS.get(name, []))
    text = f"WITH {parts} SELECT * FROM ({texts[name]})" if parts else texts[name]
    names = {t: f"given_{t}_{uuid.uuid4().hex[:8]}" for t in GIVEN}
    for t, df in frames.items():
        df.createOrReplaceTempView(names[t])
    try:
        return spark.sql(re.sub(r"\b(FROM|JOIN) (customer|orders|lineitem|events)\b", lambda m: f"{m[1]} {names[m[2]]}", text))
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)


def evidence(spark: SparkSession, sf_dir: str) -> Evidence:
    """The evidence of the given tables below ``sf_dir``, with the columns and types of ``TABLES``."""
    texts, out = selects(SPARK), {}
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in GIVEN}
    for f in fields(Evidence):
        rows = _select(spark, frames, f.name, texts)
        out[f.name] = rows.select(*[F.col(c.name).cast(c.dataType).alias(c.name) for c in StructType.fromDDL(TABLES[f.name])])
    return Evidence(**out)


def landed_evidence(spark: SparkSession, sf_dir: str, names: list[str] | None = None, seen: Callable[[DataFrame], DataFrame] = lambda pages: pages) -> Evidence:
    """The same, each table (or those of ``names``, which are read again and again) written once; others are made where they are read.

    ``seen`` is what is written of the pages, such as ``rules.with_signals``.
    """
    made = vars(evidence(spark, sf_dir))
    # pages of a site stand together, so that what counts them by site has little to shuffle; Spark cuts sites that are too large for a task
    made["pages"] = seen(made["pages"]).hint("rebalance", "site_id")
    return Evidence(**{name: landed(rows) if names is None or name in names else rows for name, rows in made.items()})


def ctes(*names: str) -> str:
    """The same tables as common table expressions fx_<name> for DuckDB, without WITH."""
    texts = selects(DUCKDB)
    needed = list(dict.fromkeys(p for n in names for p in _PARTS.get(n, [])))
    return ",\n".join([f"{p} AS ({texts[p]})" for p in needed] + [f"fx_{n} AS MATERIALIZED ({texts[n]})" for n in names])


#: What a customer's document has to be; the data breaks most of these rules somewhere.
DOCUMENT_SCHEMA = {
    "type": "object",
    "required": ["customer", "name", "segment", "balance", "orders"],
    "additionalProperties": False,
    "properties": {
        "customer": {"type": "integer", "minimum": 0},
        "name": {"type": "string", "pattern": "^Customer#[0-9]*[0-8]$"},
        "segment": {"enum": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]},
        "balance": {"type": "number", "exclusiveMinimum": 0},
        "orders": {"type": "array", "maxItems": 12, "items": {"$ref": "#/$defs/order"}},
        "notes": {"type": "object", "additionalProperties": {"type": "string", "maxLength": 5}},
    },
    "$defs": {
        "order": {
            "type": "object",
            "required": ["key", "status"],
            "properties": {"key": {"type": "integer"}, "status": {"enum": ["F", "O"]}, "total": {"type": ["number", "null"], "maximum": 450000}},
        }
    },
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, document): a JSON document for each customer with its orders, in order of key."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = F.col("o_orderkey")
    total = F.when(key % 13 == 0, '"much"').when(key % 17 == 0, "null").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    one = F.concat(F.lit('{"key":'), key.cast("string"), F.lit(',"status":"'), F.col("o_orderstatus"), F.lit('","total":'), total, F.lit("}"))
    orders = read("orders").select("o_custkey", key, one.alias("one")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "one"))), lambda x: x["one"]), ",").alias("orders"))
    c = F.col("c_custkey")
    name = F.when(c % 11 != 0, F.concat(F.lit(',"name":"'), F.col("c_name"), F.lit('"'))).otherwise("")
    more = F.when(c % 7 == 0, ',"rating":1').when(c % 7 == 1, ',"notes":{"a":"short","b":"too long","c":3}').otherwise("")
    text = F.concat(F.lit('{"customer":'), c.cast("string"), name, F.lit(',"segment":"'), F.col("c_mktsegment"), F.lit('","balance":'), F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit(',"orders":['), F.coalesce("orders", F.lit("")), F.lit("]"), more, F.when(c % 101 == 5, "").otherwise("}"))
    return read("customer").join(orders, "c_custkey", "left").select("c_custkey", text.alias("document"))


DOCUMENT_SQL = """
WITH c AS (SELECT * FROM customer WHERE c_custkey % 101 <> 5), o AS (SELECT o.*, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders o JOIN c ON c_custkey = o_custkey)
SELECT c_custkey, '$' AS path, 'is not JSON' AS problem FROM customer WHERE c_custkey % 101 = 5
UNION ALL SELECT c_custkey, '$.name', 'is missing' FROM c WHERE c_custkey % 11 = 0
UNION ALL SELECT c_custkey, '$.name', 'does not match ^Customer#[0-9]*[0-8]$' FROM c WHERE c_custkey % 11 <> 0 AND ends_with(c_name, '9')
UNION ALL SELECT c_custkey, '$.segment', 'is none of AUTOMOBILE, BUILDING, FURNITURE, HOUSEHOLD' FROM c WHERE c_mktsegment = 'MACHINERY'
UNION ALL SELECT c_custkey, '$.balance', 'is not more than 0' FROM c WHERE c_acctbal <= 0
UNION ALL SELECT o_custkey, '$.orders', 'has more elements than 12' FROM o GROUP BY o_custkey HAVING count(*) > 12
UNION ALL SELECT o_custkey, '$.orders[' || i || '].status', 'is none of F, O' FROM o WHERE o_orderstatus = 'P'
UNION ALL SELECT o_custkey, '$.orders[' || i || '].total', 'is not of type number or null' FROM o WHERE o_orderkey % 13 = 0
UNION ALL SELECT o_custkey, '$.orders[' || i || '].total', 'is more than 450000' FROM o WHERE o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND o_totalprice > 450000
UNION ALL SELECT c_custkey, '$.rating', 'is not expected' FROM c WHERE c_custkey % 7 = 0
UNION ALL SELECT c_custkey, '$.notes.b', 'is longer than 5' FROM c WHERE c_custkey % 7 = 1
UNION ALL SELECT c_custkey, '$.notes.c', 'is not of type string' FROM c WHERE c_custkey % 7 = 1
"""
