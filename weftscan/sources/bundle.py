"""Evidence bundles: one nested JSON document for each site, read with a fixed schema."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The schema of a bundle, version 1.
HEADING = "struct<level: int, text: string>"
NODE = "struct<type: string, valid: boolean, errors: array<string>, fields_present: array<string>, `values`: map<string, string>, contradicts_visible_text: boolean>"
PAGE = f"""struct<url: string, final_url: string, status: int, redirect_chain: array<string>, content_type: string, fetched_at: string,
  headers: struct<x_robots_tag: string, last_modified: string, cache_control: string>, meta_robots: array<string>,
  canonical: string, canonical_self: boolean, lang: string, hreflang: array<string>, page_type: string, page_type_confidence: double,
  raw: struct<bytes: bigint, text_len: int, hidden_text_len: int, text_hash: string, text_path: string, headings: array<{HEADING}>,
    anchors: array<struct<id: string, heading_text: string>>, links: array<struct<href: string, rel: string, anchor: string, internal: boolean>>,
    images: array<struct<src: string, alt: string, text_likely: boolean>>, tables: int, iframes: int, forms: int>,
  rendered: struct<available: boolean, text_len: int, text_hash: string, text_path: string, headings: array<{HEADING}>, delta_ratio: double>,
  jsonld: array<{NODE}>, microdata_or_rdfa: boolean,
  text: struct<visible_excerpt: string, word_count: int, boilerplate_ratio: double, longest_block_words: int, heading_density_per_1k: double>,
  dates: struct<visible_dates: array<string>, schema_date_modified: string, schema_date_published: string, http_last_modified: string>,
  obstructions: array<struct<kind: string, evidence: string>>,
  timing: struct<ttfb_ms: double, connect_ms: double, fetch_ms: double, render_ms: double>,
  provenance: struct<layer: string, method: string>>""".replace("\n", " ")
BUNDLE = f"""schema_version string,
  site struct<input: string, resolved_origin: string, registrable_domain: string>,
  run_context struct<started_at: string, completed_at: string, capabilities: struct<js_render: boolean, egress: boolean>,
    degradations: array<struct<what: string, reason: string>>>,
  robots struct<fetched: boolean, url: string, status: int, parse_ok: boolean, parse_reason: string,
    `groups`: array<struct<user_agent: string, allow: array<string>, disallow: array<string>, crawl_delay: double>>,
    ai_agents: map<string, string>, sitemaps: array<string>>,
  sitemaps array<struct<url: string, status: int, url_count: int, lastmod_present_ratio: double, parse_ok: boolean>>,
  pages array<{PAGE}>,
  link_graph struct<edges: array<array<string>>, orphans: array<string>, max_depth_from_home: int>,
  claim_candidates array<struct<id: string, kind: string, value_raw: string, value_normalized: string, source_url: string, locator: string,
    extraction_method: string, observed_count: int>>,
  canonical_claims array<struct<id: string, from_candidates: array<string>, kind: string, value_normalized: string,
    first_party_confidence: string, entity_ambiguity: string>>,
  external struct<attempted: boolean, method: string, frontier_size: int, truncated: boolean,
    origins: array<struct<registrable_domain: string, source_type: string, urls: array<string>, syndication_cluster: string, brand_owned: boolean>>,
    hits: array<struct<claim_id: string, origin: string, url: string, asserted_value: string, matches_current: boolean, retrieved_at: string>>>,
  ua_probe array<struct<url: string, user_agent: string, status: int, text_len: int, text_hash: string>>,
  discovery struct<soft_404: struct<detected: boolean, baseline_text_hash: string, probe_paths: array<string>>, collapsed_duplicate_text: int>,
  well_known array<struct<path: string, status: int, present: boolean, content_type: string>>,
  errors array<struct<url: string, stage: string, message: string>>""".replace("\n", " ")

_NODES = "array<struct<type:string,valid:boolean,fields:array<string>,vals:map<string,string>,contradicts:boolean>>"
#: The columns of the tables of ``Evidence``.
TABLES = {
    "sites": "site_id string, domain string, origin string, started_at string, robots_fetched boolean, robots_status int, robots_ok boolean, robots_reason string, js_render boolean, egress boolean, attempted boolean, soft404_hash string",
    "pages": f"""site_id string, page_seq int, url string, final_url string, status int, content_type string, page_type string, type_confidence double, canonical string,
        canonical_self boolean, meta_robots array<string>, x_robots string, lang string, raw_len int, hidden_len int, raw_hash string, rendered boolean, rendered_len int,
        delta double, words int, n_headings int, n_dates int, date_modified string, date_published string, ttfb double, connect double, microdata boolean,
        raw_text string, rendered_text string, nodes {_NODES}, headings array<struct<level:int,text:string>>""",
    "groups": "site_id string, seq int, user_agent string, allow array<string>, disallow array<string>",
    "agents": "site_id string, agent string, verdict string",
    "declared": "site_id string, seq int, url string",
    "sitemaps": "site_id string, url string, status int, parse_ok boolean",
    "probe": "site_id string, url string, agent string, status int",
    "well_known": "site_id string, path string, status int, present boolean",
    "claims": "site_id string, seq int, id string, kind string, value string, confidence string, ambiguity string",
    "hits": "site_id string, seq int, claim_id string, origin string, asserted string, matches boolean",
    "candidates": "site_id string, seq int, id string, kind string, value_raw string, value_normalized string, source_url string, locator string, extraction_method string, observed_count int",
    "edges": "site_id string, src string, dst string",
}


@dataclass
class Evidence:
    """The child tables of bundles, all keyed by site_id; positions keep the order of the document."""

    sites: DataFrame
    pages: DataFrame
    groups: DataFrame
    agents: DataFrame
    declared: DataFrame
    sitemaps: DataFrame
    probe: DataFrame
    well_known: DataFrame
    claims: DataFrame
    hits: DataFrame
    candidates: DataFrame
    edges: DataFrame

    def create_views(self, prefix: str = "") -> None:
        """Temporary views of all tables, for queries in SQL."""
        for f in fields(self):
            getattr(self, f.name).createOrReplaceTempView(prefix + f.name)


def read_bundles(spark: SparkSession, path: str, text_dir: str | None = None, lines: bool = False) -> DataFrame:
    """Bundles below ``path`` with a site_id (the resolved origin, else the input), one a file or one a line."""
    raw = spark.read.schema(BUNDLE).option("multiLine", not lines).json(path)
    return raw.withColumn("site_id", F.coalesce("site.resolved_origin", "site.input"))


def read_page_texts(spark: SparkSession, path: str) -> DataFrame:
    """(text_path, text) of the extracted-text files below ``path``; the path is relative to the bundle."""
    files = spark.read.option("wholetext", True).text(path).withColumn("_file", F.input_file_name())
    return files.select(F.concat(F.lit("pages/"), F.regexp_extract("_file", r"([^/]+)$", 1)).alias("text_path"), F.col("value").alias("text"))


def schema_violations(bundles: DataFrame) -> DataFrame:
    """(site_id, path, problem) for what the reading schema cannot refuse: versions, enumerations, ranges, missing parts."""
    pages = bundles.select("site_id", F.posexplode("pages").alias("i", "p"))
    at = lambda field: F.format_string(f"pages[%d].{field}", F.col("i"))
    top = [
        (F.col("schema_version").isNull() | (F.split("schema_version", r"\.")[0] != "1"), "schema_version", "unsupported version"),
        (F.col("robots").isNull(), "robots", "missing"),
        (~F.col("robots.parse_reason").isin("ok", "not_plausibly_robots", "absent_4xx", "unreachable", "server_error", "rate_limited"), "robots.parse_reason", "not in the enumeration"),
        (F.exists(F.map_values("robots.ai_agents"), lambda v: ~v.isin("allowed", "disallowed", "unspecified")), "robots.ai_agents", "not in the enumeration"),
        (F.exists("sitemaps", lambda s: ~s["lastmod_present_ratio"].between(0, 1)), "sitemaps[].lastmod_present_ratio", "out of range"),
        (F.exists("ua_probe", lambda s: s["status"].isNotNull() & ~s["status"].between(100, 599)), "ua_probe[].status", "out of range"),
        (F.size(F.coalesce("ua_probe", F.array())) > 16, "ua_probe", "too many entries"),
        (F.size(F.coalesce("well_known", F.array())) > 3, "well_known", "too many entries"),
        (F.exists("canonical_claims", lambda c: ~c["first_party_confidence"].isin("high", "medium", "low")), "canonical_claims[].first_party_confidence", "not in the enumeration"),
    ]
    each = [
        (F.col("p.url").isNull(), at("url"), "missing"),
        (F.col("p.status").isNotNull() & ~F.col("p.status").between(100, 599), at("status"), "out of range"),
        (~F.coalesce(F.col("p.page_type").isin("home", "product", "category", "article", "about", "contact", "policy", "doc", "other"), F.lit(False)), at("page_type"), "not in the enumeration"),
        (~F.col("p.page_type_confidence").between(0, 1), at("page_type_confidence"), "out of range"),
        (~F.col("p.rendered.delta_ratio").between(0, 1), at("rendered.delta_ratio"), "out of range"),
        (F.exists("p.raw.headings", lambda h: ~h["level"].between(1, 6)), at("raw.headings[].level"), "out of range"),
        (F.exists("p.obstructions", lambda o: ~o["kind"].isin("cookie_wall", "paywall", "age_gate", "modal")), at("obstructions[].kind"), "not in the enumeration"),
    ]

    def found(df: DataFrame, rules: list) -> DataFrame:
        rows = F.array(*[F.when(c, F.struct((p if isinstance(p, Column) else F.lit(p)).alias("path"), F.lit(m).alias("problem"))) for c, p, m in rules])
        return df.select("site_id", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("v")).select("site_id", "v.path", "v.problem")

    return found(bundles, top).unionByName(found(pages, each))


def degradations(bundles: DataFrame) -> DataFrame:
    """(site_id, what, reason) that bundles record of their own run."""
    return bundles.select("site_id", F.explode("run_context.degradations").alias("d")).select("site_id", "d.what", "d.reason")


def to_evidence(bundles: DataFrame, texts: DataFrame | None = None) -> Evidence:
    """The child tables of ``bundles``. ``texts`` (site_id optional, text_path, text) adds page texts by path."""

    def rows(column: str, position: str = "seq") -> DataFrame:
        return bundles.select("site_id", F.posexplode(column).alias(position, "x"))

    sites = bundles.select(
        "site_id",
        F.lower(F.col("site.registrable_domain")).alias("domain"),
        F.coalesce("site.resolved_origin", "site.input").alias("origin"),
        F.col("run_context.started_at").alias("started_at"),
        F.col("robots.fetched").alias("robots_fetched"),
        F.col("robots.status").alias("robots_status"),
        F.col("robots.parse_ok").alias("robots_ok"),
        F.col("robots.parse_reason").alias("robots_reason"),
        F.col("run_context.capabilities.js_render").alias("js_render"),
        F.col("run_context.capabilities.egress").alias("egress"),
        F.coalesce("external.attempted", F.lit(False)).alias("attempted"),
        F.when(F.col("discovery.soft_404.detected"), F.col("discovery.soft_404.baseline_text_hash")).alias("soft404_hash"),
    )
    pages = rows("pages", "page_seq").select(
        "site_id",
        "page_seq",
        "x.url",
        "x.final_url",
        "x.status",
        "x.content_type",
        "x.fetched_at",
        "x.page_type",
        F.col("x.page_type_confidence").alias("type_confidence"),
        "x.canonical",
        "x.canonical_self",
        "x.meta_robots",
        F.col("x.headers.x_robots_tag").alias("x_robots"),
        "x.lang",
        F.col("x.raw.text_len").alias("raw_len"),
        F.col("x.raw.hidden_text_len").alias("hidden_len"),
        F.col("x.raw.text_hash").alias("raw_hash"),
        F.col("x.raw.text_path").alias("raw_path"),
        F.col("x.rendered.text_path").alias("rendered_path"),
        F.col("x.rendered.available").alias("rendered"),
        F.col("x.rendered.text_len").alias("rendered_len"),
        F.col("x.rendered.delta_ratio").alias("delta"),
        F.col("x.text.word_count").alias("words"),
        F.size("x.raw.headings").alias("n_headings"),
        F.col("x.raw.headings").alias("headings"),
        F.size("x.dates.visible_dates").alias("n_dates"),
        F.col("x.dates.schema_date_modified").alias("date_modified"),
        F.col("x.dates.schema_date_published").alias("date_published"),
        F.col("x.timing.ttfb_ms").alias("ttfb"),
        F.col("x.timing.connect_ms").alias("connect"),
        F.col("x.microdata_or_rdfa").alias("microdata"),
        F.transform(
            "x.jsonld",
            lambda n: F.struct(
                n["type"].alias("type"), n["valid"].alias("valid"), n["fields_present"].alias("fields"), n["values"].alias("vals"), n["contradicts_visible_text"].alias("contradicts")
            ),
        ).alias("nodes"),
    )
    if texts is not None:
        # an empty path is an empty text; a path without a file stays null and is not judged
        for side in ("raw", "rendered"):
            t = texts.select(F.col("text_path").alias(f"{side}_path"), F.col("text").alias(f"{side}_text"))
            pages = pages.join(t, f"{side}_path", "left").withColumn(f"{side}_text", F.when(F.coalesce(f"{side}_path", F.lit("")) == "", "").otherwise(F.col(f"{side}_text")))
    else:
        pages = pages.withColumns({f"{s}_text": F.lit(None).cast("string") for s in ("raw", "rendered")})
    return Evidence(
        sites=sites,
        pages=pages,
        groups=rows("robots.groups").select("site_id", "seq", "x.user_agent", "x.allow", "x.disallow"),
        agents=bundles.select("site_id", F.explode("robots.ai_agents").alias("agent", "verdict")),
        declared=rows("robots.sitemaps").select("site_id", "seq", F.col("x").alias("url")),
        sitemaps=rows("sitemaps").select("site_id", "x.url", "x.status", "x.parse_ok"),
        probe=rows("ua_probe").select("site_id", "x.url", F.col("x.user_agent").alias("agent"), "x.status"),
        well_known=rows("well_known").select("site_id", "x.path", "x.status", "x.present"),
        claims=rows("canonical_claims").select("site_id", "seq", "x.id", "x.kind", F.col("x.value_normalized").alias("value"), F.col("x.first_party_confidence").alias("confidence"), F.col("x.entity_ambiguity").alias("ambiguity")),
        hits=rows("external.hits").select("site_id", "seq", "x.claim_id", "x.origin", F.col("x.asserted_value").alias("asserted"), F.col("x.matches_current").alias("matches")),
        candidates=rows("claim_candidates").select("site_id", "seq", "x.*"),
        edges=bundles.select("site_id", F.explode("link_graph.edges").alias("e")).select("site_id", F.col("e")[0].alias("src"), F.col("e")[1].alias("dst")),
    )
