"""A few invented sites as literal evidence, for Spark and as VALUES for SQL."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import SparkSession

from weftscan.sources.bundle import TABLES as SCHEMAS
from weftscan.sources.bundle import Evidence

def node(kind: str, valid: bool = True, contradicts: bool = False, **values: str) -> dict:
    vals = {k.replace("__", "."): v for k, v in values.items()}
    return {"type": kind, "valid": valid, "fields": sorted(vals), "vals": vals, "contradicts": contradicts}


def page(site: str, seq: int, path: str, kind: str = "other", **other) -> dict:
    url = f"https://{site}{path}"
    base = {
        "site_id": site, "page_seq": seq, "url": url, "final_url": url, "status": 200, "content_type": "text/html; charset=utf-8", "page_type": kind, "type_confidence": 0.9,
        "canonical": url, "canonical_self": True, "meta_robots": [], "x_robots": None, "lang": "en", "raw_len": 900, "hidden_len": 0, "raw_hash": f"h{seq}", "rendered": True,
        "rendered_len": 950, "delta": 0.053, "words": 300, "n_headings": 4, "n_dates": 1, "date_modified": None, "date_published": "2024-02-03", "ttfb": 200.0, "connect": 20.0,
        "microdata": False, "raw_text": "text $10", "rendered_text": "text $10", "nodes": [], "headings": [{"level": 1, "text": f"Page {seq}"}],
    }
    return {**base, **other}


def _site(name: str, **other) -> dict:
    base = {
        "site_id": name, "domain": name, "origin": f"https://{name}", "started_at": "2024-05-01T00:00:00Z", "robots_fetched": True, "robots_status": 200, "robots_ok": True,
        "robots_reason": "ok", "js_render": True, "egress": True, "attempted": True, "soft404_hash": None,
    }
    return {**base, **other}


def rows() -> dict[str, list[dict]]:
    """All tables. fern.test has few faults, moss.test many, reed.test is built in the browser, sedge.test refuses, ivy.test is empty."""
    org = node("Organization", name="Fern Ltd", sameAs="https://x.com/fern |  https://example.test/fern10", logo="l.png")
    fern = [
        page("fern.test", 0, "/", "home", nodes=[org]),
        page("fern.test", 1, "/about", "about"),
        *[page("fern.test", 2 + k, f"/products/{k}", "product", nodes=[node("Product", name=f"P{k}", offers__price="10")]) for k in range(5)],
        *[page("fern.test", 7 + k, f"/blog/{k}", "article", words=1600, n_headings=9) for k in range(3)],
    ]
    moss_nodes = [node("Product", offers__price="1,200.50", contradicts=True)]
    moss = [
        page("moss.test", 0, "/", "home", nodes=[node("WebSite", name="Moss")], ttfb=2500.0, connect=None),
        *[page("moss.test", 1 + k, f"/blog/{k}", "article", date_published=None, n_dates=k // 2, words=1700, n_headings=1, meta_robots=["noindex"] if k < 2 else [], canonical="https://moss.test/", canonical_self=False, ttfb=2000.0 + k) for k in range(4)],
        *[page("moss.test", 5 + k, f"/products/{k}", "product", nodes=moss_nodes if k < 2 else [node("", valid=False)], x_robots="otherbot: noindex, googlebot: noindex, max-snippet: 0", canonical=None, canonical_self=False, raw_text="no price", rendered_text="now $5", ttfb=1900.0) for k in range(5)],
        *[page("moss.test", 10 + k, f"/gone/{k}", status=404 if k else 500, content_type="text/plain", rendered=False) for k in range(3)],
        page("moss.test", 13, "/docs/a", "doc", nodes=[node("Corporation", sameAs="not a url"), node("Organization", name="M")], meta_robots=["nosnippet"], lang="de-DE"),
    ]
    thin = {"raw_len": 40, "hidden_len": 5, "rendered_len": 3000, "delta": 0.987, "raw_text": "", "rendered_text": "EUR 5"}
    reed = [
        page("reed.test", 0, "/", "home", **thin),
        *[page("reed.test", 1 + k, f"/app/en/{k}/view", "article", **thin, nodes=[node("Organization", sameAs="https://www.facebook.com/shopify")]) for k in range(3)],
        page("reed.test", 4, "/plain", "doc"),
    ]
    cove = [
        *[page("cove.test", k, f"/app/x/{k}", "category", **thin) for k in range(2)],
        *[page("cove.test", 2 + k, f"/guide/{k}", "doc") for k in range(3)],
        *[page("cove.test", 5 + k, f"/shop/{k}", "product", **thin) for k in range(1)],
    ]
    sedge = [page("sedge.test", k, p, t, rendered=False, raw_len=20, hidden_len=10, raw_hash="same", rendered_len=None, delta=None, ttfb=None) for k, (p, t) in enumerate([("/", "home"), ("/a", "article"), ("/b", "article")])]
    agents = ["GPTBot", "ClaudeBot", "PerplexityBot", "Google-Extended", "OAI-SearchBot", "CCBot", "Googlebot", "Claude-SearchBot", "Bingbot"]
    verdict = {("moss.test", a): "disallowed" for a in agents} | {("moss.test", "Googlebot"): "allowed"} | {("reed.test", "Bingbot"): "disallowed"} | {("sedge.test", a): "disallowed" for a in agents}
    names = ["fern.test", "moss.test", "reed.test", "cove.test", "sedge.test", "ivy.test"]
    probe = [("moss.test", "https://moss.test/", "browser-ua", 200), ("moss.test", "https://moss.test/", "GPTBot", 403), ("moss.test", "https://moss.test/", "CCBot", 200), ("moss.test", "https://moss.test/", "Googlebot", 200),
             ("fern.test", "https://fern.test/", "browser-ua", 200), ("fern.test", "https://fern.test/", "GPTBot", 200),
             ("reed.test", "https://reed.test/", "browser-ua", 200), ("reed.test", "https://reed.test/", "GPTBot", 403), ("reed.test", "https://reed.test/", "Googlebot", 403),
             ("cove.test", "https://cove.test/x", "browser-ua", 503), ("cove.test", "https://cove.test/x", "CCBot", 403)]
    table = lambda name, values: [dict(zip([c.strip().split()[0] for c in SCHEMAS[name].split(",")], v, strict=True)) for v in values]
    return {
        "sites": [
            _site("fern.test"), _site("moss.test"), _site("reed.test"), _site("cove.test", robots_status=404, robots_ok=False, robots_reason="absent_4xx", egress=False),
            _site("sedge.test", robots_status=503, robots_ok=False, robots_reason="server_error", js_render=False, soft404_hash="same"),
            _site("ivy.test", robots_fetched=False, robots_status=None, robots_ok=False, robots_reason="unreachable", attempted=False, js_render=False),
        ],
        "pages": [*fern, *moss, *reed, *cove, *sedge],
        "groups": [
            {"site_id": "fern.test", "seq": 0, "user_agent": "*", "allow": [], "disallow": ["/private"]},
            {"site_id": "moss.test", "seq": 0, "user_agent": "*", "allow": ["/blog/"], "disallow": ["/"]},
            {"site_id": "moss.test", "seq": 1, "user_agent": "Googlebot", "allow": ["/"], "disallow": []},
            {"site_id": "moss.test", "seq": 2, "user_agent": "PerplexityBot/1.0", "allow": [], "disallow": ["/"]},
            {"site_id": "reed.test", "seq": 0, "user_agent": "bingbot", "allow": ["/app/*/1"], "disallow": ["/"]},
        ],
        "agents": [{"site_id": s, "agent": a, "verdict": verdict.get((s, a), "allowed" if s == "fern.test" else "unspecified")} for s in names for a in agents],
        "declared": table("declared", [("fern.test", 0, "https://fern.test/s.xml"), ("moss.test", 0, "https://moss.test/a.xml"), ("moss.test", 1, "https://moss.test/b.xml"), ("moss.test", 2, "https://moss.test/c.xml"), ("cove.test", 0, "https://cove.test/s.xml")]),
        "sitemaps": table("sitemaps", [("fern.test", "https://fern.test/s.xml", 200, True), ("moss.test", "https://moss.test/a.xml", 200, False), ("moss.test", "https://moss.test/b.xml", 500, False), ("moss.test", "https://moss.test/c.xml", 403, False), ("cove.test", "https://cove.test/s.xml", 404, False)]),
        "probe": table("probe", probe),
        "well_known": table("well_known", [("fern.test", "/llms.txt", 200, True), ("moss.test", "/llms.txt", 404, False), ("reed.test", "/llms.txt", None, False), ("cove.test", "/agents.md", 404, False)]),
        "claims": table("claims", [
            ("fern.test", 1, "C-001", "legal_name", "fern ltd", "high", "medium"), ("fern.test", 2, "C-002", "founded_year", "1990", "high", "low"),
            ("fern.test", 3, "C-003", "product_name", "p0", "medium", "low"), ("fern.test", 4, "C-004", "product_name", "p1", "medium", "low"), ("fern.test", 5, "C-005", "product_name", "p2", "medium", "low"),
            ("moss.test", 1, "C-001", "legal_name", "moss", "medium", "high"), ("moss.test", 2, "C-002", "founded_year", "1932", "medium", "low"), ("reed.test", 1, "C-001", "legal_name", "reed “x”", "high", "low"),
        ]),
        "hits": table("hits", [("fern.test", 0, "C-002", "wikidata.org", "inception 1990", True), ("moss.test", 0, "C-002", "news.test", "1933", False), ("moss.test", 1, "C-002", "wikidata.org", "inception 1931", False)]),
        "candidates": table("candidates", [
            ("fern.test", 1, "CC-001", "founded_year", "1990", "1990", "https://fern.test/", "foundingDate", "jsonld", 1), ("fern.test", 2, "CC-002", "legal_name", "Fern Ltd", "fern ltd", "https://fern.test/", "name", "jsonld", 4),
            ("fern.test", 3, "CC-003", "price", "$10", "$10", "https://fern.test/products/0", "text", "visible_text", 5), ("fern.test", 4, "CC-004", "tagline", "Page 0", "page 0", "https://fern.test/", "h1", "visible_text", 1),
            ("moss.test", 1, "CC-001", "founded_year", "1932", "1932", "https://moss.test/", "text", "visible_text", 3), ("moss.test", 2, "CC-002", "legal_name", "Shop Online Ltd", "shop online ltd", "https://moss.test/", "name", "jsonld", 1),
            ("moss.test", 3, "CC-003", "legal_name", "Moss", "moss", "https://moss.test/", "legalName", "jsonld", 2),
        ]),
        "edges": table("edges", [(s, f"https://{s}{a}", f"https://{s}{b}") for s, a, b in [
            ("fern.test", "/", "/about"), ("fern.test", "/", "/products/0"), ("fern.test", "/products/0", "/products/1"), ("fern.test", "/products/1", "/products/2"), ("fern.test", "/products/2", "/"),
            ("fern.test", "/products/1", "/elsewhere"), ("moss.test", "/", "/blog/0"), ("moss.test", "/blog/0", "/blog/1"), ("moss.test", "/blog/1", "/blog/2"),
        ]]),
    }


def evidence(spark: SparkSession) -> Evidence:
    """The fixture as evidence tables."""
    from pyspark.sql.types import StructType

    out = {}
    for name, values in rows().items():
        schema = StructType.fromDDL(SCHEMAS[name])
        out[name] = spark.createDataFrame([tuple(v[f.name] for f in schema.fields) for v in values], schema).coalesce(1)
    return Evidence(**{f.name: out[f.name] for f in fields(Evidence)})


# SQL


def _kind(ddl: str) -> str:
    ddl = ddl.strip()
    if ddl.startswith("array<"):
        return _kind(ddl[6:-1]) + "[]"
    if ddl.startswith("map<"):
        return "MAP(VARCHAR, VARCHAR)"
    if ddl.startswith("struct<"):
        return "STRUCT(" + ", ".join(f'"{p.split(":", 1)[0]}" {_kind(p.split(":", 1)[1])}' for p in _split(ddl[7:-1])) + ")"
    return {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}[ddl]


def _split(text: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, text[start:]]]


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, list):
        return "[" + ", ".join(map(_literal, value)) + "]"
    if isinstance(value, dict):
        if set(value) in ({"type", "valid", "fields", "vals", "contradicts"}, {"level", "text"}):
            return "{" + ", ".join(f"'{k}': {_map(v) if k == 'vals' else _literal(v)}" for k, v in value.items()) + "}"
        return _map(value)
    return "'" + str(value).replace("'", "''") + "'"


def _map(value: dict) -> str:
    return "MAP {" + ", ".join(f"{_literal(k)}: {_literal(v)}" for k, v in value.items()) + "}"


def values_sql(*names: str) -> str:
    """Common table expressions with the rows of tables, without WITH."""
    out, data = [], rows()
    for name in names:
        columns = [p.split(None, 1) for p in _split(SCHEMAS[name].replace("\n", " "))]
        own = ", ".join(f'"{c}"' for c, _ in columns)
        cast = ", ".join(f'CAST("{c}" AS {_kind(k)}) AS "{c}"' for c, k in columns)
        # one row at a time: literals of empty lists and of filled ones need not agree before the cast
        each = " UNION ALL ".join("SELECT " + ", ".join(f"CAST({_literal(r[c])} AS {_kind(k)}) AS \"{c}\"" for c, k in columns) for r in data[name])
        out.append(f"fx_{name} AS (SELECT {cast} FROM ({each}) AS t({own}))")
    return ",\n".join(out)
