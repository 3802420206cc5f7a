"""URL, robots and HTML functions, value by value."""

import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from weftscan.functions import html, robots, urls
from weftscan.sources import sitemaps


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()[0]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://WWW.Example.COM:80/A/b?utm_source=x&q=1&gclid=2#frag", "http://www.example.com/A/b?q=1"),
        ("https://a.test", "https://a.test/"),
        ("https://a.test:8443/x?", "https://a.test:8443/x"),
        ("https://user:pw@a.test/x", "https://a.test/x"),
        ("ftp://a.test/", None),
        ("/relative", None),
        ("https:///x", None),
        ("https://[::1]:8080/a", "https://[::1]:8080/a"),
        ("https://a.test:99999/x", None),
        ("https://a.test:123456789012345678901234567890/x", None),
        ("http://a.test:00080/x", "http://a.test/x"),
        ("https://a.test:08443/x", "https://a.test:8443/x"),
        ("https://a.te\tst/x\ny", "https://a.test/xy"),
        ("https://a.test:/x", "https://a.test/x"),
        ("https://a.test:8x/x", None),
    ],
)
def test_normalise(spark, url, want):
    assert one(spark, url, urls.normalise) == want
    if "://" in url and url != "https:///x":
        assert html.resolve(url, "https://base.test/") == want


@pytest.mark.parametrize(("host", "want"), [("a.b.co.uk", "b.co.uk"), ("www.x.com", "x.com"), ("localhost", "localhost"), ("10.0.0.1", "10.0.0.1"), ("co.uk", "co.uk"), ("A.B.C.", "b.c"), (None, ""), ("2001:db8::1", "2001:db8::1")])
def test_registrable_domain(spark, host, want):
    assert one(spark, host, urls.registrable_domain) == want
    if host:
        assert html.domain_of(f"http://[{host}]/" if ":" in host else f"http://{host.lower()}/") == want


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("/", ("home", 0.95)), ("/en", ("home", 0.95)), ("/en-gb/", ("home", 0.95)), ("/index.php", ("home", 0.95)), ("/policies/refund-policy", ("policy", 0.6)), ("/collections/x/products/y", ("product", 0.6)),
        ("/pc/snacks/biscuits/cookies/", ("other", 0.3)), ("/cookies", ("policy", 0.6)), ("/products/privacy-screen", ("product", 0.6)), ("/about-fixture", ("about", 0.6)), ("/extended-warranty", ("policy", 0.6)),
        ("/world/2024/05/x", ("article", 0.6)), ("/a/b/terms-sheet", ("other", 0.3)), ("/x.html", ("other", 0.3)), ("/faq.html", ("doc", 0.6)), ("/shop/x", ("category", 0.6)),
    ],
)
def test_page_type(spark, path, want):
    assert tuple(one(spark, "https://a.test" + path, urls.page_type)) == want


def test_refined_type(spark):
    rows = spark.createDataFrame([("other", 0.3, ["ItemList", "NewsArticle"]), ("home", 0.95, ["Product"]), ("doc", 0.6, ["Product"]), ("article", 0.6, ["Article"]), ("doc", 0.6, None), ("doc", 0.6, ["Thing"])], "k string, c double, d array<string>")
    got = [tuple(r.r) for r in rows.select(urls.refined_type(F.col("k"), F.col("c"), F.col("d")).alias("r")).collect()]
    assert got == [("article", 0.8), ("home", 0.95), ("product", 0.7), ("article", 0.9), ("doc", 0.6), ("doc", 0.6)]


def test_twin_and_scope(spark):
    assert [one(spark, v, urls.twin_netloc) for v in ("www.a.test", "a.test:81", "localhost", "10.0.0.1")] == ["a.test", "www.a.test:81", None, None]
    assert [one(spark, f"https://a.test/{v}", urls.is_page_address) for v in ("x.pdf", "x", "s.xml.gz", "a.html")] == [False, True, False, True]


ROBOTS = """﻿# note
Disallow: /ignored
User-agent: A
User-agent: B/1.0  # two
Disallow: /x
Sitemap: https://a.test/s.xml
Allow: /x/y
Crawl-delay: -1
User-agent: *
Crawl-delay: 2.5
Disallow:
"""


def test_robots_parse_and_verdicts(spark):
    parsed = lambda text: one(spark, text, robots.parse_robots).asDict(recursive=True)
    got = parsed(ROBOTS)
    assert [g["agents"] for g in got["groups"]] == [["A", "B/1.0"], ["*"]]
    assert got["groups"][0]["rules"] == [{"allow": False, "pattern": "/x"}, {"allow": True, "pattern": "/x/y"}]
    assert [g["crawl_delay"] for g in got["groups"]] == [None, 2.5] and got["sitemaps"] == ["https://a.test/s.xml"]
    assert parsed(None) == parsed("") == parsed("no colon\r\n# x: y\rsitemap:") == {"groups": [], "sitemaps": []}
    odd = parsed("USER-AGENT : x \r\ncrawl-delay: 3\rCrawl-Delay: nan\ncrawl-delay: many\nfoo: bar\nuser-agent:y\nallow: /a:b\nuser-agent: z")
    assert [(g["agents"], g["crawl_delay"], [r["pattern"] for r in g["rules"]]) for g in odd["groups"]] == [(["x"], 3.0, []), (["y"], None, ["/a:b"]), (["z"], None, [])]
    long = "/" + "a" * 20_000
    assert one(spark, f"%c3{long}$", robots.normal_pattern) == f"%C3{long}$"
    landed = [("1", 200, "User-agent: *\nDisallow: /\nUser-agent: gptbot\nAllow: /"), ("2", 503, None), ("3", 404, "x"), ("4", 200, "<!DOCTYPE html><p>"), ("5", None, None), ("6", 200, ""), ("7", 429, ""), ("8", 302, "")]
    rows = spark.createDataFrame(landed, "site_id string, status int, body string")
    reasons = {r.site_id: r.r for r in rows.select("site_id", robots.parse_reason(F.col("status"), F.col("body")).alias("r")).collect()}
    assert reasons == {"1": "ok", "2": "server_error", "3": "absent_4xx", "4": "not_plausibly_robots", "5": "unreachable", "6": "ok", "7": "rate_limited", "8": "absent_4xx"}
    v = {(r.site_id, r.agent): r.verdict for r in robots.verdicts(rows, ["GPTBot", "CCBot"]).collect()}
    assert v["1", "GPTBot"] == "allowed" and v["1", "CCBot"] == "disallowed" and v["2", "CCBot"] == "disallowed"
    assert v["3", "CCBot"] == v["4", "CCBot"] == v["6", "CCBot"] == "unspecified" and v["7", "GPTBot"] == v["5", "GPTBot"] == "disallowed"


PAGE = """<!DOCTYPE html><html lang=" en "><head><title>no</title><meta name="robots" content="NoIndex, follow"><link rel="canonical" href="/c?utm_x=1">
<script type="application/ld+json">{"@graph": [{"@type": ["Product", "X"], "name": "P", "offers": {"price": "13", "priceCurrency": "EUR"}, "sameAs": ["a", "b"], "isAccessibleForFree": false}, {"n": true}]}</script>
<script type="application/ld+json">{bad</script></head><body><header>top</header><nav><a href="/a">A</a><a href="mailto:x">m</a></nav>
<div id="onetrust-banner">we use cookies</div><div hidden>secret text</div>
<main id="m"><section id="s"><h1>Big  <b>title</b></h1><p>one<br>two<p>three <time datetime="2024-02-03T00:00">then</time></section>
<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table><img src="/size-guide.png"><a href="https://other.test/" rel="nofollow" aria-label="lab"></a></main>
<p>Costs €1.250,00 on 5 March 2023, 31/12/2022 and 2021-02-30"""


def test_parse_page():
    p = html.parse_page(PAGE, "https://www.a.test/dir/")
    assert p["lang"] == "en" and p["canonical"] == "https://www.a.test/c" and p["meta_robots"] == ["noindex", "follow"]
    assert p["text"].splitlines() == ["top", "Am", "Big title", "one two", "three then", "x", "y", "1", "2", "3", "Costs €1.250,00 on 5 March 2023, 31/12/2022 and 2021-02-30"]
    assert p["headings"] == [{"level": 1, "text": "Big title"}] and p["anchors"] == [{"id": "s", "heading_text": "Big title"}]
    assert p["hidden_text_len"] == len("secret text") and p["tables"] == 1 and p["link_total"] == 2
    assert [(x["anchor"], x["internal"]) for x in p["links"]] == [("A", True), ("lab", False)] and p["targets"] == ["https://www.a.test/a"]
    assert p["visible_dates"] == ["2024-02-03", "2023-03-05", "2022-12-31"]
    assert {o["kind"] for o in p["obstructions"]} == {"cookie_wall", "paywall"}
    product, bare, bad = p["nodes"]
    assert product["type"] == "Product" and dict(product["vals"])["offers.price"] == "13" and dict(product["vals"])["sameAs"] == "a | b" and product["contradicts"]
    assert (bare["valid"], bad["valid"], bad["fields"]) == (False, False, [])
    assert html.parse_page(None, None)["text_len"] == 0
    assert p["images"] == [{"src": "/size-guide.png", "alt": None, "text_likely": True}]


def test_hostile_pages_take_linear_time():
    import time

    began = time.perf_counter()
    for body in ("<div>" * 40_000, "<p><li><td>" * 20_000, "<section id=x><h2>a</h2>" * 10_000, "</div>" * 40_000, "<a href=/x>" * 20_000, "<div hidden>x" * 20_000):
        html.parse_page(body, "https://a.test/")
    assert time.perf_counter() - began < 20
    deep = "[" * 100_000 + "]" * 100_000, '{"@graph":[' * 20_000 + "]}" * 20_000, '{"@type":"T","a":' + '{"b":' * 300 + "1" + "}" * 301
    p = html.parse_page("".join(f'<script type="application/ld+json">{x}</script>' for x in deep) + "<p>still read</p>", "https://a.test/")
    assert p["text"] == "still read\n" and [n["errors"] for n in p["nodes"]] == [["nested too deeply"], ["nested too deeply"], []]
    assert [n.get("n") for n in html.nodes_of([[{"n": 1}, {"@graph": [{"n": 2}, [[{"n": 3}]]]}], "x", {"@graph": 5, "n": 4}])] == [1, 2, 3, 4]
    many = html.parse_page("<a href=/x>y</a>" * 501 + "<img src=a>" * 201, "https://a.test/")
    assert many["truncated"] == ["links: 500 of 501", "images: 200 of 201"] and (len(many["links"]), len(many["images"])) == (500, 200)


@pytest.mark.parametrize(("names", "want"), [("cookie-law bar", True), ("cookies banner", True), ("cookie recipe", False), ("cc-window", True), ("cc", False), ("privacy modal", True), ("myconsentbox", True), ("cmp2", True), ("cmpx", False), ("sp_message_1", True), ("banner", False)])
def test_consent_names(names, want):
    assert html.names_consent(names) is want


def test_price_readings():
    assert html.readings("1,499.00") == {1499.0, 1.499} and html.readings("1.250,00") == {1250.0, 1.25} and html.readings("12.5.1") == {1251.0} and html.readings("1,250") == {1250.0, 1.25}
    assert not html.contradicts({"offers.price": "1499", "offers.priceCurrency": "EUR"}, "now 1.499,00 and €1.499,00")
    assert not html.contradicts({"price": "5", "priceCurrency": "EUR"}, "$9") and html.contradicts({"price": "5"}, "$9")


def test_values_are_capped_shortest_first():
    import json

    nodes = html.jsonld([json.dumps({"@type": "T", "a": "x" * 4000, "b": "y" * 200, "c": "z"})], "")
    assert html.afford(nodes, 4096) == (2, 3)
    assert set(nodes[0]["vals"]) == {"b", "c"} and nodes[0]["fields"] == ["a", "b", "c"]


def test_every_cut_is_marked_and_can_be_lifted():
    import json

    script = json.dumps({"@type": "T", "a": "x" * 4000, "b": "y" * 200, "c": "z"})
    page = lambda days: f"<body><script type='application/ld+json'>{script}</script>" + "".join(f"<p>{d + 1} May {1990 + d}</p>" for d in range(days)) + "</body>"
    cut, whole = html.parse_page(page(21), "https://a.test/"), html.parse_page(page(21), "https://a.test/", whole=True)
    assert cut["truncated"] == ["dates: 20 of 21", "values: 2 of 3"] and len(cut["visible_dates"]) == 20 and {k for k, _ in cut["nodes"][0]["vals"]} == {"b", "c"}
    assert whole["truncated"] == [] and len(whole["visible_dates"]) == 21 and {k for k, _ in whole["nodes"][0]["vals"]} == {"a", "b", "c"}
    assert html.parse_page(page(20), "https://a.test/")["truncated"] == ["values: 2 of 3"]


@pytest.mark.parametrize(
    ("written", "days"),
    [
        ("3rd May, 2020 and May 4th 2021", ["2020-05-03", "2021-05-04"]), ("on 2020/1/9, 12.11.2019, 11/13/2018 and 13/11/2017", ["2020-01-09", "2019-11-12", "2018-11-13", "2017-11-13"]), ("31 February 2020, 1.2.3.2020, Sept. 5, 2022", ["2022-09-05"]),
        ("2020-02-30 2020-02-28 2020-02-28", ["2020-02-28"]), ("0/5/2024 45 May 2020 5 Mayor 2020", []), ("5 DEC. 1999", ["1999-12-05"]),
    ],
)
def test_written_dates(written, days):
    assert html.shown_dates(written, []) == days


def test_excerpts_end_before_a_word(spark):
    rows = spark.createDataFrame([("a b\n c", 5), ("word and more", 8), ("unbroken", 4), (" \n ", 3), (None, 3)], "t string, n int")
    got = [rows.where(f"n = {n}").select(html.excerpt(F.col("t"), n)).first()[0] for n in (5, 8, 4)]
    assert got == ["a b c", "word", "unbr"]


def test_parse_pages_once_in_arrow(spark):
    df = html.page_evidence(html.parse_pages(spark.createDataFrame([(1, "https://a.test/blog/x", PAGE), (2, None, None)], "page_id long, url string, html string")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    rows = {r.page_id: r for r in df.collect()}
    assert (rows[1].page_type, rows[1].type_confidence) == ("product", 0.7) and rows[2].parsed.word_count == 0


def test_bodies(spark):
    raw = "é".encode("latin-1")
    assert html.decode_body(raw, "text/html; charset=ISO-8859-1") == "é" and html.decode_body(b"<meta charset=latin-1>" + raw, None).endswith("é") and html.decode_body(raw, "text/html; charset=nope") == "�"
    assert html.inflate(gzip.compress(b"abc" * 999)[:-9], "gzip").startswith(b"abc") and html.inflate(zlib.compress(b"x"), "deflate") == b"x" and html.inflate(b"plain", "gzip") == b"plain"
    rows = spark.createDataFrame([(bytearray(gzip.compress(b"hi")), "gzip", None), (None, None, None)], "b binary, e string, t string")
    assert [r[0] for r in rows.select(html.decode_response(F.col("b"), F.col("e"), F.col("t"))).collect()] == ["hi", None]


def test_sitemaps(spark):
    body = b'<urlset xmlns="http://s"><url><loc> https://a.test/1 </loc><lastmod>2024</lastmod></url><url><loc>https://a.test/2</loc></url><url><loc>https://a'
    whole = body + b"</loc></url></urlset>"
    assert sitemaps.parse_sitemap(whole, "u")["lastmod_ratio"] == 0.333 and len(sitemaps.parse_sitemap(whole, "u")["locations"]) == 3
    assert sitemaps.parse_sitemap(body, "u", cut=True)["locations"] == ["https://a.test/1", "https://a.test/2"] and not sitemaps.parse_sitemap(body, "u")["parse_ok"]
    assert sitemaps.parse_sitemap(gzip.compress(whole), "u.gz")["parse_ok"] and not sitemaps.parse_sitemap(gzip.compress(whole)[:-5], "u.gz")["parse_ok"]
    assert not sitemaps.parse_sitemap(b"<html/>", "u")["parse_ok"] and not sitemaps.parse_sitemap(None, "u")["parse_ok"]
    index = b"<sitemapindex><sitemap><loc>s2</loc></sitemap></sitemapindex>"
    landed = spark.createDataFrame([("a", "s1", bytearray(index), None, False), ("a", "s2", bytearray(whole), None, False), ("a", "s3", bytearray(whole), None, False)], "site_id string, url string, body binary, content_type string, truncated boolean")
    reached = sitemaps.follow_indexes(spark.createDataFrame([("a", "s1")], "site_id string, url string"), sitemaps.read_sitemaps(landed))
    assert {r.url: r.kind for r in reached.collect()} == {"s1": "index", "s2": "urlset"}
