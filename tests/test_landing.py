"""Landed responses to evidence, rules on it, and reports that say what they rest on."""

import json

import pytest
from pyspark.sql import functions as F

from weftscan.plans import compose, fixture, landing
from weftscan.plans import rules as R

ORG = '<script type="application/ld+json">{"@type": "Organization", "name": "Fern Ltd", "legalName": "Fern Ltd", "foundingDate": "1990"}</script>'
WORDS = " ".join(f"word{k}" for k in range(120))


def doc(head: str = "", body: str = WORDS) -> str:
    return f'<html lang="en"><head><title>t</title>{head}</head><body><h1>Fern</h1><p>{body}</p><a href="/products/1">one</a><a href="/gone">x</a></body></html>'


SCHEMA = "page_id long, url string, html string, final_url string, status int"
ROWS = [
    (10, "https://fern.test/", doc(ORG), None, 200),
    (11, "https://fern.test/products/1", doc('<meta name="robots" content="noindex">', "first " + WORDS), None, 200),
    (12, "https://fern.test/products/2", doc('<meta name="robots" content="noindex">', "second " + WORDS), None, None),
    (13, "https://fern.test/old", doc(body="first " + WORDS), "https://fern.test/products/1", 200),
    (14, "https://fern.test/shop/twin", doc('<link rel="canonical" href="https://fern.test/shop/one">', "twin " + WORDS), None, 200),
    (15, "https://fern.test/shop/one", doc('<link rel="canonical" href="https://fern.test/shop/one">', "twin " + WORDS), None, 200),
    (16, "https://fern.test/gone", None, None, 404),
    (20, "http://moss.test/a?utm_source=x", "", None, 200),
    (21, "not an address", "x", None, 200),
    (22, None, None, None, None),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_pages_are_known_by_their_final_address(spark, pages):
    kept, lost = landing.page_table(pages)
    got = {(r.site_id, r.page_seq, r.final_url): r for r in kept.collect()}
    assert sorted(got) == [
        ("http://moss.test", 0, "http://moss.test/a"),
        ("https://fern.test", 0, "https://fern.test/"),
        ("https://fern.test", 1, "https://fern.test/products/1"),
        ("https://fern.test", 2, "https://fern.test/products/2"),
        ("https://fern.test", 4, "https://fern.test/shop/twin"),
        ("https://fern.test", 6, "https://fern.test/gone"),
    ]
    home = got["https://fern.test", 0, "https://fern.test/"]
    assert (home.page_type, home.status, home.rendered, home.delta) == ("home", 200, False, None)
    assert [n.type for n in home.nodes] == ["Organization"]
    assert got["https://fern.test", 6, "https://fern.test/gone"].status == 404
    assert [tuple(r) for r in lost.collect()] == [("https://fern.test", 1, 1)]


def test_rendered_documents_are_compared(spark):
    rows = [(1, "https://reed.test/app/1", "<p>ab</p>", f"<p>{WORDS}</p>"), (2, "https://reed.test/app/2", f"<p>{WORDS}</p>", None)]
    kept, _ = landing.page_table(spark.createDataFrame(rows, "page_id long, url string, html string, rendered_html string"))
    got = {r.page_seq: r for r in kept.collect()}
    assert (got[0].rendered, got[0].rendered_len, got[0].delta) == (True, len(WORDS) + 1, round((len(WORDS) - 2) / (len(WORDS) + 1), 3))  # each line of a text has its end
    assert (got[1].rendered, got[1].rendered_len, got[1].delta, got[1].rendered_text) == (False, None, None, None)


def test_rules_run_on_landed_pages(spark, pages):
    policies = spark.createDataFrame([("https://fern.test", 200, "User-agent: *\nDisallow: /\nUser-agent: Googlebot\nAllow: /\nSitemap: https://fern.test/s.xml")], "site_id string, status int, body string")
    ev, lacks = landing.to_evidence(pages, "2024-05-01T00:00:00Z", policies)
    out = {(r.site_id, r.rule_id): r for r in compose.run_rules(ev, ["ACC-001", "ACC-003", "IDM-001", "RND-001"]).collect()}
    fern, moss = "https://fern.test", "http://moss.test"
    assert (out[fern, "ACC-001"].outcome, out[moss, "ACC-001"].outcome) == ("finding", "not_assessed")
    assert out[fern, "ACC-003"].outcome == "finding" and out[fern, "ACC-003"].urls == ["https://fern.test/products/1", "https://fern.test/products/2"]
    assert out[fern, "IDM-001"].outcome == "passed"
    assert out[fern, "RND-001"].outcome == "not_assessed"
    assert {(r.kind, r.value) for r in ev.claims.collect()} >= {("legal_name", "fern ltd"), ("founded_year", "1990")}
    edges = {(r.src, r.dst) for r in ev.edges.collect()}
    assert ("https://fern.test/", "https://fern.test/products/1") in edges and ("https://fern.test/products/1", "https://fern.test/products/1") not in edges
    assert {(r.site_id, r.what) for r in lacks.collect()} == {(fern, "duplicates"), (fern, "render"), (moss, "render"), (moss, "claims"), (moss, "robots")}
    assert [r.url for r in ev.declared.collect()] == ["https://fern.test/s.xml"]


def test_no_responses(spark):
    ev, lacks = landing.to_evidence(spark.createDataFrame([], SCHEMA), "2024-05-01T00:00:00Z")
    assert ev.pages.isEmpty() and ev.sites.isEmpty() and lacks.isEmpty()
    assert compose.run_rules(ev, ["ACC-003"]).isEmpty()


def test_reports_say_what_they_rest_on(spark, tmp_path):
    lacks = spark.createDataFrame([("fern.test", "render", "2 pages were not reached")], "site_id string, what string, reason string")
    reports = compose.assemble(fixture.evidence(spark), lacks).cache()
    assert compose.report_violations(reports).isEmpty()
    got = {r.site_id: r for r in reports.collect()}
    moss = {f.rule_id: f for f in got["moss.test"].findings}
    assert [(e.url, e.status, e.fetched_at, e.observation) for e in moss["ACC-001"].evidence] == [("https://moss.test/robots.txt", 200, "2024-05-01T00:00:00Z", "answered 200")]
    assert [(e.url, e.observation) for e in moss["ACC-009"].evidence] == [("https://moss.test/a.xml", "answered 200"), ("https://moss.test/b.xml", "answered 500")]
    assert all(g.reason == compose.NEEDS[g.rule_id] for r in got.values() for g in r.not_assessed)
    assert [tuple(d) for d in got["fern.test"].run_context.degradations] == [("render", "2 pages were not reached")]
    assert set(compose.NEEDS) == set(R.CATALOGUE)
    compose.write_reports(reports, f"file://{tmp_path}/r")
    lines = [json.loads(x) for p in (tmp_path / "r/json").glob("*.json") for x in p.read_text().splitlines()]
    assert {x["site_id"] for x in lines} == set(got)
    text = {r.site_id: r.report for r in spark.read.parquet(f"file://{tmp_path}/r/markdown").collect()}
    assert "- render: 2 pages were not reached" in text["fern.test"]
    with pytest.raises(ValueError, match="do not add up"):
        compose.write_reports(reports.withColumn("high", F.col("high") + 1), f"file://{tmp_path}/s")
