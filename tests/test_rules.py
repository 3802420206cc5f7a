"""Rules in both directions, composition and reports, over the fixture and over bundles."""

import json

import pytest
from pyspark.sql import functions as F

from weftscan.plans import catalogue, claims, compose, fixture
from weftscan.plans import rules as R
from weftscan.sources import bundle

FOUND = {
    "ACC-001": {"moss.test"}, "ACC-002": {"sedge.test"}, "ACC-003": {"moss.test"}, "ACC-004": set(), "ACC-005": {"moss.test"}, "ACC-006": {"moss.test"}, "ACC-007": {"moss.test"},
    "ACC-008": {"moss.test", "reed.test"}, "ACC-009": {"moss.test"}, "RND-001": {"reed.test", "cove.test"}, "RND-002": {"sedge.test"}, "RND-003": {"moss.test"}, "IDM-001": {"moss.test", "reed.test", "sedge.test"},
    "IDM-002": {"moss.test", "reed.test"}, "IDM-003": {"moss.test"}, "IDM-004": {"moss.test"}, "ANS-001": {"moss.test"}, "FRC-001": {"moss.test"}, "FRC-002": {"moss.test"}, "ARR-001": {"moss.test"},
    "PRO-001": {"moss.test"}, "PRO-002": {"fern.test", "moss.test"}, "PRO-003": set(), "PRO-004": {"moss.test"},
}


@pytest.fixture(scope="module")
def outcomes(spark):
    ev = fixture.evidence(spark)
    rows = compose.landed(compose.run_rules(ev))
    return ev, rows


def test_every_rule_gives_each_site_one_outcome(outcomes):
    _, rows = outcomes
    seen = rows.groupBy("site_id", "rule_id").agg(F.countDistinct("outcome").alias("n"), F.count_if(F.col("outcome") != "finding").alias("other")).collect()
    assert len(seen) == 6 * 24 and all(r.n == 1 and r.other <= 1 for r in seen)
    assert len(R.CATALOGUE) == 24


def test_rules_fire_where_they_should_and_nowhere_else(outcomes):
    _, rows = outcomes
    got = {k: set() for k in R.CATALOGUE}
    for r in rows.where("outcome = 'finding'").select("site_id", "rule_id").collect():
        got[r.rule_id].add(r.site_id)
    assert {k: v for k, v in got.items() if v != FOUND[k]} == {}


def test_unmade_observations_are_not_passes(outcomes):
    _, rows = outcomes
    ivy = {r.rule_id: r.outcome for r in rows.where("site_id = 'ivy.test'").collect()}
    assert set(ivy.values()) == {"not_assessed"}


def test_sections_of_scripted_pages(outcomes):
    _, rows = outcomes
    got = {(r.site_id, r.breadth, r.pages_affected, r.pages_examined, r.confidence) for r in rows.where("rule_id = 'RND-001' and outcome = 'finding'").collect()}
    assert got == {("reed.test", "site", 4, 5, "high"), ("cove.test", "site", 3, 6, "high")}


def test_reports(outcomes):
    ev, rows = outcomes
    found = compose.findings_of(ev, rows).collect()
    by = {}
    for r in found:
        by.setdefault(r.site_id, []).append(r)
        assert r.violation is None and (r.status != "proactive" or r.severity in ("medium", "low"))
    for own in by.values():
        assert sorted(r.position for r in own) == list(range(1, len(own) + 1))
        keys = [(r.priority, r.status == "proactive", bool(r.conditional_on)) for r in sorted(own, key=lambda r: r.position)]
        assert keys == sorted(keys)
    idm = next(r for r in by["sedge.test"] if r.rule_id == "IDM-001")
    assert idm.conditional_on == ["RND-002"]


def test_sites_together_equal_sites_alone(spark, outcomes):
    ev, rows = outcomes
    alone = bundle.Evidence(**{k: v.where("site_id = 'moss.test'") for k, v in vars(ev).items()})
    for rule_id in ("ACC-001", "ACC-003", "RND-001", "IDM-002", "ARR-001"):
        a = sorted(map(str, R.CATALOGUE[rule_id].judge(alone).collect()))
        assert a == sorted(map(str, rows.where(F.col("rule_id") == rule_id).where("site_id = 'moss.test'").collect()))


def test_withheld_and_duplicates(spark):
    base = ("s", "ACC-002", "finding", "high", "site", "primary", 1, 1, ["home"], ["u"], "")
    rows = spark.createDataFrame([base, base, (*base[:1], "PRO-002", *base[2:])], "site_id string, rule_id string, outcome string, confidence string, breadth string, importance string, pages_affected long, pages_examined long, page_types array<string>, urls array<string>, detail string")
    derived = compose.derive(rows, compose.rule_table(fixture.evidence(spark)))
    got = {r.rule_id: (r.severity, r.priority, r.violation is not None) for r in derived.collect()}
    assert got == {"ACC-002": ("critical", "P0", True), "PRO-002": ("medium", "P2", False)}
    assert compose.deduplicate(derived).count() == 2


def test_failing_rule_is_not_assessed(spark, monkeypatch):
    ev = fixture.evidence(spark)
    broken = R.Rule("BAD-001", "x", "t", "f", "found", False, "low", lambda ev: ev.pages.select("no_such_column"))
    monkeypatch.setitem(R.CATALOGUE, "BAD-001", broken)
    got = compose.run_rules(ev, ["BAD-001"]).collect()
    assert {r.outcome for r in got} == {"not_assessed"} and len(got) == 6


def test_severity_table(spark):
    rows = catalogue.severity_table(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 324
    assert {(r.status, r.confidence) for r in rows if r.severity == "critical"} == {("found", "high"), ("risk", "high")}
    assert all(r.impossible == (r.status == "risk" and r.severity == "critical") for r in rows)


def test_claims(spark):
    pages = fixture.evidence(spark).pages.withColumn("text", F.lit("Serving since 1932. 5,000+ customers. Rs. 20 and $3.50"))
    got = claims.candidates(claims.observations(pages.where("site_id = 'moss.test'"))).collect()
    kinds = {(r.kind, r.value_normalized) for r in got}
    assert {("founded_year", "1932"), ("numeric_claim", "5,000+ customers"), ("price", "$3.50"), ("price", "1,200.50"), ("legal_name", "m")} <= kinds
    assert [r.id for r in sorted(got, key=lambda r: r.seq)] == [f"CC-{k:03d}" for k in range(1, len(got) + 1)]
    case = spark.createDataFrame([("Founded in May 1932.", "founded_year", "1932", True), ("In 1932 x", "founded_year", "1932", False), ("The  Moss shop", "legal_name", "moss", True), ("", "legal_name", "", False)], "t string, k string, v string, w boolean")
    assert all(r.a == r.w for r in case.select("w", claims.asserts(F.col("t"), F.col("k"), F.col("v")).alias("a")).collect())
    docs = spark.createDataFrame([("moss.test", "wikipedia.org", "u", "Moss was founded in 1932.")], "site_id string, origin string, url string, text string")
    hits = claims.external_hits(fixture.evidence(spark).claims, docs).collect()
    assert {(h.claim_id, h.matches) for h in hits} == {("C-001", True), ("C-002", True)}
    entity = spark.createDataFrame([("moss.test", "w", "Moss", "+1931-00-00", "moss.test", "moss.test")], "site_id string, url string, label string, inception string, official_domain string, site_domain string")
    assert {(h.claim_id, h.matches) for h in claims.structured_hits(fixture.evidence(spark).claims, entity).collect()} == {("C-001", True), ("C-002", False)}
    kinds = spark.createDataFrame([("wikidata.org",), ("m.facebook.com",), ("dailynews.com",), ("x.test",)], "d string")
    assert [r[0] for r in kinds.select(claims.origin_type(F.col("d"))).collect()] == ["encyclopedic", "social", "news", "directory"]
    assert {(r.site_id, r.profile) for r in claims.declared_profiles(fixture.evidence(spark).pages.where("site_id = 'reed.test'")).collect()} == {("reed.test", "https://www.facebook.com/shopify")}


def _bundle():
    raw = {"text_len": 10, "hidden_text_len": 0, "text_hash": "h", "text_path": "pages/a.txt", "headings": []}
    page = {"url": "https://a.test/", "final_url": "https://a.test/", "status": 200, "content_type": "text/html", "headers": {}, "meta_robots": [], "page_type": "home", "page_type_confidence": 0.95, "raw": raw,
            "rendered": {"available": False, "text_path": ""}, "jsonld": [{"type": "Organization", "valid": True, "errors": [], "fields_present": ["name"], "values": {"name": "A"}}], "text": {"word_count": 3}, "dates": {"visible_dates": []}, "timing": {}}
    return {"schema_version": "1.2", "site": {"input": "a.test", "resolved_origin": "https://a.test", "registrable_domain": "a.test"}, "run_context": {"started_at": "2024-01-01T00:00:00Z", "capabilities": {"js_render": False, "egress": False}},
            "robots": {"fetched": True, "status": 200, "parse_ok": True, "parse_reason": "ok", "groups": [{"user_agent": "*", "allow": [], "disallow": ["/x"]}], "ai_agents": {"GPTBot": "allowed"}, "sitemaps": ["https://a.test/s.xml"]},
            "sitemaps": [], "pages": [page], "link_graph": {"edges": [["https://a.test/", "https://a.test/b"]]}, "ua_probe": [], "well_known": [], "canonical_claims": [], "claim_candidates": [], "discovery": {"soft_404": {"detected": False}}}


def test_bundles_are_read_and_checked(spark, tmp_path):
    bad = _bundle()
    bad["site"]["resolved_origin"] = "https://b.test"
    bad["schema_version"], bad["pages"][0]["page_type"], bad["robots"]["parse_reason"] = "2.0", "nonsense", "x"
    for k, b in enumerate((_bundle(), bad)):
        (tmp_path / f"{k}.json").write_text(json.dumps(b, indent=2))
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages/a.txt").write_text("some text\n")
    read = bundle.read_bundles(spark, f"file://{tmp_path}/*.json")
    problems = {(r.site_id, r.path) for r in bundle.schema_violations(read).collect()}
    assert problems == {("https://b.test", "schema_version"), ("https://b.test", "robots.parse_reason"), ("https://b.test", "pages[0].page_type")}
    ev = bundle.to_evidence(read.where("schema_version like '1.%'"), bundle.read_page_texts(spark, f"file://{tmp_path}/pages/*.txt"))
    ev.create_views("t_")
    row = spark.sql("select * from t_pages").first()
    assert (row.raw_text.strip(), row.rendered_text, row.nodes[0].vals["name"]) == ("some text", "", "A")
    assert {r.outcome for r in R.CATALOGUE["IDM-001"].judge(ev).collect()} == {"passed"}
    assert R.CATALOGUE["RND-002"].judge(ev).first().outcome == "finding"


def test_markdown_and_sinks(spark, tmp_path):
    reports = compose.assemble(fixture.evidence(spark)).cache()
    compose.write_reports(reports, f"file://{tmp_path}/out")
    text = {r.site_id: r.report for r in spark.read.parquet(f"file://{tmp_path}/out/markdown").collect()}
    assert len(text) == 6 and text["moss.test"].startswith("# Audit of moss.test\n") and "### F-001" in text["moss.test"]
    for r in reports.collect():
        assert r.total_findings + r.proactive == len(r.findings)
        assert len(r.checks_passed) + len(r.not_assessed) + len({f.rule_id for f in r.findings} | {w.rule_id for w in r.withheld}) == 24
