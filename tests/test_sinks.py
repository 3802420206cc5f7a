"""Sinks, read back, and rows that say what was cut."""

import hashlib
import json

from pyspark.sql import functions as F

from weftscan.operators import crawl
from weftscan.plans import claims, fixture
from weftscan.sources import bundle, sinks


def test_bundles_and_claims_are_read_back(spark, tmp_path):
    sites = [{"schema_version": "1.0", "site": {"resolved_origin": s, "input": s}, "canonical_claims": [{"id": "old"}]} for s in ("fern.test", "moss.test", "ivy.test")]
    for k, b in enumerate(sites):
        (tmp_path / f"{k}.json").write_text(json.dumps(b, indent=2))
    read = bundle.read_bundles(spark, f"file://{tmp_path}/*.json")
    merged = sinks.merge_claims(read, claims.promote(fixture.evidence(spark).candidates))
    assert merged.schema.simpleString() == read.schema.simpleString()
    sinks.write_bundles(merged, f"file://{tmp_path}/out")
    back = {r.site_id: r for r in bundle.read_bundles(spark, f"file://{tmp_path}/out", lines=True).collect()}
    assert {s: [c.id for c in r.canonical_claims] for s, r in back.items()} == {"fern.test": ["C-001", "C-002", "C-003"], "moss.test": ["C-001", "C-002", "C-003"], "ivy.test": []}
    assert back["fern.test"].canonical_claims[0].value_normalized == "fern ltd"


def test_texts_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("a",), ("",), (None,), ("é",)], "text string")
    sinks.write_texts(rows, f"file://{tmp_path}/texts")
    got = {r.text_hash: r.text for r in spark.read.parquet(f"file://{tmp_path}/texts").collect()}
    assert got == {hashlib.sha256(t.encode()).hexdigest(): t for t in ("a", "", "é")}


def test_findings_by_skill(spark, tmp_path):
    rows = spark.createDataFrame([("s", "x", "F-001"), ("s", "y", "F-002"), ("t", "x", "F-001")], "site_id string, skill string, id string")
    sinks.write_findings(rows, f"file://{tmp_path}/findings")
    assert sorted(p.name for p in (tmp_path / "findings").glob("skill=*")) == ["skill=x", "skill=y"]
    assert spark.read.json(f"file://{tmp_path}/findings").count() == 3


def test_heads_say_what_they_leave_out(spark):
    rows = spark.createDataFrame([("a", k) for k in range(5)] + [("b", 1)], "site_id string, k int")
    kept, beyond = crawl.head(rows, ["site_id"], [F.col("k")], 3, "examples")
    assert sorted((r.site_id, r.k) for r in kept.collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 1)]
    assert [tuple(r) for r in beyond.collect()] == [("a", "examples", 3, 5)]


def test_crawl_rows_without_a_match(spark):
    sites = spark.createDataFrame([("a", "h", False, "t0"), ("b", None, False, "t0"), ("c", "h", True, "t0"), ("d", "h", False, "t0")], "site_id string, soft404_hash string, js_render boolean, started_at string")
    pages = spark.createDataFrame(
        [("a", 0, "u", "v", 200, "h", "t1"), ("a", 1, "w", "u", 200, "h", "t2"), ("a", 2, "x", "x", 404, "z", "t3"), ("b", 0, "u", "u", 200, None, None), ("c", 0, "u", "u", 200, "h", "t1"), ("d", 0, "u", "u", 200, "h", "t1"), ("d", 1, "w", "w", 200, None, "t1")],
        "site_id string, page_seq int, url string, final_url string, status int, raw_hash string, fetched_at string",
    )
    assert [r.site_id for r in crawl.shell_sites(sites, pages).collect()] == ["a"]
    asked = spark.createDataFrame([("a", "u"), ("a", "v"), ("a", "none"), ("b", "u"), ("e", "u")], "site_id string, url string")
    assert {(r.site_id, r.url): r.fetched_at for r in crawl.fetched_at(asked, pages, sites).collect()} == {("a", "u"): "t1", ("a", "v"): "t1", ("a", "none"): "t0", ("b", "u"): "t0", ("e", "u"): None}
    nothing = spark.createDataFrame([], "site_id string, url string, source string, allowed boolean")
    assert {tuple(r)[1:] for r in crawl.counters(sites, nothing, pages.where("false"), pages.where("false")).collect()} == {(0, 0, 0, 0, "stratified:none")}


def test_texts_by_hash_are_joined_where_they_lie(spark, capsys):
    pages = spark.createDataFrame([(k, f"text {k % 40}" if k % 7 else None) for k in range(300)], "page_seq int, text string")
    sinks.save_texts(pages, "page_texts_by_hash", 8)
    asked = pages.withColumn("raw_hash", F.sha2(F.col("text").cast("binary"), 256)).select("page_seq", "raw_hash")
    joined = sinks.with_texts(asked, "page_texts_by_hash", "raw_hash", "raw_text")
    assert sorted((r.page_seq, r.raw_text or "") for r in joined.collect()) == sorted((r.page_seq, r.text or "") for r in pages.collect())
    capsys.readouterr()
    joined.explain()
    plan = capsys.readouterr().out.split("+- == Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan
    spark.sql("DROP TABLE page_texts_by_hash")
