"""Operators with parameters, the link graph, samples, probes, streams and the driver entry."""

import datetime
import random

from pyspark.sql import functions as F

import __spark_entry__
from weftscan.functions import robots, urls
from weftscan.operators import graph, probes, sampling, shapes
from weftscan.plans import catalogue
from weftscan.streaming import landing


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_share_of_group_and_roll_up(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "x", 1), ("a", "y", 1), ("a", "y", 1), ("b", "x", 1), ("b", "x", 0), ("b", "x", 0), ("b", "x", 1), ("b", "y", 0)], "g string, p string, hit int")
    shares = shapes.share_of_group(rows, ["g", "p"], F.col("hit") == 1).withColumn("total", F.when(F.col("g") == "a", 4).otherwise(9))
    assert rows_of(shapes.roll_up(shares, "g", "p", F.col("total"))) == [("a", "*", 2, 4, 4), ("b", "x", 1, 2, 4)]


def test_pivot_median_first_top(spark):
    rows = spark.createDataFrame([("u", "b", 1.0), ("u", "x", 3.0), ("v", "x", 4.0), ("u", "x", 2.0)], "k string, l string, v double")
    assert rows_of(shapes.pivot_compare(rows, ["k"], "l", "v", "b", ["x"])) == [("u", 1.0, 3.0)]
    nums = spark.createDataFrame([("a", float(v)) for v in (1, 2, 4, 5)] + [("b", 9.0)], "k string, v double")
    assert rows_of(shapes.median_against(nums, ["k"], F.col("v"), 2.5, 2)) == [("a", 4, 3.0, 2, "above"), ("b", 1, 9.0, 1, "not_assessed")]
    assert {r.verdict for r in shapes.approximate_median_against(nums, ["k"], F.col("v"), 8.0, 1).collect()} == {"above", "within"}
    assert rows_of(shapes.keep_first(rows, ["l"], ["v"])) == [("b", 1.0, "u", 1), ("x", 2.0, "u", 3)]
    assert rows_of(shapes.top_n(nums, ["k"], [F.desc("v")], 1)) == [("a", 5.0, 1), ("b", 9.0, 1)]
    assert rows_of(shapes.strata(nums, nums.where("v > 4"), ["k"])) == [("a", 4, 1), ("b", 1, 1)]


def test_link_graph(spark):
    pages = spark.createDataFrame([("s", 0, "https://a.test/", ["https://www.a.test/b", "https://a.test/b", "https://a.test/x.pdf", "https://other.test/", "https://a.test/"]), ("s", 1, "https://a.test/b", ["https://a.test/c"]), ("s", 2, "https://a.test/c", []), ("s", 3, "https://a.test/d", ["https://a.test/"])], "site_id string, page_seq int, url string, targets array<string>")
    edges, over = graph.link_edges(pages, spark.createDataFrame([("s", "a.test")], "site_id string, place string"))
    assert rows_of(edges) == [("s", "https://a.test/", "https://a.test/b"), ("s", "https://a.test/b", "https://a.test/c"), ("s", "https://a.test/d", "https://a.test/")] and over.count() == 0
    assert rows_of(graph.orphans(pages, edges)) == [("s", "https://a.test/d")]
    assert {r.url[-1]: r.depth for r in graph.depths(pages, edges).collect()} == {"/": 0, "b": 1, "c": 2}
    assert rows_of(graph.max_depth(pages, edges)) == [("s", 2)]
    capped, over = graph.link_edges(pages, spark.createDataFrame([("s", "a.test")], "site_id string, place string"), cap=1)
    assert capped.count() == 1 and rows_of(over) == [("s", 3)]


def test_aliases(spark):
    rows = [("s", 0, "a", 200, "a", "h"), ("s", 1, "b", 200, "a", "h"), ("s", 2, "c", 200, None, "h"), ("s", 3, "d", 200, "c", "z"), ("s", 4, "e", 404, "a", "h")]
    assert rows_of(graph.aliases(spark.createDataFrame(rows, "site_id string, page_seq int, url string, status int, canonical string, raw_hash string"))) == [("s", "b", "a")]


def _greedy(frontier, limit):
    left, picked, in_section, out = list(frontier), {}, {}, []
    while left and len(out) < limit:
        kinds = {}
        for u, k, s, key in left:
            kinds.setdefault(k, {}).setdefault(s, []).append((key, u))
        k = min(kinds, key=lambda k: (picked.get(k, 0), -sum(map(len, kinds[k].values())), k))
        s = min(kinds[k], key=lambda s: (in_section.get((k, s), 0), -len(kinds[k][s]), s))
        u = min(kinds[k][s])[1]
        out.append(u)
        picked[k] = picked.get(k, 0) + 1
        in_section[k, s] = in_section.get((k, s), 0) + 1
        left = [x for x in left if x[0] != u]
    return out


def test_greedy_sample(spark):
    rng = random.Random(1)
    paths = sorted({"/" + "/".join(rng.choice(["blog", "products", "x", "y", "docs"]) for _ in range(rng.randrange(4))) + rng.choice(["", "?q=1", "/z"]) for _ in range(90)})
    address = [f"https://a.test{p}" for p in paths]
    df = spark.createDataFrame([("s", u) for u in address], "site_id string, url string")
    typed = df.select("url", urls.page_type(F.col("url"))["page_type"].alias("k"), urls.section_of(F.col("url")).alias("s")).collect()
    key = lambda u: ("?" in u, u.split("?")[0].removeprefix("https://a.test").count("/"), len(u), u)
    frontier = [(r.url, r.k, (r.s.section, r.s.depth), key(r.url)) for r in typed]
    for limit in (5, 30, 500):
        got = sampling.greedy_sample(df, limit).orderBy("pick").collect()
        assert [r.url for r in got] == _greedy(frontier, limit)
    dealt = sampling.round_robin(df.withColumn("k", urls.page_type(F.col("url"))["page_type"]), ["k"], ["site_id"], [F.col("url")]).collect()
    assert sorted(r.pick for r in dealt) == list(range(1, len(address) + 1))
    pages = spark.createDataFrame([("s", 0, "home"), ("s", 1, "doc"), ("s", 2, "doc"), ("s", 3, "about")], "site_id string, page_seq int, page_type string")
    assert [r.page_seq for r in sampling.render_order(pages).orderBy("render_rank").collect()] == [0, 1, 3, 2]


def test_probes(spark):
    r = spark.createDataFrame([("a", 200, 300, "h"), ("a", 200, 300, "h"), ("b", 200, 300, "h"), ("b", 200, 300, "g"), ("c", 404, 300, "h"), ("c", 200, 300, "h"), ("d", 200, 300, "h")], "site_id string, status int, bytes long, text_hash string")
    base = probes.missing_page_baseline(r)
    assert rows_of(base) == [("a", True, "h"), ("b", True, None), ("c", False, None), ("d", False, None)]
    files = spark.createDataFrame([("a", "/llms.txt", 200, 9, "h"), ("b", "/llms.txt", 200, 9, "h"), ("c", "/llms.txt", 403, 9, "x"), ("d", "/llms.txt", None, None, None)], "site_id string, path string, status int, bytes long, text_hash string")
    assert rows_of(probes.well_known_files(files, base)) == [("a", "/llms.txt", 200, False), ("b", "/llms.txt", 200, True), ("d", "/llms.txt", None, False)]
    pages = spark.createDataFrame([("s", 0, "h", 200, 9), ("s", 1, "p", 200, 5), ("s", 2, "q", 200, 5), ("s", 3, "r", 404, 50)], "site_id string, page_seq int, url string, status int, raw_len int")
    targets = probes.probe_targets(pages)
    assert rows_of(targets) == [("s", "h", 0), ("s", "q", 1)]
    closed = spark.createDataFrame([("s", "h", "B", False)], "site_id string, url string, agent string, allowed boolean")
    assert rows_of(probes.probe_plan(targets, ["A", "B"], closed)) == [("s", "h", "A"), ("s", "q", "A"), ("s", "q", "B")]
    assert rows_of(probes.probe_plan(targets, ["A", "B"], closed, 2)) == [("s", "h", "A"), ("s", "q", "A")] and probes.probe_plan(targets, ["A", "B"], closed, None).count() == 3
    assert rows_of(probes.probe_cuts(targets, ["A", "B"], closed, 2)) == [("s", "probe", 2, 3)] and probes.probe_cuts(targets, ["A", "B"], closed).count() == 0
    tries = spark.createDataFrame([("s", "u", 1, "ab"), ("s", "u", 2, "xy"), ("s", "v", 1, "a"), ("s", "v", 2, "bcd")], "site_id string, url string, attempt int, html string")
    assert rows_of(probes.best_render(tries)) == [("s", "u", 1, "ab"), ("s", "v", 2, "bcd")]
    assert len(spark.range(1).select(probes.probe_path(F.lit("a.test"), 1)).first()[0]) == 17
    assert rows_of(spark.createDataFrame([(10, 40), (9, 3), (1, 0)], "a int, b int").select(probes.delta_ratio(F.col("a"), F.col("b")))) == [(0.0,), (0.75,), (None,)]


def test_stream_of_pages(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 12)
    pages = spark.createDataFrame([(1, "https://a.co.uk/", "<h1>x</h1>", at), (2, "https://www.a.co.uk/b", "<p>y", at)], landing.SCHEMA)
    pages.write.parquet(f"{tmp_path}/in")
    landing.write_evidence(landing.landed_pages(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert {r.page_id: r.parsed.text for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1: "x\n", 2: "y\n"}
    query = landing.arrivals(landing.landed_pages(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.domain, r.pages) for r in spark.table("arrivals").collect()] == [("a.co.uk", 2)]


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["domain", "page_type", "confidence", "discovered"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scans_read_only_what_is_needed(spark):
    q = __spark_entry__.queries()
    plan = q["user_error_share"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in plan
    plan = q["page_strata"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<url:string>" in plan and "Python" not in plan and "Arrow" not in plan


def test_page_links_counts_every_edge(spark, tmp_path):
    links = "".join(f"<a href='/p{k}'>x</a>" for k in range(5001))
    rows = [(1, "https://a.test/", f"<body>{links}</body>"), (2, "https://a.test/p1", "<body><a href='/p2'>x</a><a href='/p2'>y</a></body>"), (3, "https://b.test/", "<body><a href='/p1'>x</a></body>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert rows_of(catalogue.page_links(spark, str(tmp_path))) == [("a.test", 5002, 2, 5001), ("b.test", 1, 1, 1)]


def _medians(values):
    import statistics

    return {k: statistics.median(v) if v else None for k, v in values.items()}


def test_exact_medians_of_groups_of_any_size(spark):
    rng = random.Random(11)
    values = {
        "hot": [round(rng.expovariate(0.01), 2) for _ in range(3001)], "even": [float(v) for v in range(1000)], "equal": [7.5] * 900, "two": [1.0] * 450 + [2.0] * 450, "wide": [10.0 ** rng.randrange(-300, 300) for _ in range(700)],
        "near": [0.1 + k * 2**-56 for k in range(500)], "huge": [1.7e308, -1.7e308] * 200 + [5.0] * 3, "ends": [float("inf")] * 120 + [float("-inf")] * 120 + [1.0, 2.0], "small": [3.0, 1.0], "none": [],
    }
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("none", None), ("hot", None)] + [(None, float(k)) for k in range(999)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "k string, v double")
    want = _medians(values) | {None: 499.0}
    for held, buckets in ((20, 64), (100, 512), (10**6, 8)):
        got = {r.k: r.median for r in shapes.exact_median(table, ["k"], F.col("v"), held, buckets).collect()}
        assert got == want, (held, buckets)
    verdicts = {r.k: (r.n, r.median, r.over, r.verdict) for r in shapes.median_against(table, ["k"], F.col("v"), 6.0, 5, held=20).collect()}
    assert verdicts["equal"] == (900, 7.5, 900, "above") and verdicts["none"] == (0, None, 0, "not_assessed") and verdicts[None][:2] == (999, 499.0)
    assert shapes.exact_median(table.where("false"), ["k"], F.col("v")).count() == 0


def test_greedy_picks_equal_the_greedy_order(spark):
    rng = random.Random(12)
    for limit in (None, 1, 7, 40):
        rows = [(g, f"u{k}", rng.choice("abcde"[: g + 2]), rng.choice(["", "x", "y", "z"][: g + 1]), rng.randrange(1000) * 100 + k) for g in range(4) for k in range(rng.randrange(1, 60))]
        table = spark.createDataFrame(rows, "g int, url string, kind string, section string, key int")
        got = {}
        for r in sampling.greedy_picks(table, ["g"], "kind", ["section"], [F.col("key")], limit).orderBy("g", "pick").collect():
            got.setdefault(r.g, []).append(r.url)
        assert got == {g: sampling.greedy_order([(u, k, s, key) for h, u, k, s, key in rows if h == g], limit) for g in {r[0] for r in rows}}


def test_samples_cut_groups_before_they_are_dealt_out(spark, capsys):
    table = spark.createDataFrame([(1, "u", "a", "s", 1)], "g int, url string, kind string, section string, key int")
    for df in (sampling.greedy_picks(table, ["g"], "kind", ["section"], [F.col("key")], 5), sampling.round_robin(table, ["kind"], ["section"], [F.col("key")], 5)):
        capsys.readouterr()
        df.explain()
        plan = capsys.readouterr().out
        assert plan.count("WindowGroupLimit") >= 3 and "Python" not in plan and "Pandas" not in plan


def test_rules_that_apply_are_found_by_their_prefixes(spark):
    rng = random.Random(13)
    piece = lambda: rng.choice(["/", "a", "b", "*", "$", "%2b", "%2B", "é", "?q=", ".php", "[x]", "/a"])
    rules = [(f"s{k % 3}", rng.choice(["x", "y"]), rng.random() < 0.5, "/" * rng.randrange(2) + "".join(piece() for _ in range(rng.randrange(0, 5)))) for k in range(200)] + [("s0", "x", True, None), ("s0", "x", True, "")]
    paths = [(f"s{k % 4}", "/" + "".join(piece() for _ in range(rng.randrange(0, 6))).replace("*", "c")) for k in range(150)] + [("s1", "/robots.txt"), ("s0", None)]
    r = spark.createDataFrame(rules, "site_id string, agent string, allow boolean, pattern string")
    p = spark.createDataFrame(paths, "site_id string, path string").distinct()
    got = rows_of(robots.applying(p, r).select("site_id", "agent", "path", "allow", "pattern"))
    want = rows_of(p.join(r.distinct(), "site_id").where(robots.matches(F.col("path"), F.col("pattern"))).select("site_id", "agent", "path", "allow", "pattern"))
    assert got == want and len(got) > 100
    decided = robots.decide(p, r)
    assert decided.count() == p.join(r.select("site_id", "agent").distinct(), "site_id").count()
    assert {d.allowed for d in decided.where("path = '/robots.txt'").collect()} == {True}
