"""Whole results of toxicity and sharding against versions without Spark, written shards, and orders that stay."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import functions as F

from weftscan.llm import quality, sharding, toxicity
from weftscan.llm.toxicity import aggregate_of, fitted_k, karlin_lambda, maximal_segments, score_of, tokens_of


# Toxicity


def _plain_model(rows, prior=8.0, clip=6.0, drift=0.35, cut=0.3):
    """The model of ``toxicity.train`` from (doc_id, text, toxic), by hand."""
    signed = lambda d: xxhash.xxh64_intdigest(int(d).to_bytes(8, "little", signed=True), 42) - (0)
    part = lambda d: ((signed(d) + 2**63) % 2**64 - 2**63) % 4
    counts = {1: Counter(), 0: Counter()}
    for d, text, toxic in rows:
        if part(d) != 0:
            counts[toxic].update(tokens_of(text))
    tokens = set(counts[0]) | set(counts[1])
    total = [sum(counts[c].values()) for c in (0, 1)]
    base = min(max(total[1] / max(sum(total), 1.0), 1e-6), 1 - 1e-6)
    posterior = lambda n1, n0, mean: (n1 + prior * mean) / (n1 + n0 + prior)
    weights = {}
    stems = {k: defaultdict(lambda: [0, 0]) for k in toxicity.STEMS}
    for t in tokens:
        for k in toxicity.STEMS:
            if len(t) >= k:
                stems[k][t[:k]][1] += counts[1][t]
                stems[k][t[:k]][0] += counts[0][t]
    means = {}

    def told(feature, n1, n0, mean):
        share = posterior(n1, n0, mean)
        if n1 * math.log(share / mean) + n0 * math.log((1 - share) / (1 - mean)) >= 1.0:
            odds = math.log(share / (1 - share)) - math.log(base / (1 - base))
            weights[feature] = max(-clip, min(clip, odds)) - drift

    for k, up in ((3, None), (4, 3), (5, 4)):
        for s, (n0, n1) in stems[k].items():
            mean = base
            if up:
                u0, u1 = stems[up][s[:up]]
                mean = posterior(u1 - n1, u0 - n0, means[s[:up]])
            means[s] = mean
            told(s + "*", n1, n0, mean)
    for t in tokens:
        n1, n0, mean = counts[1][t], counts[0][t], base
        # a token inherits from its longest stem, of five letters
        if len(t) >= 5:
            u0, u1 = stems[5][t[:5]]
            mean = posterior(u1 - n1, u0 - n0, means[t[:5]])
        told(t, n1, n0, mean)
    model = toxicity.ToxicityModel(weights, -drift, 1.0, 0.1, 1.0, math.log(cut / (1 - cut)) - 3.0)

    def scores(text):
        out = []
        for t in tokens_of(text):
            found = [weights[f] for f in [t, *(t[:k] + "*" for k in (5, 4, 3) if len(t) >= k)] if f in weights]
            out.append(found[0] if found else -drift)
        return out

    held = [(text, toxic) for d, text, toxic in rows if part(d) == 0]
    clean, segments = np.zeros(toxicity._BINS), np.zeros(toxicity._SEGMENT_BINS)
    for text, toxic in held:
        if toxic == 0:
            s = scores(text)
            for x in s:
                clean[int(min(max((x - toxicity._LOW) / toxicity._STEP, 0), toxicity._BINS - 1))] += 1
            for _, _, x in maximal_segments(s):
                segments[int(min(x / toxicity._STEP, toxicity._SEGMENT_BINS - 1))] += 1
    values = toxicity._LOW + toxicity._STEP * (np.arange(toxicity._BINS) + 0.5)
    shares = clean + 1e-4 * clean.sum() * (values > 0) / (values > 0).sum()
    lam = karlin_lambda(values, shares / shares.sum())
    k = fitted_k(segments, clean.sum(), lam, 50, 0.1)
    of = lambda text: aggregate_of([x for _, _, x in maximal_segments(scores(text))], len(scores(text)), lam, k, 0.1)
    slope, offset = toxicity._fit_curve(np.array([of(t) for t, _ in held]), np.array([c for _, c in held], float), cut)
    return toxicity.ToxicityModel(weights, -drift, lam, k, slope, offset), of


def _labelled(rng, n=400):
    clean, bad = [f"{a}{b}" for a in ("river", "stone", "cloud", "field") for b in ("s", "ed", "ing", "let", "")], [f"{a}{b}" for a in ("vile", "scumm") for b in ("s", "ed", "y", "est")]
    rows = []
    for d in range(n):
        words, toxic = rng.choices(clean, k=rng.randrange(5, 80)), int(rng.random() < 0.3)
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(bad, k=rng.randrange(2, 9))
        elif rng.random() < 0.2:
            words.append(rng.choice(bad))
        rows.append((d, " ".join(words), toxic))
    return rows


def test_toxicity_trains_and_scores_as_by_hand(spark):
    rows = _labelled(random.Random(3))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    model = toxicity.train(table)
    want, of = _plain_model(rows)
    assert set(model.weights) == set(want.weights)
    assert all(math.isclose(model.weights[f], want.weights[f], abs_tol=1e-9) for f in want.weights)
    for name in ("lam", "k", "slope", "offset"):
        assert math.isclose(getattr(model, name), getattr(want, name), rel_tol=1e-9), name
    got = {r.doc_id: r.toxicity for r in toxicity.score_documents(table, model).collect()}
    assert all(math.isclose(got[d], score_of(of(text), want), abs_tol=1e-9) for d, text, _ in rows)


def test_training_takes_one_text_for_each_doc_id(spark):
    rows = _labelled(random.Random(4))
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    known = next(d for d, _, _ in rows if zlib.crc32(str(d).encode()) % 4 != 2)
    many = docs.unionByName(spark.range(2000).select(F.lit(known).alias("doc_id"), F.concat(F.lit("zzz vile "), F.col("id").cast("string")).alias("text")))
    assert toxicity.train_on_labels(many, labels).weights == toxicity.train_on_labels(docs, labels).weights
    few = toxicity.train_on_labels(docs, labels, model_features=5)
    assert len(few.weights) == 5 and set(few.weights) < set(toxicity.train_on_labels(docs, labels).weights)


def test_a_text_of_a_million_words_goes_through_whole_queries(spark):
    rng = random.Random(5)
    long = " ".join(rng.choice(["river", "stone", "cloud"]) + str(rng.randrange(5000)) for _ in range(1_000_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.quality_cascade(docs).collect()}
    assert (got[1].n_words, got[2].n_words, got[1].word_chars + 3) == (1_000_000, 1_000_001, got[2].word_chars)
    model = toxicity.train(spark.createDataFrame(_labelled(rng), "doc_id long, text string, toxic int"))
    assert all(r.toxic_predicted == 0 for r in toxicity.score_documents(docs, model).collect())


# Sharding


def _hilbert(point, bits):
    """Skilling's transform, by hand."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out * 2 + (x[i] >> b & 1)
    return out


def _layout(rows, shards, bits=4):
    """(doc_id, shard, slot) of (doc_id, text, lang, source) with distinct doc_ids, by hand."""
    size = {d: len((t or "").encode()) + 16 for d, t, _, _ in rows}
    levels = [k / (1 << bits) for k in range(1, 1 << bits)]

    def bounds(values):
        values = sorted(values)
        return {values[max(math.ceil(p * len(values)), 1) - 1] for p in levels} if values else set()

    columns = [{d: s for d, _, _, s in rows}, {d: lang for d, _, lang, _ in rows}, size]
    cuts = [bounds([v for v in c.values() if v is not None]) for c in columns]
    cell = {d: tuple(0 if c[d] is None else sum(c[d] >= b for b in cut) for c, cut in zip(columns, cuts, strict=True)) for d in size}
    first = {}
    for d, t, _, _ in sorted(rows, key=lambda r: r[0]):
        first.setdefault(t or "", d)
    order = sorted(rows, key=lambda r: (_hilbert(cell[first[r[1] or ""]], bits), zlib.crc32((r[1] or "").encode()), size[r[0]], r[0]))
    small, more = divmod(len(order), shards)
    out, at = {}, 0
    for s in range(shards):
        for slot in range(small + (s < more)):
            out[order[at][0]] = (s, slot)
            at += 1
    return out


def _documents(rng, n=600):
    texts = [f"text {k} " * rng.randrange(1, 30) for k in range(n // 3)]
    return [(d, rng.choice([*texts[: n // 6], *texts, f"only {d}", None if d % 90 == 0 else ""][d % 7 :]), rng.choice(["en", "de", "fr", None]), f"source_{rng.randrange(20):03d}") for d in range(n)]


def test_shards_are_laid_out_as_by_hand(spark):
    rows = _documents(random.Random(6))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.hilbert_shards(docs, shards=7).collect()}
    assert got == _layout(rows, 7)
    # a group is divided only where a cut falls into it
    held = defaultdict(set)
    for d, t, _, _ in rows:
        held[t or ""].add(got[d][0])
    divided = [s for s in held.values() if len(s) > 1]
    assert len(divided) <= 6 and all(max(s) - min(s) + 1 == len(s) for s in divided)


def test_written_shards_let_filters_skip_files(spark, tmp_path):
    rng = random.Random(7)
    rows = [(d, f"text {d} " * rng.randrange(1, 60), rng.choice(["en", "de", "fr", "it"]), f"source_{rng.randrange(20):03d}") for d in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=40)
    files = list((tmp_path / "out").rglob("*.parquet"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 4000 and back.select("shard").distinct().count() == 40
    where = {"lang": "fr", "source": "source_013"}

    def may_hold(file):
        meta = pq.ParquetFile(file).metadata.row_group(0)
        stats = {meta.column(k).path_in_schema: meta.column(k).statistics for k in range(meta.num_columns)}
        return all(stats[c].min <= v <= stats[c].max for c, v in where.items())

    asked = [f for f in files if may_hold(f)]
    assert len(asked) <= len(files) // 3
    wanted = {d for d, _, lang, source in rows if (lang, source) == ("fr", "source_013")}
    found = spark.read.parquet(*map(str, asked)).where("lang = 'fr' and source = 'source_013'").select("doc_id").collect()
    assert {r.doc_id for r in found} == wanted


# Quality


def test_one_table_gives_one_order_of_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rules = [quality.base_rule(), *quality.default_rules()]
    orders = {tuple(r.name for r in quality.cascade_order(docs, rules)) for _ in range(3)}
    assert len(orders) == 1
    assert quality.sample_of(docs.withColumn("big", F.lit("x" * 1000)), 50).columns == ["text"]
