"""Quality, toxicity, near-duplicates, chat formatting, sharding and the pipeline against brute force."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftscan.llm import chat, components, lattice, minhash, quality, sharding, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _union(ids, links):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


# quality


def _counts(text):
    words = WORD.findall(text or "")
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_order(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "# * $ |", "x " * 5000, "é🙂 ü\x0bz\x0cq\r\n" * 3, "one two three four five six seven eight nine\n" * 4]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) + rng.choice(["", "\na b\na b"]) for _ in range(60)]
    rows = [(i, t, True, 5, i, -i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept boolean, n_words long, _counts int, rejected int")
    got = {r.doc_id: r for r in quality.quality_cascade(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = _counts(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want, repr(t)
        assert got[i].base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (got[i].base_failed and got[i].kept)
        assert (got[i]._counts, got[i].rejected) == (i, -i)
    assert quality.quality_cascade(docs.where("false")).count() == 0
    counted = quality.text_counts(docs)
    rules = [quality.base_rule(), *quality.default_rules()]
    a, b = ({r.doc_id: r.rejected for r in counted.withColumn("rejected", quality.verdict_of(x)).collect()} for x in (rules, rules[::-1]))
    assert a == b
    assert {r.name for r in quality.cascade_order(counted, rules)} == {r.name for r in rules}


def test_quality_keeps_labelled_clean(spark):
    d = "/root/testdata/sf0.01"
    judged = quality.quality_cascade(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    assert judged.where("quality = 1 and not base_failed and not kept").count() == 0
    junk = judged.where("quality = 0")
    assert junk.where("not kept").count() >= 0.9 * junk.count()


# toxicity


def test_maximal_segments_by_brute_force():
    rng = random.Random(4)

    def brute(scores):
        # the best segment (shortest, leftmost), then the same to its left and right
        def find(a, b):
            best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
            if best is None or best[0] <= 0:
                return []
            i, j = best[3], best[4]
            return [*find(a, i), (i, j, best[0]), *find(j, b)]

        return find(0, len(scores))

    for _ in range(200):
        scores = [rng.choice([-3, -2, -1, 1, 2, 5]) for _ in range(rng.randrange(14))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(scores)] == [(a, b) for a, b, _ in brute(scores)] or sorted(
            s for *_, s in toxicity.maximal_segments(scores)
        ) == sorted(s for *_, s in brute(scores))


def test_karlin_lambda():
    values, shares = np.array([-1.0, 1.0]), np.array([0.75, 0.25])
    assert toxicity.karlin_lambda(values, shares) == pytest.approx(math.log(3))


def test_fitted_k_on_random_text():
    # steps of +1 and -1 are a law that is known: E of at least S is K n exp(-lambda S)
    rng = np.random.default_rng(8)
    scores = np.where(rng.random(200_000) < 0.3, 1.0, -1.0)
    lam = toxicity.karlin_lambda(np.array([-1.0, 1.0]), np.array([0.7, 0.3]))
    found = np.array([s for *_, s in toxicity.maximal_segments(scores.tolist())])
    histogram = np.bincount((found / toxicity._STEP).astype(int), minlength=toxicity._SEGMENT_BINS)
    k = toxicity.fitted_k(histogram, scores.size, lam, 50, 9.0)
    for s in (3, 4, 5):
        assert (found >= s).sum() == pytest.approx(k * scores.size * math.exp(-lam * s), rel=0.5)
    assert toxicity.fitted_k(histogram * 0, scores.size, lam, 50, 9.0) == 9.0


def _labelled(spark, n=240):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeiou") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        toxic = int(i % 6 == 0)
        if toxic:
            text[10:10] = [rng.choice(["zzgrim", "zzvile", "zzfoul"]) for _ in range(4)]
        rows.append((i, " ".join(text), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_finds_planted_passages(spark):
    rows = _labelled(spark)
    labels = rows.select("doc_id", "toxic")
    model = toxicity.train_on_labels(rows.select("doc_id", "text"), labels)
    assert toxicity.ToxicityModel.from_json(model.to_json()) == model
    got = toxicity.score_documents(rows, model).collect()
    assert sum(r.toxic != r.toxic_predicted for r in got) <= 0.03 * len(got)
    hit = [r for r in got if r.toxic and r.toxic_predicted]
    for r in hit:
        tokens = toxicity.tokens_of(r.text)
        assert any(t.startswith("zz") for p in r.toxic_passages for t in tokens[p.first : p.stop])
    odd = spark.createDataFrame([(0, None, 9.0), (1, "", 9.0), (2, "...", 9.0), (3, "zzvile " * 20000, 9.0), (None, "same", 9.0), (None, "same", 9.0)], "doc_id long, text string, toxicity double")
    scored = toxicity.score_documents(odd, model).collect()
    assert all(0 <= r.toxicity <= 1 for r in scored) and len(scored) == 6
    assert [r.toxic_predicted for r in sorted(scored, key=lambda r: (r.doc_id is None, r.doc_id or 0))] == [0, 0, 0, 1, 0, 0]
    assert toxicity.score_documents(odd.where("false"), model).count() == 0
    empty = toxicity.train_on_labels(rows.where("false"), labels)
    assert {r.toxic_predicted for r in toxicity.score_documents(odd.where("doc_id < 3"), empty).collect()} == {0}


def test_held_out_rows(spark):
    rows = spark.range(50).select(toxicity.held_out(F.col("id")).alias("h"), "id").collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


# components and near-duplicates


def test_components_by_brute_force(spark):
    rng = random.Random(6)
    for links in ([(k, k + 1) for k in range(60)], [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], [(0, k) for k in range(1, 40)]):
        got = {r.id: r.component_id for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
        ids = {i for a, b in links if a != b for i in (a, b)}
        assert got == _union(ids, [(a, b) for a, b in links if a != b])
    assert components.connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def _shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def _brute_near(rows, k, percent):
    sets = [(i, _shingles(t, k)) for i, t in rows]
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, u in sets[:x] if s and u and 100 * len(s & u) >= percent * len(s | u)]
    return _union({i for i, _ in rows}, links), {i: len(s) for i, s in sets}


def _near_texts():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "one two"), (7, "É é"), (8, "w " * 3000)]
    base = [rng.choice(words) for _ in range(120)]
    for i in range(9, 120):
        if i % 3:
            text = list(base)
            for _ in range(rng.randrange(1, 9)):
                text[rng.randrange(len(text))] = rng.choice(words)
        else:
            text = [rng.choice(words) for _ in range(rng.randrange(2, 40))]
        rows.append((i, " ".join(text)))
    # a chain whose ends are not alike
    chain = [rng.choice(words) for _ in range(200)]
    for i in range(120, 132):
        rows.append((i, " ".join(chain)))
        for j in range(6):
            chain[(i - 120) * 14 + j] = f"c{i}{j}"
    return rows


@pytest.mark.parametrize(("k", "block", "at_once"), [(2, 1024, 8192), (5, 1024, 8192), (2, 7, 5), (5, 3, 8192)])
def test_minhash_components_by_brute_force(spark, k, block, at_once):
    rows = _near_texts()
    docs = spark.createDataFrame([(i, t, "x", True) for i, t in rows], "doc_id long, text string, digest string, kept boolean").repartition(3)
    got = {r.doc_id: r for r in minhash.minhash_components(docs, k, 80, block=block, rows_at_once=at_once).collect()}
    component, sizes = _brute_near(rows, k, 80)
    assert {i: r.component_id for i, r in got.items()} == component
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_minhash_on_table_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    component, _ = _brute_near([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert {r.doc_id: r.component_id for r in minhash.minhash_components(docs, 5, 80).collect()} == component
    odd = spark.createDataFrame([(1, "a b c"), (1, "x y z"), (None, "a b c"), (2, "x y z"), (3, "a b c"), (3, "a b c")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in minhash.minhash_components(odd, 2, 80).collect())
    assert got == [(False, 1, 1, True), (False, 1, 1, True), (False, 2, 1, False), (False, 3, 1, False), (False, 3, 1, False), (True, 0, None, True)]
    assert minhash.minhash_components(odd.where("false"), 2, 80).count() == 0


def test_minhash_links_each_text_of_a_repeated_id(spark):
    rng = random.Random(12)
    one, two = ([f"w{rng.randrange(900)}" for _ in range(80)] for _ in range(2))
    near = [[*t[:-1], "end"] for t in (one, two)]
    rows = [(1, one), (1, two), (5, near[0]), (6, near[1]), (7, [f"v{k}" for k in range(50)])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.minhash_components(docs, 2, 80).collect()} == {1: 1, 5: 1, 6: 1, 7: 7}


def test_minhash_refutes_a_group_just_below_the_threshold(spark):
    rng = random.Random(13)
    base = [f"w{rng.randrange(3000)}" for _ in range(100)]
    rows = []
    for i in range(120):
        text = list(base)
        for at in rng.sample(range(100), 6):
            text[at] = f"x{i}.{at}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    component, _ = _brute_near(rows, 2, 80)
    assert 60 < len(set(component.values())) <= 120
    for block in (1024, 30):
        assert {r.doc_id: r.component_id for r in minhash.minhash_components(docs, 2, 80, block=block, rows_at_once=50).collect()} == component


def test_shared_counts_by_brute_force():
    rng = np.random.default_rng(3)
    for n, words in ((5, 30), (70, 40), (200, 400)):
        sets = [np.unique(rng.integers(0, words, rng.integers(0, 40)).astype(np.uint64)) for _ in range(n)]
        left = np.sort(rng.choice(n, n // 2, replace=False))
        got = minhash.shared_counts(sets, left)
        for a, i in enumerate(left):
            assert all(got[a, j] == np.intersect1d(sets[i], sets[j]).size for j in range(n) if j != i)


def test_estimate_is_unbiased():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(5000)]
    errors = []
    for seed in range(40):
        base = [rng.choice(words) for _ in range(400)]
        other = base[:320] + [rng.choice(words) for _ in range(80)]
        texts = [" ".join(t) for t in (base, other)]
        batch = pa.RecordBatch.from_pydict({"doc_id": [0, 1], "text": texts})
        (sigs,) = minhash._signatures(iter([batch]), 2, minhash.BANDS, minhash.ROWS, minhash.SIGNATURE_BITS, seed)
        packed = np.array(sigs.column("packed").to_pylist(), np.int64).view(np.uint64)
        est = minhash.corrected_similarity(packed[:1], packed[1:], minhash.BANDS * minhash.ROWS, minhash.SIGNATURE_BITS)[0]
        a, b = (_shingles(t, 2) for t in texts)
        errors.append(est - len(a & b) / len(a | b))
    # one estimate has a standard error of about 0.03
    assert abs(np.mean(errors)) < 0.015
    assert max(map(abs, errors)) < minhash.MARGIN


def test_e8_decoder_by_brute_force():
    rng = np.random.default_rng(1)
    y = rng.uniform(-1, 1, (200, 8))
    roots = lattice._roots()
    p = lattice.decode_e8(y)
    whole = np.allclose(p, np.rint(p), atol=0) or all(np.all(q == np.rint(q)) or np.all(q - 0.5 == np.rint(q - 0.5)) for q in p)
    assert whole and np.all(p.sum(1) % 2 == 0)
    # the Voronoi cell of E8 is bounded by its roots alone
    assert np.all((y - p) @ roots.T <= 1 + 1e-9)
    assert len(roots) == 240 and np.allclose((roots**2).sum(1), 2)


def _brute_vectors(rows, cosine):
    unit = {}
    for at, (_, v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            unit[at] = x / np.sqrt(x @ x)
    count, links = dict.fromkeys(range(len(rows)), 0), []
    for a in unit:
        for b in unit:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                count[a] += 1
                count[b] += 1
                links.append((rows[a][0], rows[b][0]))
    return count, _union({r[0] for r in rows}, links)


@pytest.mark.parametrize("block", [8192, 7])
def test_lattice_by_brute_force(spark, block):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for c in range(12):
        centre = rng.standard_normal(24)
        for _ in range([1, 3, 100, 2][c % 4]):
            rows.append((k, (centre + rng.standard_normal(24) * rng.choice([0.02, 0.08, 0.2])).tolist(), c % 2))
            k += 1
    rows += [(k, rows[3][1], 1), (k + 1, rows[3][1], 1), (k + 2, rows[3][1], None), (k + 3, None, 1), (k + 4, [], 1), (k + 5, [0.0] * 24, 1), (k + 6, [float("nan")] * 24, 1), (k + 7, [None] * 24, 1), (k + 8, [float("inf")] * 24, 1), (k + 9, [1.0, 2.0], 1), (k + 10, [2.0, 4.0], 1)]
    table = spark.createDataFrame([(*r, "n") for r in rows], "vec_id long, embedding array<double>, label int, n_links string").repartition(3)
    got = {r.vec_id: r for r in lattice.lattice_near_duplicates(table, 0.98, block=block).collect()}
    count, component = _brute_vectors(rows, 0.98)
    assert {i: r.n_links for i, r in got.items()} == {rows[a][0]: n for a, n in count.items()}
    assert {i: r.component_id for i, r in got.items()} == component
    assert lattice.lattice_near_duplicates(table.where("false")).count() == 0


def test_lattice_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    d = rng.standard_normal((4000, 64))
    d -= (d * a).sum(1)[:, None] * a
    d /= np.linalg.norm(d, axis=1)[:, None]
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * d
    zero = np.zeros(4000, np.int64)
    (ha, pa), (hb, pb) = (lattice.lattice_cells(x, zero, lattice.TABLES, lattice.PROBES, lattice.SCALE, 8) for x in (a, b))
    met = (ha == hb) | (pa == hb[:, :, None]).any(2) | (pb == ha[:, :, None]).any(2)
    assert met.any(1).mean() > 0.99


# chat


def test_chat_links_quotes(spark):
    rows = [
        (1, 0, "user", "Where is the  File?"),
        (1, 1, "assistant", "> where is the file?\nIn the drawer.\nOn top."),
        (1, 2, "user", "> in the drawer. on top.\n>> Where is the file?\n\nThanks\n> unknown words"),
        (1, 3, "assistant", "no quote"),
        (2, 0, "user", "> No Quote\nfrom elsewhere"),
        (2, 1, None, None),
        (2, 2, "user", "> later\nx"),
        (2, 3, "user", "later"),
        (2, 3, "user", "later"),
        (None, 0, "user", "hi"),
        (3, 0, "user", "> \n>\n"),
    ]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, body string")
    got = {(r.conv_id, r.turn): r for r in chat.format_chat(table).collect()}
    assert len(got) == 10
    assert (got[1, 1].parent_turn, got[1, 1].body, got[1, 1].n_quotes, got[1, 1].n_linked) == (0, "In the drawer.\nOn top.", 1, 1)
    assert (got[1, 2].parent_turn, got[1, 2].n_quotes, got[1, 2].n_linked, got[1, 2].thread, got[1, 2].depth) == (1, 3, 2, 0, 2)
    assert got[1, 2].body == "Thanks"
    assert (got[1, 3].thread, got[1, 3].depth, got[1, 3].formatted) == (3, 0, "<|assistant|>\nno quote")
    assert (got[2, 0].source_conv, got[2, 0].source_turn, got[2, 0].parent_turn) == (1, 3, None)
    assert (got[2, 1].body, got[2, 1].formatted) == ("", "<|unknown|>\n")
    assert (got[2, 2].n_quotes, got[2, 2].n_linked) == (1, 0)
    assert (got[3, 0].n_quotes, got[3, 0].body) == (0, "")
    assert chat.format_chat(table.where("false")).count() == 0


def _chat_by_hand(rows):
    """What ``format_chat`` promises, message by message: (conv_id, turn) to (n_quotes, n_linked, source, parent, body)."""
    normal = lambda t: re.sub(r"[\s\xa0]+", " ", t.lower()).strip(" ")
    cuts = (r"\n\s*\n", r"\n", r"(?<=[.!?])\s+|(?<=[\u3002\uff01\uff1f])\s*|\n\s*\n", r"(?<=[.!?])\s+|(?<=[\u3002\uff01\uff1f])\s*|\n")

    def pieces(text, cut):
        return [p for p in map(normal, re.split(cut, text)) if p]

    def passages(text):
        out = []
        for line in re.sub("\r\n?", "\n", text or "").split("\n"):
            marks = re.match(r"[ \t]*>[> \t]*", line)
            level = marks.group().count(">") if marks else 0
            line = line[marks.end() :] if marks else line
            if out and out[-1][0] == level:
                out[-1][1].append(line)
            else:
                out.append((level, [line]))
        return [(level, "\n".join(lines)) for level, lines in out]

    said = {}
    for conv, turn, text in rows:
        for level, passage in passages(text):
            if level == 0 and normal(passage):
                for h in {normal(passage), *(p for cut in cuts for p in pieces(passage, cut))}:
                    at = said.setdefault(h, {})
                    at[conv] = min(turn, at.get(conv, turn))
    out = {}
    for conv, turn, text in rows:
        quotes, linked, reply, last, body = 0, 0, None, None, []
        for level, passage in passages(text):
            if level == 0:
                body.append(passage)
            elif normal(passage):
                quotes += 1
                votes = {}
                for k, parts in enumerate([[normal(passage)], *(pieces(passage, cut) for cut in cuts)]):
                    for part in parts:
                        at = said.get(part, {})
                        sources = [(0, conv, at[conv])] if at.get(conv, turn) < turn else []
                        sources += [(1, c, at[c]) for c in sorted(at) if c != conv][:1]
                        for source in sources:
                            votes[k, source] = votes.get((k, source), 0) + len(part.replace(" ", ""))
                if votes:
                    linked += 1
                    last = min((-n, source) for (_, source), n in votes.items())[1]
                    reply = last if last[0] == 0 and level == 1 else reply
        source = (reply or last or (0, None, None))[1:]
        body = "\n".join(body).strip(" \t\n\x0b\f\r") if re.search(r"(?m)^[ \t]*>", text or "") else text or ""
        out[conv, turn] = (quotes, linked, source, reply and reply[2], body)
    return out


def test_chat_by_brute_force(spark):
    rng = random.Random(21)
    said = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    assert len({(c, t) for c, t, *_ in said}) == len(said)
    rows, earlier = [], []
    for conv, turn, role, text in sorted(said, key=lambda r: r[:2]):
        parts = []
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            source = rng.choice(earlier[-6:] + earlier[-60:-50] or [""])
            words = source.split(" ")
            cut = sorted(rng.choice([0, 0, len(words), len(words), rng.randrange(len(words))]) for _ in range(2))
            level = rng.choice([1, 1, 1, 2, 3])
            quoted = rng.choice([str.upper, str, str.title])(" ".join(words[cut[0] : cut[1]]) or source)
            parts += [rng.choice([">", "> ", " >"]) * level + line for line in re.sub(r"([.!?]) ", rng.choice([r"\1\n", r"\1 ", r"\1\n\n"]), quoted).split("\n")]
            parts += rng.choice([[], [""], ["  so " + rng.choice(words)]])
        earlier.append(text or "")
        rows.append((conv, turn, role, rng.choice(["\n", "\n", "\r\n"]).join([*parts, text or ""])))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {(r.conv_id, r.turn): (r.n_quotes, r.n_linked, (r.source_conv, r.source_turn), r.parent_turn, r.body) for r in chat.format_chat(table).collect()}
    want = _chat_by_hand([(c, t, x) for c, t, _, x in rows])
    assert sum(w[1] > 0 for w in want.values()) > 100
    assert [(k, got[k], w) for k, w in want.items() if got[k] != w] == []


def test_chat_of_very_long_messages(spark):
    n = 100_000
    rows = [(0, ">" * n + " deep"), (1, "\n".join(f"> l{k}" if k % 2 else "own" for k in range(n))), (2, "\n" * n + "x" + "\n" * n), (3, "> " * n + "\n> y" + "\n>" * n + "\nz" + "\n " * n), (4, "a" + " \n" * n + "> q")]
    table = spark.createDataFrame(rows, "turn long, text string").selectExpr("1L as conv_id", "turn", "'user' as role", "text")
    got = {r.turn: r for r in chat.format_chat(table).collect()}
    assert [(got[k].n_quotes, len(got[k].body)) for k in range(5)] == [(1, 0), (n // 2, 4 * (n // 2) - 1), (0, 2 * n + 1), (1, 1), (1, 1)]


def test_reply_threads_follow_long_chains(spark):
    edges = spark.createDataFrame([(1, k, k - 1) for k in range(1, 40)], "conv_id long, turn long, parent long")
    got = {r.turn: (r.thread, r.depth) for r in chat.reply_threads(edges).collect()}
    assert got == {k: (0, k) for k in range(1, 40)}


# sharding


def test_hilbert_index_is_a_curve(spark):

    for n, bits in ((2, 3), (3, 2), (3, 3)):
        cells = spark.range(1 << (n * bits)).select(*[F.expr(f"cast(shiftright(id, {bits * k}) & {(1 << bits) - 1} as int)").alias(f"c{k}") for k in range(n)])
        got = sorted((r.h, r[:n]) for r in cells.withColumn("h", sharding.hilbert_index([F.col(f"c{k}") for k in range(n)], bits)).collect())
        assert [h for h, _ in got] == list(range(1 << (n * bits)))
        assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for (_, a), (_, b) in zip(got, got[1:], strict=False))


def test_shards_of_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(i, None if i % 5 == 0 else "té" * (i % 7), "s" if i % 3 else None, "t") for i in range(11)] + [(3, "same", "s", "t")] * 30 + [(None, "", None, "t")], "doc_id long, text string, source string, shard string")
    for table, lane_rows in ((docs, sharding.LANE_ROWS), (odd, sharding.LANE_ROWS), (docs, 7), (odd, 3)):
        texts = table.select("doc_id", "text").collect()
        got = sharding.hilbert_shards(table, lane_rows=lane_rows).collect()
        assert len(got) == len(texts)
        by = {}
        for r in got:
            assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 40
            by.setdefault(r.shard, []).append(r)
        counts = [len(by.get(s, [])) for s in range(40)]
        assert max(counts) - min(counts) <= 1
        for own in by.values():
            assert sorted(r.slot for r in own) == list(range(len(own)))
        ordered = sorted(got, key=lambda r: (r.shard, r.slot))
        assert [r.curve for r in ordered] == sorted(r.curve for r in got)
        want = sorted((len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in texts)
        assert sorted((r.size, r.text_crc32) for r in got) == want
    assert sharding.hilbert_shards(docs.where("false")).count() == 0


def test_quantiles_by_brute_force(spark):
    rng = random.Random(31)
    # a common beginning, very common values and nulls
    values = [None, *(f"https://www.site-{rng.randrange(40):04d}.test/{rng.choice('ab')}" for _ in range(700)), *["https://www.hot.test/"] * 300]
    rows = spark.createDataFrame([(v, rng.randrange(90)) for v in values], "source string, n int").repartition(3)
    known = sorted(v for v in values if v is not None)
    levels = [k / 16 for k in range(1, 16)]
    bounds = [known[math.ceil(x * len(known)) - 1] for x in levels]
    assert sharding._bounds_of_words(rows, "source", levels) == bounds
    got = sharding.quantised(rows, ["source", "n"], 4).collect()
    assert all(r._q0 == (0 if r.source is None else sum(r.source >= b for b in set(bounds))) for r in got)
    assert len({r._q0 for r in got}) > 8 and {r._q1 for r in got} == set(range(16))


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline
    from weftscan.llm import store

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = store.materialize(corpus_pipeline.quality_stage(spark, docs, SF))
    second = store.materialize(corpus_pipeline.toxicity_stage(spark, first, SF))
    third = store.materialize(corpus_pipeline.near_duplicate_stage(spark, second, SF))
    assert first.columns == second.columns == third.columns == docs.columns
    assert docs.count() > first.count() > second.count() >= third.count() > 0
    component, _ = _brute_near([(r.doc_id, r.text) for r in second.collect()], 5, 80)
    assert {r.doc_id for r in third.collect()} == set(component.values())
    pieces = corpus_pipeline.packing_stage(spark, third, SF)
    assert {r.doc_id for r in pieces.collect()} == set(component.values())
    assert corpus_pipeline.run(spark, SF).columns == pieces.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
