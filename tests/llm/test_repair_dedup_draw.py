"""Conversation repair, exact duplicates and importance resampling against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from weftscan.llm import conversation_repair as cr
from weftscan.llm import exact_dedup, importance

SHAPE = re.compile(r"(s?(ua)+)?\Z")


# Conversation repair


def _exhaustive(symbols):
    """The least (cost, audit) over all edits with at most two insertions between messages."""
    gaps = ["", "u", "a", "ua", "au", "uu", "aa"]
    best = None
    for edits in itertools.product("DKua", repeat=len(symbols)):
        if any(forced and e != "D" for e, (_, forced, _) in zip(edits, symbols, strict=True)):
            continue
        for between in itertools.product(gaps, repeat=len(symbols) + 1):
            out, audit, cost = between[0], "I" * len(between[0]), 3 * sum(map(len, between))
            for e, (initial, _, cut), new in zip(edits, symbols, between[1:], strict=True):
                cost += {"D": 4, "K": 0}.get(e, 3) + (3 if cut and e != "D" else 0)
                out += {"D": "", "K": initial or "?"}.get(e, e) + new
                audit += {"D": "D", "K": "K"}.get(e, "R") + "I" * len(new)
            if SHAPE.match(out) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def _plain(symbols):
    """The same by a table over the four places of the shape, for any length."""
    after = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def widen(t):
        for _ in range(4):
            for (p, c), q in after.items():
                if c != "s" and p in t:
                    t[q] = min(t.get(q, (10**9, "")), (t[p][0] + 3, t[p][1] + "I"))
        return t

    t = widen({"0": (0, "")})
    for initial, forced, cut in symbols:
        new = {}
        for p, (cost, audit) in t.items():
            ways = [(p, 4, "D")]
            if not forced:
                ways += [(q, 3 * cut, "K") for (o, c), q in after.items() if o == p and c == initial]
                ways += [(q, 3 * cut + 3, "R") for (o, c), q in after.items() if o == p and c != "s"]
            for q, more, e in ways:
                new[q] = min(new.get(q, (10**9, "")), (cost + more, audit + e))
        t = widen(new)
    return min(t[p] for p in ("0", "a") if p in t)


def _symbols(rng, n):
    return [(rng.choice(["s", "u", "a", "u", "a", "x", ""]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]


def test_parser_finds_the_cheapest_least_edits():
    rng = random.Random(5)
    for n in (0, 1, 2, 2, 2, 3, 3):
        s = _symbols(rng, n)
        assert cr.completed(cr.parse(cr.first_chart(), s)) == _exhaustive(s) == _plain(s), s
    for _ in range(400):
        s = _symbols(rng, rng.randrange(0, 40))
        assert cr.completed(cr.parse(cr.first_chart(), s)) == _plain(s), s


def test_a_conversation_in_blocks_is_parsed_as_a_whole():
    rng = random.Random(6)
    for _ in range(60):
        s = _symbols(rng, rng.randrange(2, 30))
        cuts = sorted({0, len(s), *(rng.randrange(1, len(s)) for _ in range(3))})
        chain = cr._Chain(1)
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            block = cr._Block(1, k == 0)
            for initial, forced, cut in s[a:b]:
                block.add(None, initial, "", "blank" if forced else "truncated" if cut else "")
            chain.add(block.closed(k, False))
        parts = chain.ended()
        assert (parts[0]["cost"], parts[0]["audit"]) == _plain(s)
        assert "".join(p["edits"] for p in sorted(parts, key=lambda p: p["part"])) == parts[0]["audit"]


def _visible(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text)


def _expected(rows):
    """The query's rows by hand from (conv_id, turn, role, text)."""
    said = lambda v: " " if v is None else str(v)
    out = {}
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        held += [(turn, role, text)] * (2 if kind == 3 else 1)
    result = {}
    for conv, held in out.items():
        held.sort(key=lambda r: ((0, 0) if r[0] is None else (1, r[0]), r[1].encode(), r[2].encode()))
        seen, symbols, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in held:
            fault = "blank" if not _visible(text) else "duplicate" if (role, text) in seen else "truncated" if _visible(text)[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            symbols.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(symbols))
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = _plain(symbols)
        lines, place, source = [], "", iter(held)
        for e in audit:
            _, role, text = next(source) if e != "I" else (0, "", "")
            if e in "RI":
                role = "assistant" if place.endswith("u") else "user"
            if e != "D":
                place += role[0]
                lines.append(f"{role}:{text}")
        assert SHAPE.match(place)
        result[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return result


def _repaired(spark, rows, parts=3):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"copies": F.lit("x"), "first": F.lit(1), "kind": F.lit(2)}).repartition(parts)
    got = cr.damaged_and_repaired(table).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_conversations_are_damaged_and_repaired_as_by_hand(spark):
    rng = random.Random(7)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User"], ["Yes.", "No", " \t\n", "", None, "Why? ", "é!", "A long one. ", "two\nlines."]
    rows = [(c, rng.choice([t, t, t, None, t // 2]), rng.choice(roles[:2] * 4 + roles), rng.choice(texts)) for c in range(120) for t in range(rng.randrange(1, 9))]
    rows += [(None, t, rng.choice(roles), rng.choice(texts)) for t in range(30)]
    # one conversation with much more than a block, one of equal rows, one whose turns are all null
    rows += [(500, t, rng.choice(roles[:2]), rng.choice(texts) if t % 3 else f"text {t}.") for t in range(3000)]
    rows += [(501, 4, "user", "the same.")] * 2000 + [(502, None, rng.choice(roles[:3]), f"n {t}") for t in range(40)]
    rows += [(503, 1, "user", "word " * 200_000 + ".")]
    rng.shuffle(rows)
    assert _repaired(spark, rows) == _expected(rows)
    assert _repaired(spark, []) == {}


def test_repaired_messages_are_given_with_their_edits(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hello there."), (1, 2, "user", "And this?"), (1, 3, "assistant", "")]
    repair = cr.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    (c,) = repair.conversations.collect()
    assert (c.n_messages, c.blank, c.illegal, c.cost, c.audit) == (4, 1, 1, 7, "KKRD")
    (m,) = repair.messages.collect()
    assert [tuple(x) for x in m.messages] == [("system", "Be brief.", "K"), ("user", "Hello there.", "K"), ("assistant", "And this?", "R")]


# Exact duplicates


def _groups(rows, largest=True):
    out = []
    for doc_id, text in rows:
        same = [d for d, t in rows if (t or "") == (text or "")]
        ids = [d for d in same if d is not None]
        keep = (max if largest else min)(ids) if ids else None
        out.append((doc_id, keep, len(same), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("largest", [True, False])
def test_exact_duplicates(spark, largest):
    rng = random.Random(8)
    rows = [(k, rng.choice(["", None, "a", "A", "a ", "é", "é", f"t{k % 37}", f"only {k}", "x" * 100_000])) for k in range(300)]
    rows += [(None, "no id"), (None, "no id"), (None, "a"), (7, "again"), (7, "again"), (7, "other"), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"mark": F.lit(1), "lane": F.lit("x"), "keep_id": F.lit(2)}).repartition(70)
    got = exact_dedup.exact_duplicates(table, largest).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == _groups(rows, largest)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.exact_duplicates(table.where("false"), largest).count() == 0


def test_merge_keeps_apart_what_only_shares_a_digest():
    a, b = exact_dedup.Entry(b"d" * 32 + b"1" * 16, (1, 5, 0), 2), exact_dedup.Entry(b"d" * 32 + b"2" * 16, (1, 9, 1), 3)
    assert list(exact_dedup.merged([[a, b], [a], [b]], True)) == [a._replace(rows=4), b._replace(rows=6)]


# Importance resampling


def _drawn(docs, target, longest, buckets, percent, least, seed):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    features = lambda t: [" ".join(w[i : i + n]) for w in [words(t)] for i in range(len(w)) for n in range(1, longest + 1) if i + n <= len(w)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in features(text):
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for d, text in docs:
        f = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= least])
    order = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_a_full_trie_is_begun_anew_without_losing_counts():
    rng = random.Random(4)
    words = [rng.choice([b"a", b"b", b"c"]) + b"%d" % rng.randrange(40) for _ in range(2000)]
    small, large = (importance.Trie(3, 97, nodes=n) for n in (10, 10**6))
    for trie in (small, large):
        for node in trie.walk(words):
            node.count += 1
        trie.begin_anew()
    want = [0] * 97
    for i in range(len(words)):
        for n in (1, 2, 3):
            if i + n <= len(words):
                want[zlib.crc32(b" ".join(words[i : i + n])) % 97] += 1
    assert small.counted.tolist() == large.counted.tolist() == want


@pytest.mark.parametrize("longest", [1, 3])
def test_importance_resampling(spark, longest):
    rng = random.Random(9)
    vocabulary = ["the", "The", "ÉTÉ", "été", "x1", "a-b", "…", "word", "[^]", "tail end", "1990"] + [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for k in range(300)]
    docs += [(None, "some words " * 12), (None, None), (3, ""), (4, None), (5, "same text of twenty words " * 5), (5, "same text of twenty words " * 5), (6, "long " * 100_000)]
    target = ["the word été w1 w2 w3", "x1 word", None, ""]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(1), "row": F.lit("x"), "n_words": F.lit(0)}).repartition(5)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    options = dict(longest=longest, buckets=97, percent=10, least_words=20, seed=11)
    got = importance.importance_resample(d, t, **options).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == _drawn(docs, target, longest, 97, 10, 20, 11)
    none = importance.importance_resample(d.where("false"), t, **options)
    assert none.count() == 0 and importance.importance_resample(d, t.where("false"), **options).count() == len(docs)
