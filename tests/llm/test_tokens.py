"""Token counts, token files, byte-level BPE and packing against the libraries and brute force."""

import base64
import functools
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftscan.llm import byte_bpe, packing, token_counts, token_files
from weftscan.llm.chunks import library_encoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_tokens string, start string"
ODD = [
    None, "", " ", "\n", "a", "  two  spaces ", "tab\tand\r\nlines\n\n\nend ", "don't we'll 's 'S I'M", "日本語 テキスト é é", "x" * 3000,
    "<|endoftext|> <|startoftext|>", "hello <|endoftext|> world", "<|ENDOFTEXT|>", "a.<|endoftext|>b, c.", "x <|endoftext|", "<|endoftext|>\n\n <|endoftext|>.", "İstanbul ΑΣ ΟΔΟΣ", "BİLGİ. ALİ, gel", "a b c　d", "\x1c\x1d x\x1ey \x85z", "\x00nul \x00", "1234567 12 3.14", "🙂🙂 👩‍👩‍👧", "word," * 50, "#*$%&|<>",
]


@functools.cache
def _tokenizer(name):
    return Tokenizer.from_file(P.path(name))


def _library(name, text):
    return _tokenizer(name).encode(text or "", add_special_tokens=False).ids


def _tiktoken():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def _odd(spark):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(ODD)], SCHEMA).repartition(3)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunked_encoding_equals_library(name):
    rng = random.Random(5)
    texts = [t for t in ODD if t] + ["".join(rng.choice(["a", "b", " ", "c", "é", "\n", ".", ",", "'", "s", "1", " ", "\t", "中", " ", "<|", "endoftext|>", "<|endoftext|>"]) for _ in range(rng.randrange(60))) for _ in range(800)]
    for text, packed in zip(texts, library_encoder(P.path(name)).encode(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == _library(name, text), repr(text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_letters_with_case_before_stops(name):
    letters = [chr(k) for k in range(0x20000) if not 0xD800 <= k < 0xE000 and (chr(k).lower() != chr(k) or chr(k).upper() != chr(k))]
    texts = [f"a{c}. {c}, B{c}{c}.x {c}" for c in letters]
    for text, packed in zip(texts, library_encoder(P.path(name)).encode(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == _library(name, text), repr(text)


def test_unknown_pretokenizers_encode_whole_texts(tmp_path):
    import json

    written = json.load(open(P.path("word_bpe_49k.json")))
    written["normalizer"] = {"type": "Replace", "pattern": {"String": "a b"}, "content": "ab."}
    (tmp_path / "other.json").write_text(json.dumps(written))
    other = Tokenizer.from_file(str(tmp_path / "other.json"))
    texts = ["a b a b.", "ba bab, x", "", "a  b"]
    got = [np.frombuffer(x, "<u4").tolist() for x in library_encoder(str(tmp_path / "other.json")).encode(texts)]
    assert got == [other.encode(t, add_special_tokens=False).ids for t in texts]
    ranks = _tiktoken()._mergeable_ranks
    pattern = r"[a-z] [a-z]|\S|\s"
    own = tiktoken.Encoding("pairs", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["a b c d", "the cat. sat", "x y\nz"]
    assert [np.frombuffer(x, "<u4").tolist() for x in byte_bpe.ByteBPE(ranks, pattern).encode(texts)] == [own.encode_ordinary(t) for t in texts]


def test_rank_queue_bpe_equals_tiktoken():
    enc, rng = _tiktoken(), random.Random(7)
    bpe = byte_bpe.ByteBPE(enc._mergeable_ranks, P.PATTERN)
    texts = [t for t in ODD if t] + ["".join(rng.choice("aaaabcdeth eé\n.'s12 中") for _ in range(rng.randrange(200))) for _ in range(400)]
    texts += ["".join(chr(c) for c in range(k, k + 257) if not 0xD800 <= c < 0xE000) for k in range(0, 0x3000, 257)]
    for text, packed in zip(texts, bpe.encode(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == enc.encode_ordinary(text), repr(text)
        assert bpe.decode(packed) == text.encode()
    pieces = [b"a" * 5000, b"ab" * 2000, bytes(rng.choice(b"etaoins") for _ in range(20000)), bytes(range(256)), b"q"]
    merges = byte_bpe.Merges(enc._mergeable_ranks)
    assert byte_bpe.merge_pretokens(pieces, merges) == [enc._encode_single_piece(piece) for piece in pieces]
    assert byte_bpe.merge_pretokens([], merges) == []


def test_rank_queue_with_ranks_that_fall():
    # joins may rank below what they are made of; then the rest of a bucket waits
    rng = random.Random(17)
    for _ in range(60):
        tokens = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(rng.randrange(1, 40))}
        order = rng.sample(sorted(tokens), len(tokens))
        ranks = {bytes([b]): 1000 + b for b in range(256)} | {t: k for k, t in enumerate(order)}
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 30))) for _ in range(20)]
        for piece, got in zip(pieces, byte_bpe.merge_pretokens(pieces, byte_bpe.Merges(ranks)), strict=True):
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while True:
                best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            assert got == [ranks[p] for p in parts]


def test_bpe_query_on_odd_rows(spark):
    enc = _tiktoken()
    got = {r.doc_id: r for r in byte_bpe.bpe_round_trip(_odd(spark), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    for i, t in enumerate(ODD):
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = byte_bpe.bpe_encode(_odd(spark), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    decoded = byte_bpe.bpe_decode(encoded, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded) for r in decoded} == {i: (t or "").encode() for i, t in enumerate(ODD)}


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_on_odd_rows(spark, tmp_path, encoding):
    import pyarrow.parquet as pq

    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(_odd(spark), path, P.path("word_bpe_49k.json"), end_id=2, encoding=encoding, ranges=3)
    got = token_files.token_file_digest(token_files.read_token_files(spark, path)).orderBy("doc_id").collect()
    start = 0
    for r, t in zip(got, ODD, strict=True):
        ids = [*_library("word_bpe_49k.json", t), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), _crc(ids))
        start += len(ids)
    files = sorted(tmp_path.glob("tokens/part-*.parquet"))
    ids = [x for f in files for x in pq.read_table(f)["doc_id"].to_pylist()]
    assert ids == sorted(ids)
    used = {e for f in files for g in [pq.ParquetFile(f).metadata.row_group(0)] for e in g.column(4).encodings if g.num_rows > 4}
    assert ("DELTA_BINARY_PACKED" in used) == (encoding == "delta")
    assert all(pq.ParquetFile(f).metadata.row_group(0).column(0).has_offset_index for f in files)


def test_token_files_of_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = token_files.token_files_round_trip(docs, P.path("word_bpe_49k.json"), end_id=2).orderBy("doc_id").collect()
    start = 0
    for r, d in zip(got, docs.orderBy("doc_id").collect(), strict=True):
        ids = [*_library("word_bpe_49k.json", d.text), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), _crc(ids))
        start += len(ids)


def test_empty_tables(spark):
    none = _odd(spark).where("false")
    assert token_files.token_files_round_trip(none, P.path("word_bpe_49k.json")).count() == 0
    assert packing.cost_balanced_packing(none, P.path("byte_bpe_50k.json")).count() == 0
    assert token_counts.token_counts(none, P.path("byte_bpe_50k.tiktoken")).count() == 0
    assert byte_bpe.bpe_round_trip(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def _check_packing(docs, pieces):
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        ids, at = [*_library("byte_bpe_50k.json", texts[doc_id]), 0], 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length >= 1 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == _crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)


def test_packing_covers_each_id_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    for frame in (docs, _odd(spark)):
        _check_packing(frame, packing.cost_balanced_packing(frame, P.path("byte_bpe_50k.json"), window_tokens=20_000).collect())


def test_packing_takes_cheapest_sequence_with_room():
    rng = random.Random(3)
    for _ in range(50):
        lengths = [rng.randrange(0, 64) for _ in range(rng.randrange(1, 60))]
        pieces = packing.pack_lengths(lengths, 64, 1.0, 0.01)
        capacities, used, cost = packing.bin_capacities(sum(lengths), 64), {}, {}
        want = []
        for item in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            start, left = 0, lengths[item]
            while left:
                fits = [b for b, c in enumerate(capacities) if c - used.get(b, 0) >= left] or [b for b, c in enumerate(capacities) if c > used.get(b, 0)]
                b = min(fits, key=lambda b: (cost.get(b, 0.0), b))
                taken = min(left, capacities[b] - used.get(b, 0))
                want.append((item, start, taken, b, used.get(b, 0)))
                used[b], cost[b] = used.get(b, 0) + taken, cost.get(b, 0.0) + taken + 0.01 * taken * taken
                start, left = start + taken, left - taken
        assert pieces == want
        assert [used.get(b, 0) for b in range(len(capacities))] == capacities


def _greedy(word, vocabulary):
    at = pieces = 0
    while at < len(word):
        for stop in range(len(word), at, -1):
            if word[at:stop] in vocabulary:
                break
        else:
            return 1
        at, pieces = stop, pieces + 1
    return pieces


def test_automaton_equals_greedy_match():
    rng = random.Random(11)
    for _ in range(300):
        vocabulary = {bytes(rng.choices(b"abc", k=rng.randrange(1, 5))) for _ in range(rng.randrange(1, 12))}
        automaton = token_counts.LongestMatchAutomaton(vocabulary)
        for _ in range(30):
            word = bytes(rng.choices(b"abc", k=rng.randrange(0, 12)))
            assert automaton.count(word) == _greedy(word, vocabulary), (vocabulary, word)


def test_token_counts_on_whole_table_and_odd_rows(spark):
    vocabulary = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    for docs in (_odd(spark), spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") < 4000)):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        got = token_counts.token_counts(docs, P.path("byte_bpe_50k.tiktoken")).collect()
        assert {r.doc_id: (r.n_words, r.n_tokens) for r in got} == {k: (len(t.encode().split()), sum(_greedy(b" " + w, vocabulary) for w in t.encode().split())) for k, t in texts.items()}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_and_the_marks_after_them_are_learnt_apart(name):
    rng = random.Random(7)
    marks = [chr(k) for k in range(0x21, 0x7F) if not chr(k).isalnum()]
    words = ["".join(rng.choice("abcXYZéñßÀǅİĲɏ") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    texts = [" ".join(w + "".join(rng.choice(marks) for _ in range(rng.randrange(4))) + rng.choice(["", "", "", "s", "1", "é."]) for w in words[k : k + 30]) for k in range(0, len(words), 30)]
    encoder = library_encoder(P.path(name))
    for text, packed in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == _library(name, text), repr(text)
    encoder.encode(["qqzétqq$$$ qqzunqq,%%%"])
    assert any(w.strip() == "qqzétqq" for w in encoder._memo) and any(w.strip() == "qqzunqq" for w in encoder._memo)


def test_words_with_bytes_that_the_vocabulary_lacks(tmp_path):
    import json

    from tokenizers import models, pre_tokenizers

    few = Tokenizer(models.BPE(vocab={"a": 0, "b": 1, "Ġ": 2, "ab": 3, "Ċ": 4}, merges=[("a", "b")]))
    few.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    few.save(str(tmp_path / "few.json"))
    assert json.loads(few.to_str())["pre_tokenizer"]["type"] == "ByteLevel"
    texts = ["ab abx xab", "é aéb xx ab\nba", "ab ba"]
    got = [np.frombuffer(x, "<u4").tolist() for x in library_encoder(str(tmp_path / "few.json")).encode(texts)]
    assert got == [few.encode(t, add_special_tokens=False).ids for t in texts]
