"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of parts over its bytes. Adjacent parts whose join
is in the vocabulary are candidates: their left position waits in the bucket of the join's rank.
Which buckets have entries is kept in a two-level bitmap, so the next rank is two
find-first-set steps away however many ranks and candidates there are. Within a
bucket, positions are taken in ascending order. A position is stale when its part has since
been merged away or joins to another rank; it is skipped when it comes up. The pre-tokens of a
batch share one queue, as merges in one do not touch another.

A pre-token of n bytes takes O(n log n) steps in all, so a megabyte without white space
is encoded as safely as a word.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftscan.llm.chunks import ChunkEncoder, pack_ids, split_leading_space, whole_text

_WORD_BITS = 256
#: Bytes of pre-tokens that share a queue; a longer pre-token has one of its own.
_AT_ONCE = 200_000
#: Chunks remembered in a generation of the memo; see ``ChunkEncoder``.
MEMO_ENTRIES = 400_000
# Fixed value: the pre-token pattern that ``split_leading_space`` is right for.
_KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class RankQueue:
    """Buckets of linked-list positions by merge rank, and a bitmap of the buckets that have entries in two levels.

    The lowest rank is two find-first-set steps away, however many ranks and positions wait.
    """

    __slots__ = ("buckets", "top", "words")

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.words: dict[int, int] = {}
        self.top = 0

    def open(self, rank: int, position: int) -> None:
        """Begin the bucket of a rank that has none."""
        self.buckets[rank] = [position]
        w = rank // _WORD_BITS
        self.words[w] = self.words.get(w, 0) | 1 << rank % _WORD_BITS
        self.top |= 1 << w

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank with its bucket, which leaves the queue."""
        if not self.top:
            return None
        w = (self.top & -self.top).bit_length() - 1
        word = self.words[w]
        low = word & -word
        self.words[w] = word ^ low
        if word == low:
            self.top ^= 1 << w
        rank = w * _WORD_BITS + low.bit_length() - 1
        return rank, self.buckets.pop(rank)


class Merges:
    """Which two tokens join to which: the rank of every cut of a token into two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values(), default=0) + 2
        self.joined = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.joined[left * self.size + right] = rank
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)])
        # for pairs of bytes; 256 stands for a wall
        self.of_pair = np.full((257, 257), -1)
        for a, b in itertools.product(range(256), repeat=2):
            self.of_pair[a, b] = ranks.get(bytes([a, b]), -1)


def merge_pretokens(pieces: list[bytes], merges: Merges) -> list[list[int]]:
    """The ids of pre-tokens: in each, always merge the lowest rank, leftmost first.

    All pieces are one linked list, with a part between them that joins with nothing, and share one queue, so a rank
    is found once for all of them. A bucket is worked off from left to right. Should a join have a lower
    rank than the bucket it came from, what is left of the bucket waits.
    """
    size, get = merges.size, merges.joined.get
    wall = size - 1
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    # a wall before each piece and one at the end
    n = raw.size + len(pieces) + 1
    place = np.arange(raw.size) + np.repeat(np.arange(1, len(pieces) + 1), lengths)
    bytes_at = np.full(n, 256)
    bytes_at[place] = raw
    parts = np.full(n, wall)
    parts[place] = merges.of_byte[raw]
    joins = merges.of_pair[bytes_at[:-1], bytes_at[1:]]
    part, join = parts.tolist(), joins.tolist()
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    queue = RankQueue()
    buckets, begin = queue.buckets, queue.open
    waiting = np.flatnonzero(joins >= 0)
    waiting = waiting[np.argsort(joins[waiting], kind="stable")]
    edges = np.flatnonzero(np.diff(joins[waiting], prepend=-1, append=-1))
    for a, z in itertools.pairwise(edges.tolist()):
        begin(join[waiting[a]], int(waiting[a]))
        buckets[join[waiting[a]]] += waiting[a + 1 : z].tolist()
    join.append(-1)
    while (found := queue.pop()) is not None:
        rank, bucket = found
        bucket.sort()
        right_of, left_of = rank * size, rank
        for at, i in enumerate(bucket):
            if join[i] != rank:
                continue  # stale: merged away, or the part has another neighbour by now
            middle = after[i]
            stop = after[middle]
            part[i], after[i], before[stop], join[middle] = rank, stop, i, -1
            least = rank
            join[i] = joined = get(right_of + part[stop], -1)
            if joined >= 0:
                if joined in buckets:
                    buckets[joined].append(i)
                else:
                    begin(joined, i)
                if joined < least:
                    least = joined
            left = before[i]
            join[left] = joined = get(part[left] * size + left_of, -1)
            if joined >= 0:
                if joined in buckets:
                    buckets[joined].append(left)
                else:
                    begin(joined, left)
                if joined < least:
                    least = joined
            if least < rank:
                for position in bucket[at + 1 :]:
                    if rank in buckets:
                        buckets[rank].append(position)
                    else:
                        begin(rank, position)
                break
    out, ids, i = [], [], after[0]
    while i < n:
        if part[i] == wall:
            out.append(ids)
            ids = []
        else:
            ids.append(part[i])
        i = after[i]
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBPE:
    """Encoder and decoder for ranks and a pre-token pattern, with a bounded memo of chunks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.merges = ranks, Merges(ranks)
        self.tokens = {i: t for t, i in ranks.items()}
        # \s of the pattern is Unicode's White_Space, without the four separators U+001C to U+001F
        self.find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        # other patterns may match across the cuts
        self._chunks = ChunkEncoder(self._encode_chunks, split_leading_space if pattern == _KNOWN_PATTERN else whole_text, MEMO_ENTRIES)

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        get, size = self.ranks.get, struct.Struct("<I").pack
        found = [[piece.encode() for piece in self.find(chunk)] for chunk in chunks]
        # what is one token as it is needs no merging; all other pre-tokens of the call are merged together
        merged: dict[bytes, bytes] = {}
        for pieces in found:
            for piece in pieces:
                if piece not in merged:
                    whole = get(piece)
                    merged[piece] = b"" if whole is None else size(whole)
        waiting = [piece for piece, ids in merged.items() if not ids]
        at = 0
        while at < len(waiting):
            end, held = at, 0
            while end < len(waiting) and (end == at or held + len(waiting[end]) <= _AT_ONCE):
                held += len(waiting[end])
                end += 1
            group = waiting[at:end]
            merged.update(zip(group, map(pack_ids, merge_pretokens(group, self.merges)), strict=True))
            at = end
        return [b"".join(map(merged.__getitem__, pieces)) for pieces in found]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids (little-endian unsigned 32-bit) of each text."""
        return self._chunks.encode(texts)

    def decode(self, packed: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return b"".join(map(self.tokens.__getitem__, memoryview(packed).cast("I")))


@functools.lru_cache(maxsize=2)
def _loaded(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(load_ranks(path), pattern)


def _round_trip(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = _loaded(path, pattern)
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            packed = bpe.encode(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                    pa.array([hashlib.sha256(bpe.decode(p)).hexdigest() for p in packed]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = _loaded(path, pattern)
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            packed = bpe.encode(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed_ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = _loaded(path, pattern)
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            raw = [bpe.decode(p or b"") for p in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], names=["doc_id", "decoded"])


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and packed_ids (little-endian unsigned 32-bit integers) of each text.

    Defined cases: a null text is encoded as the empty text, which has no ids; texts of any length
    are encoded whole; rows are independent, so repeats and null ids are kept as they
    are; an empty table gives no rows; other columns are not read.
    """
    return _inputs(docs).mapInArrow(lambda it: _encoded(it, ranks_path, pattern), "doc_id long, packed_ids binary")


def bpe_decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and decoded (bytes) for rows of ``bpe_encode``; null ids decode to no bytes."""
    return encoded.select("doc_id", "packed_ids").mapInArrow(lambda it: _decoded(it, ranks_path, pattern), "doc_id long, decoded binary")


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode and decode each text; doc_id, n_tokens, and digests of the ids and of the decoded bytes.

    Cases as in ``bpe_encode``; both steps run in one pass so ids never leave the task.
    """
    return _inputs(docs).mapInArrow(lambda it: _round_trip(it, ranks_path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
