"""Cost-balanced packing of documents into training sequences.

A sequence of pieces of lengths l costs sum(linear * l + quadratic * l * l): the second
term is attention inside a piece. Documents, in descending length, go whole to the
sequence of lowest cost that still has room; a document that fits nowhere is cut over
the sequences of lowest cost that have any room.

Packing is done where the rows are. A task encodes its documents, emits the full-length
pieces at once and packs the remainders in windows of bounded size, so there is no shuffle
and a task holds at most ``window_tokens`` ids. The sequences of a window are planned so
that they fill exactly: as many of ``capacity`` tokens as there are, and the rest as
powers of two, which training pads no further.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftscan.llm.chunks import library_encoder, pack_ids

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequences of one task are numbered below this.
_PER_TASK = 1 << 40


def bin_capacities(tokens: int, capacity: int) -> list[int]:
    """Full sequences for ``tokens``, and powers of two for what is left of them."""
    full, rest = divmod(tokens, capacity)
    return [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_lengths(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start in the item, length, sequence, offset in it) of all items.

    Items of length 0 have no piece. Ties are broken by the item's number, then the sequence's. Every
    sequence is filled to its planned capacity, so the sum of lengths is covered exactly.
    """
    rooms = bin_capacities(sum(lengths), capacity)
    planned = list(rooms)
    with_room = [0] * (capacity + 1)  # sequences by room left, to know at once that an item fits nowhere
    for r in rooms:
        with_room[r] += 1
    most = max(rooms, default=0)
    cheapest = [(0.0, k) for k in range(len(rooms))]
    heapq.heapify(cheapest)
    pieces = []
    for item in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        start, left = 0, lengths[item]
        while left:
            while not with_room[most]:
                most -= 1
            wanted, passed = (left if left <= most else 1), []
            cost, k = heapq.heappop(cheapest)
            while rooms[k] < wanted:
                passed.append((cost, k))
                cost, k = heapq.heappop(cheapest)
            room = rooms[k]
            taken = left if left < room else room
            pieces.append((item, start, taken, k, planned[k] - room))
            with_room[room] -= 1
            rooms[k] = room - taken
            if room > taken:
                with_room[room - taken] += 1
                heapq.heappush(cheapest, (cost + linear * taken + quadratic * taken * taken, k))
            for x in passed:
                heapq.heappush(cheapest, x)
            start, left = start + taken, left - taken
    return pieces


def _windows(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, window_tokens: int, linear: float, quadratic: float) -> Iterator[pa.RecordBatch]:
    encoder, end = library_encoder(path), pack_ids([end_id])
    next_id = TaskContext.get().partitionId() * _PER_TASK
    rows: list[tuple] = []
    waiting: list[tuple[int | None, int, int, bytes]] = []  # doc_id, start, doc_tokens, packed ids of a remainder
    held = 0

    def flush() -> None:
        nonlocal next_id, held
        pieces = pack_lengths([len(w[3]) // 4 for w in waiting], capacity, linear, quadratic)
        for item, at, length, sequence, offset in pieces:
            doc_id, start, total, ids = waiting[item]
            rows.append((doc_id, start + at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), total, next_id + sequence, offset))
        next_id += 1 + max((p[3] for p in pieces), default=-1)
        waiting.clear()
        held = 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 7
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
        rows.clear()
        return out

    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                ids += end
                total, start = len(ids) // 4, 0
                while total - start >= capacity:
                    rows.append((doc_id, start, capacity, zlib.crc32(ids[4 * start : 4 * (start + capacity)]), total, next_id, 0))
                    start, next_id = start + capacity, next_id + 1
                if start < total:
                    waiting.append((doc_id, start, total, ids[4 * start :]))
                    held += total - start
                if held >= window_tokens:
                    flush()
                if len(rows) >= 20_000:
                    yield batch()
    flush()
    yield batch()


def cost_balanced_packing(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 0,
    capacity: int = 1024,
    window_tokens: int = 4_000_000,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
) -> DataFrame:
    """Pack the token ids of ``docs`` (doc_id, text) into sequences of ``capacity`` tokens.

    One row for each piece: doc_id, start (ids of the document before it), length,
    ids_crc32, doc_tokens (with ``end_id``), sequence_id, offset (in the sequence, gapless).

    Defined cases: a null or empty text is the end id alone; a null doc_id stays null; repeated
    rows are packed each by itself; a text of any length is cut into full pieces as it
    is read; an empty table gives no rows; other columns of ``docs`` are not read. Ties
    in length go by the order of rows in the task. The layout of sequences follows the
    partitions of the input; which ids are covered does not.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda it: _windows(it, tokenizer_path, end_id, capacity, window_tokens, linear, quadratic), SCHEMA
    )
