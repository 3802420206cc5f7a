"""Exact duplicates by merging sorted runs of digests in a tree.

Each partition of the documents makes a run: its distinct texts as (digest, check) in order, with the identifier that stays and the number
of rows. Runs are then exchanged in rounds, as in a binomial tree with ``FAN_IN`` children: in each round the members of a
group of runs cut theirs by the next digits of the digest, each member takes the pieces of one digit, and merges them in
one pass over their heads. After as many rounds as the tree is high, a text is in one run only, and what stands beside it counts the
whole table. A run stays as long as it was, a text is in it once however many copies there are, and no task holds more than the runs of
one group.

Digests are SHA-256. Equality is verified at every merge by a second, unrelated checksum and the length of the text: entries that differ there
are kept apart, whatever their digests.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftscan.llm.store import materialize

FAN_IN_BITS = 3
#: Entries of a run; a partition with more distinct texts makes several.
RUN_ENTRIES = 500_000
_MARK = 48  # digest, checksum and length
_RUN = pa.schema([("slice", pa.int64()), ("group", pa.int64()), ("n", pa.int64()), ("marks", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())])
_RUN_DDL = "slice long, group long, n long, marks binary, ids binary, counts binary"
Best = tuple[int, int, int]


class Entry(NamedTuple):
    """A distinct text: what it is known by, the best row (has an identifier, identifier, place) so far, and its rows."""

    mark: bytes
    best: Best
    rows: int


def better(a: Best, b: Best, largest: bool) -> Best:
    """The row that stays: one with an identifier, the largest or smallest of them, the first of equal ones."""
    if largest:
        return max(a, b, key=lambda x: (x[0], x[1], -x[2]))
    return min(a, b, key=lambda x: (-x[0], x[1], x[2]))


def merged(runs: Iterable[Iterable[Entry]], largest: bool) -> Iterator[Entry]:
    """One run of sorted ``runs``: their heads are compared, and entries with one mark become one."""
    held: Entry | None = None
    for e in heapq.merge(*runs):
        if held is not None and held.mark == e.mark:
            held = Entry(e.mark, better(held.best, e.best, largest), held.rows + e.rows)
        else:
            if held is not None:
                yield held
            held = e
    if held is not None:
        yield held


def _packed(entries: list[Entry], slice_: int, group: int) -> dict:
    ids = b"".join(struct.pack("<bqq", *e.best) for e in entries)
    return {"slice": slice_, "group": group, "n": len(entries), "marks": b"".join(e.mark for e in entries), "ids": ids, "counts": struct.pack(f"<{len(entries)}q", *(e.rows for e in entries))}


def _unpacked(run: dict) -> Iterator[Entry]:
    marks = run["marks"]
    best, rows = struct.iter_unpack("<bqq", run["ids"]), struct.iter_unpack("<q", run["counts"])
    for k, (b, (n,)) in enumerate(zip(best, rows, strict=True)):
        yield Entry(marks[_MARK * k : _MARK * (k + 1)], b, n)


def _cut(entries: Iterable[Entry], bits: int) -> Iterator[tuple[int, list[Entry]]]:
    """The pieces of a run by the first ``bits`` bits of the digest, in order."""
    held: list[Entry] = []
    now = 0
    for e in entries:
        at = int.from_bytes(e.mark[:8]) >> (64 - bits) if bits else 0
        if held and at != now:
            yield now, held
            held = []
        now = at
        held.append(e)
    if held:
        yield now, held


def _first_runs(bits: int, largest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of the lanes in a partition, cut for the first exchange."""
        lanes: dict[int, dict[bytes, tuple[Best, int]]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lane, found in lanes.items():
                entries = sorted(Entry(mark, *v) for mark, v in found.items())
                yield pa.RecordBatch.from_pylist([_packed(piece, s, lane >> FAN_IN_BITS) for s, piece in _cut(entries, bits)], _RUN)
            lanes.clear()

        for batch in batches:
            for lane, mark, doc_id, at in zip(*(batch.column(c).to_pylist() for c in ("lane", "mark", "doc_id", "at")), strict=True):
                found = lanes.setdefault(lane, {})
                best = (0, 0, at) if doc_id is None else (1, doc_id, at)
                old = found.get(mark)
                held += old is None
                found[mark] = (best, 1) if old is None else (better(old[0], best, largest), old[1] + 1)
            if held >= RUN_ENTRIES:
                yield from out()
                held = 0
        yield from out()

    return run


def _exchanged(bits: int, largest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces sorted by slice and group: those of one slice and group become a run, cut for the next exchange."""
        key, pieces = None, []

        def out() -> pa.RecordBatch:
            run = merged(map(_unpacked, pieces), largest)
            return pa.RecordBatch.from_pylist([_packed(piece, s, key[1] >> FAN_IN_BITS) for s, piece in _cut(run, bits)], _RUN)

        for batch in batches:
            for r in batch.to_pylist():
                if key is not None and key != (r["slice"], r["group"]):
                    yield out()
                    pieces = []
                key = (r["slice"], r["group"])
                pieces.append(r)
        if pieces:
            yield out()

    return run


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of finished runs that stand for several rows, as rows."""
    for batch in batches:
        for r in batch.to_pylist():
            found = [e for e in _unpacked(r) if e.rows > 1]
            columns = {"mark": [e.mark for e in found], "keep_id": [e.best[1] if e.best[0] else None for e in found], "keep_at": [e.best[2] for e in found], "group_size": [e.rows for e in found]}
            yield pa.RecordBatch.from_pydict(columns, pa.schema([("mark", pa.binary()), ("keep_id", pa.int64()), ("keep_at", pa.int64()), ("group_size", pa.int64())]))


def tree_merge(marks: DataFrame, largest: bool = True) -> DataFrame:
    """(mark, keep_id, keep_at, group_size) of each mark with several rows in ``marks`` (lane, mark, doc_id, at), lanes being whole numbers from 0.

    A mark is 48 bytes that sort as their digest does; at tells rows apart. There are as many rounds as lanes have digits to the
    base of the fan-in.
    """
    top = marks.agg(F.max("lane")).first()[0] or 0
    rounds = max(1, -(-int(top).bit_length() // FAN_IN_BITS))
    runs = marks.select("lane", "mark", "doc_id", "at").mapInArrow(_first_runs(FAN_IN_BITS, largest), _RUN_DDL)
    for level in range(1, rounds + 1):
        # the pieces of the last round are finished runs: nothing is cut further
        bits = FAN_IN_BITS * min(level + 1, rounds)
        runs = runs.repartition("slice", "group").sortWithinPartitions("slice", "group").mapInArrow(_exchanged(bits, largest), _RUN_DDL)
    return runs.mapInArrow(_several, "mark binary, keep_id long, keep_at long, group_size long")


def exact_duplicates(docs: DataFrame, largest: bool = True) -> DataFrame:
    """Every row of ``docs`` as doc_id, keep_id, group_size, kept and text_sha256.

    Texts are equal when they are identical; null counts as empty. Of equal texts the row with the largest doc_id stays (the
    smallest with ``largest`` false); a null doc_id stays only where all are null, and keep_id is null then. Of rows that share doc_id and
    text one stays. An empty table gives no rows; columns other than doc_id and text are not read.
    """
    text = F.coalesce("text", F.lit(""))
    eight = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    mark = F.concat(F.unhex(F.sha2(text, 256)), eight(F.xxhash64(text)), eight(F.octet_length(text).cast("long")))
    # texts are read once; from here on only marks move
    marks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"), F.spark_partition_id().cast("long").alias("lane"), F.monotonically_increasing_id().alias("at"))
    marks = materialize(marks)
    several = materialize(tree_merge(marks, largest))
    # a text that many rows share is asked about once for each lane, so that answers go out in even shares
    asked = marks.groupBy("lane", "mark").agg(F.count(F.lit(1)).alias("here")).join(several, "mark").select("lane", "mark", "keep_id", "keep_at", "group_size")
    rows = marks.join(asked, ["lane", "mark"], "left")
    alone = F.col("group_size").isNull()
    return rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("at") == F.col("keep_at"))).alias("kept"),
        F.lower(F.hex(F.substring("mark", 1, 32))).alias("text_sha256"),
    )


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
