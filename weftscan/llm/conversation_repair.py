"""Repair of conversation structure by error-correcting Earley parsing.

A grammar of roles says what a conversation may be: nothing, or rounds of user and assistant after at most one system
message. Productions for errors carry costs: a message may be deleted or given another role, and a message with an empty text
may be inserted. The parser reads a conversation's messages in order; its chart holds, for each item, the cheapest edits that
lead there as (cost, audit), the audit being the initials of the edits, and of equal costs the least audit. The completed item
of the grammar's start gives the repair.

The grammar is left-linear (non-terminals stand first in a body), so every item of a chart begins at the conversation's start and
a chart is a few items at any length. That lets conversations of any length be parsed in parts: a block of messages is
parsed once from each item that may stand at its beginning, and what each leads to is a small table. Tables of a
conversation are then joined from left to right. Two audits of equal cost over the same messages are never prefixes of each other
(the longer would have further insertions, which cost), so the least audit of a whole is made of least parts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftscan.llm.store import materialize

GRAMMAR: dict[str, list[tuple[str, ...]]] = {
    "dialogue": [(), ("rounds",)],
    "rounds": [("opening", "user", "assistant"), ("rounds", "user", "assistant")],
    "opening": [(), ("system",)],
}
START = "dialogue"
#: Roles that a message may be given, or that an inserted message may have.
EDITABLE = ("user", "assistant")
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 4, 3, 3, 3

#: Messages and characters of a block, as far as one message allows.
BLOCK_ROWS, BLOCK_CHARS = 1024, 262_144

# What a blank text consists of, and how a finished sentence ends.
BLANKS = " \t\n\x0b\f\r"
ENDS = [".", "!", "?"]


class Item(NamedTuple):
    """A production with a dot before what is expected next; it begins where the conversation does."""

    head: str
    body: tuple[str, ...]
    dot: int

    @property
    def expects(self) -> str | None:
        return self.body[self.dot] if self.dot < len(self.body) else None

    def moved(self) -> Item:
        return self._replace(dot=self.dot + 1)


def closure(items: Iterable[Item], waiting: Iterable[Item] = ()) -> set[Item]:
    """``items`` and all that prediction and completion add; ``waiting`` are the items at the conversation's start."""
    found, todo = set(), list(items)
    while todo:
        item = todo.pop()
        if item in found:
            continue
        found.add(item)
        if item.expects in GRAMMAR:
            todo += [Item(item.expects, body, 0) for body in GRAMMAR[item.expects]]
        if item.expects is None:
            todo += [w.moved() for w in waiting if w.expects == item.head]
        # an item that was found before what completes it
        done = {i.head for i in found if i.expects is None}
        todo += [i.moved() for i in found if i.expects in done and i.dot == 0 and not waiting]
    return found


@functools.cache
def origin() -> frozenset[Item]:
    """The chart before the first message, in full."""
    assert all(s not in GRAMMAR for bodies in GRAMMAR.values() for b in bodies for s in b[1:]), "the grammar is not left-linear"
    return frozenset(closure(Item(START, body, 0) for body in GRAMMAR[START]))


def is_kept(item: Item) -> bool:
    """Whether a chart needs the item: it expects a role, or it is the start symbol's completion."""
    return item.expects not in GRAMMAR if item.expects is not None else item.head == START


@functools.cache
def scanned(item: Item) -> tuple[Item, ...]:
    """The items of the next chart once ``item`` has the role that it expects."""
    return tuple(sorted(i for i in closure([item.moved()], origin()) if is_kept(i)))


#: All items that a chart may hold, so that they can be named by their numbers.
@functools.cache
def items() -> tuple[Item, ...]:
    found = [i for i in sorted(origin()) if is_kept(i)]
    for item in found:
        if item.expects is not None:
            found += [i for i in scanned(item) if i not in found]
    return tuple(found)


Best = tuple[int, str]


def improve(chart: dict[Item, Best], item: Item, cost: int, audit: str) -> bool:
    if item in chart and chart[item] <= (cost, audit):
        return False
    chart[item] = (cost, audit)
    return True


def inserted(chart: dict[Item, Best]) -> dict[Item, Best]:
    """The chart with all that insertions add to it."""
    todo = list(chart)
    while todo:
        item = todo.pop()
        if item.expects in EDITABLE:
            cost, audit = chart[item]
            todo += [i for i in scanned(item) if improve(chart, i, cost + INSERT_COST, audit + "I")]
    return chart


@functools.cache
def steps(item: Item, initial: str, forced: bool, truncated: bool) -> tuple[tuple[Item, int, str], ...]:
    """What one message leads to from ``item``, with the least edits: deletion, keeping or reroling, then insertions."""
    chart: dict[Item, Best] = {item: (DELETE_COST, "D")}
    if not forced and item.expects is not None:
        extra = TRUNCATED_COST if truncated else 0
        for new in scanned(item):
            if item.expects[0] == initial:
                improve(chart, new, extra, "K")
            if item.expects in EDITABLE:
                improve(chart, new, extra + REROLE_COST, "R")
    return tuple((i, *best) for i, best in inserted(chart).items())


def first_chart() -> dict[Item, Best]:
    return inserted({i: (0, "") for i in origin() if is_kept(i)})


def parse(chart: dict[Item, Best], messages: Iterable[tuple[str, bool, bool]]) -> dict[Item, Best]:
    """The chart after ``messages`` (initial of the role, whether it has to go, whether it is truncated)."""
    known = {"s", "u", "a"}
    for initial, forced, truncated in messages:
        new: dict[Item, Best] = {}
        letter = initial if initial in known else ""
        for item, (cost, audit) in chart.items():
            for target, more, edits in steps(item, letter, forced, truncated):
                best = (cost + more, audit + edits)
                if target not in new or best < new[target]:
                    new[target] = best
        chart = new
    return chart


def completed(chart: dict[Item, Best]) -> Best:
    return min(best for item, best in chart.items() if item.head == START and item.expects is None)


def replay(entry: Iterable[Item], audit: str, messages: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """The repaired (role, text, edit) that ``audit`` makes of ``messages`` (role, text) from the items ``entry``."""
    at, source = set(entry), iter(messages)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(source)
        if edit == "D":
            continue
        if edit == "K":
            at = {n for i in at if i.expects is not None and i.expects[0] == role[:1] for n in scanned(i)}
        else:
            role = next(i.expects for i in at if i.expects in EDITABLE)
            at = {n for i in at if i.expects == role for n in scanned(i)}
        yield role, text, edit


# Spark


_FACTS = "n long, least_turn long, most_turn long, turns long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string"
_BLOCK = f"conv_id {{conv}}, part long, alone boolean, {_FACTS}, cost long, audit string, moves array<struct<entry: int, exit: int, cost: long, audit: string>>, rows array<struct<role: string, text: string>>"


def _distinct_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, repeats): messages that are equal in all four count as copies; repeats says that role and text come earlier too.

    Earlier turns are found by aggregation, so a message that a conversation repeats without end is no burden.
    """
    first = messages.groupBy("conv_id", "role", "text").agg(F.bool_or(F.col("turn").isNull()).alias("_null"), F.min("turn").alias("_least"))
    first = first.select("conv_id", F.when(~F.col("_null"), F.col("_least")).alias("turn"), "role", "text", F.lit(0).cast("long").alias("copies"), F.lit(True).alias("first"))
    both = messages.withColumn("first", F.lit(False)).unionByName(first)
    return both.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"), (~F.bool_or("first")).alias("repeats"))


class _Block:
    """Messages of one conversation in order, until it is closed."""

    def __init__(self, conv_id, first_of_run: bool):
        self.conv_id, self.first_of_run = conv_id, first_of_run
        self.rows: list[tuple[str, str]] = []
        self.symbols: list[tuple[str, bool, bool]] = []
        self.turns: list[int] = []
        self.chars = 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

    def add(self, turn, role: str, text: str, fault: str) -> None:
        initial = role[:1]
        if self.symbols and (self.symbols[-1][0] + initial) not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.rows.append((role, text))
        self.symbols.append((initial, fault in ("blank", "duplicate"), fault == "truncated"))
        self.chars += len(text)
        if fault:
            self.counts[fault] += 1
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def closed(self, part: int, alone: bool) -> dict:
        out = {
            "conv_id": self.conv_id, "part": part, "alone": alone, "n": len(self.rows), "least_turn": self.turns[0] if self.turns else None,
            "most_turn": self.turns[-1] if self.turns else None, "turns": len(self.turns), **self.counts, "first_initial": self.symbols[0][0], "last_initial": self.symbols[-1][0],
            "rows": [{"role": r, "text": t} for r, t in self.rows], "cost": None, "audit": None, "moves": [],
        }
        if alone:
            out["cost"], out["audit"] = completed(parse(first_chart(), self.symbols))
            return out
        number = {item: k for k, item in enumerate(items())}
        # the first block of a run may be a conversation's beginning or go on with what ends an earlier partition
        charts = [(k, {item: (0, "")}) for item, k in number.items()] + ([(-1, first_chart())] if self.first_of_run else [])
        out["moves"] = [{"entry": k, "exit": number[item], "cost": cost, "audit": audit} for k, chart in charts for item, (cost, audit) in parse(chart, self.symbols).items()]
        return out


def _parse_blocks(schema: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by conversation: runs of a conversation are cut into blocks, and blocks parsed.

        A block that is a run of its own with runs before and after it is a whole conversation.
        """
        task, number, runs, block = TaskContext.get().partitionId(), 0, 0, None
        ready: list[dict] = []
        size = 0

        def close(alone: bool) -> None:
            nonlocal number, size
            ready.append(block.closed(task << 32 | number, alone))
            number += 1
            size += block.chars

        for batch in batches:
            for r in batch.to_pylist():
                for copy in range(r["copies"]):
                    if block is None or r["conv_id"] != block.conv_id:
                        if block is not None:
                            close(block.first_of_run and runs > 1)
                        runs += 1
                        block = _Block(r["conv_id"], True)
                    elif len(block.rows) >= BLOCK_ROWS or block.chars >= BLOCK_CHARS:
                        close(False)
                        block = _Block(r["conv_id"], False)
                    fault = "blank" if r["blank"] else "duplicate" if copy or r["repeats"] else "truncated" if r["cut"] else ""
                    block.add(r["turn"], r["role"], r["text"], fault)
                if len(ready) >= 500 or size >= 8 * BLOCK_CHARS:
                    yield pa.RecordBatch.from_pylist(ready, schema)
                    ready, size = [], 0
        if block is not None:
            close(False)
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema)

    return run


class _Path(NamedTuple):
    """The last block of a way through a conversation's blocks."""

    before: _Path | None
    part: int
    entry: int
    audit: str


def _is_less(a: _Path, b: _Path) -> bool:
    """Whether the audit of one way is less than that of another over the same blocks: only what differs is compared."""
    ours, theirs = [], []
    while a is not b:
        ours.append(a.audit)
        theirs.append(b.audit)
        a, b = a.before, b.before
    return "".join(reversed(ours)) < "".join(reversed(theirs))


class _Chain:
    """The tables of one conversation's blocks, joined from left to right."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.ways: dict[int, tuple[int, _Path]] | None = None
        self.sums = dict.fromkeys(("n", "turns", "blank", "duplicate", "truncated", "illegal"), 0)
        self.least = self.most = self.last = None

    def add(self, b: dict) -> None:
        for k in self.sums:
            self.sums[k] += b[k]
        if self.last is not None and self.last + b["first_initial"] not in ("su", "ua", "au"):
            self.sums["illegal"] += 1
        if self.most is not None and self.most == b["least_turn"]:
            self.sums["turns"] -= 1
        self.last = b["last_initial"]
        if b["least_turn"] is not None:
            self.least, self.most = b["least_turn"] if self.least is None else self.least, b["most_turn"]
        new: dict[int, tuple[int, _Path]] = {}
        for m in b["moves"]:
            if self.ways is None:
                if m["entry"] != -1:
                    continue
                cost, before = 0, None
            elif m["entry"] in self.ways:
                cost, before = self.ways[m["entry"]]
            else:
                continue
            cost, path, held = cost + m["cost"], _Path(before, b["part"], m["entry"], m["audit"]), new.get(m["exit"])
            if held is None or cost < held[0] or (cost == held[0] and _is_less(path, held[1])):
                new[m["exit"]] = (cost, path)
        self.ways = new

    def ended(self) -> list[dict]:
        """A row for each block with how it is entered and edited; the last one also has what holds for the whole conversation."""
        done = [way for k, way in self.ways.items() if items()[k].head == START and items()[k].expects is None]
        cost, path = functools.reduce(lambda x, y: y if y[0] < x[0] or (y[0] == x[0] and _is_less(y[1], x[1])) else x, done)
        parts = []
        while path is not None:
            parts.append({"conv_id": self.conv_id, "part": path.part, "entry": path.entry, "edits": path.audit})
            path = path.before
        parts[0] |= {**self.sums, "least_turn": self.least, "most_turn": self.most, "cost": cost, "audit": "".join(p["edits"] for p in reversed(parts))}
        return parts


def _join_blocks(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, empty = None, dict.fromkeys(schema.names)
        for batch in batches:
            for r in batch.to_pylist():
                if chain is not None and chain.conv_id != r["conv_id"]:
                    yield pa.RecordBatch.from_pylist([empty | p for p in chain.ended()], schema)
                    chain = None
                chain = chain or _Chain(r["conv_id"])
                chain.add(r)
        if chain is not None:
            yield pa.RecordBatch.from_pylist([empty | p for p in chain.ended()], schema)

    return run


def _replay_blocks(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = [i for i in origin() if is_kept(i)]
        for batch in batches:
            for r in batch.to_pylist():
                entry = start if r["entry"] == -1 else [items()[r["entry"]]]
                made = [{"role": a, "text": b, "edit": c} for a, b, c in replay(entry, r["edits"], ((x["role"], x["text"]) for x in r["rows"]))]
                yield pa.RecordBatch.from_pylist([{"conv_id": r["conv_id"], "part": r["part"], "messages": made}], schema)

    return run


class Repair(NamedTuple):
    """What a repair gives.

    ``conversations`` has a row for each conversation with a message: conv_id, n_messages, gaps, blank, duplicate, truncated,
    illegal, cost, audit. ``messages`` has the repaired messages in parts: conv_id, part and messages, an array of (role,
    text, edit); the parts of a conversation in order of part are its repaired messages.
    """

    conversations: DataFrame
    messages: DataFrame


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def repair_conversations(messages: DataFrame) -> Repair:
    """Cheapest repairs of all conversations in ``messages`` (conv_id, turn, role, text, and copies if rows stand for several).

    Messages are in order of turn (null first), of equal turns in order of role and text. A null role or text is one space;
    a null conv_id is a conversation of its own. Faults of a message, of which the first counts: blank (no visible character), duplicate (role and
    text come earlier), truncated (the last visible character ends no sentence). Blank and duplicate messages are deleted. A
    role is known by its initial, s, u or a; any other role, the empty one too, is never kept as it is. gaps are whole numbers
    missing between the least and the greatest turn. Rows that are equal in all columns are duplicates of each other. An empty
    table gives empty results; other columns are not read.
    """
    spark = messages.sparkSession
    copies = F.col("copies").cast("long") if "copies" in messages.columns else F.lit(1).cast("long")
    blank = F.lit(" ")
    given = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), copies.alias("copies"))
    bare = F.rtrim("text", F.lit(BLANKS))
    cells = _distinct_messages(given).withColumns({"blank": bare == "", "cut": ~F.substring(bare, -1, 1).isin(ENDS)})
    cells = materialize(cells)
    # equal rows have become one, so ranges are even however often a message or a conversation is repeated
    sorted_rows = cells.repartitionByRange("conv_id", "turn", F.substring("role", 1, 16), F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    ddl = _BLOCK.format(conv=messages.schema["conv_id"].dataType.simpleString())
    blocks = materialize(sorted_rows.mapInArrow(_parse_blocks(_arrow(spark.createDataFrame([], ddl))), ddl))
    whole = F.lit(-1).alias("entry")
    facts = ["least_turn", "most_turn", "n", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    parted = blocks.where("not alone")
    joined = f"conv_id {messages.schema['conv_id'].dataType.simpleString()}, part long, entry int, edits string, least_turn long, most_turn long, n long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    ways = materialize(
        parted.drop("alone", "rows", "cost", "audit").repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_join_blocks(_arrow(spark.createDataFrame([], joined))), joined)
    )
    rows = blocks.where("alone").select("conv_id", *facts).unionByName(ways.where("audit is not null").select("conv_id", *facts))
    gaps = F.coalesce(F.col("most_turn") - F.col("least_turn") + 1 - F.col("turns"), F.lit(0).cast("long"))
    summary = rows.select("conv_id", F.col("n").alias("n_messages"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    edited = blocks.where("alone").select("conv_id", "part", "rows", whole, F.col("audit").alias("edits"))
    edited = edited.unionByName(parted.select("conv_id", "part", "rows").join(ways.select("part", "entry", "edits"), "part").select("conv_id", "part", "rows", "entry", "edits"))
    made = f"conv_id {messages.schema['conv_id'].dataType.simpleString()}, part long, messages array<struct<role: string, text: string, edit: string>>"
    return Repair(summary, edited.mapInArrow(_replay_blocks(_arrow(spark.createDataFrame([], made))), made))


def _hash_parts(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        held, digest, n = None, None, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if digest is None or r["conv_id"] != held:
                    if digest is not None:
                        out.append({"conv_id": held, "sha256": digest.hexdigest()})
                    held, digest, n = r["conv_id"], hashlib.sha256(), 0
                if r["count"]:
                    digest.update((b"\n" if n else b"") + r["piece"].encode())
                    n += r["count"]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": held, "sha256": digest.hexdigest()}], schema)

    return run


def transcript_digests(messages: DataFrame) -> DataFrame:
    """(conv_id, sha256) of each conversation's ``role:text`` lines, joined by newlines, from the ``messages`` of a repair.

    A digest reads its conversation from beginning to end; its parts stream through one task and are never held together.
    """
    spark = messages.sparkSession
    piece = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    schema = f"conv_id {messages.schema['conv_id'].dataType.simpleString()}, sha256 string"
    pieces = messages.select("conv_id", "part", F.size("messages").alias("count"), piece.alias("piece"))
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_hash_parts(_arrow(spark.createDataFrame([], schema))), schema)


def damaged(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, text) with faults planted by the checksum of ``conv_id:turn``: of twenty, one each is dropped, emptied, stripped of sentence ends, repeated or spoken by the user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text: Column = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    rows = messages.select("conv_id", "turn", "role", "text", kind.alias("kind")).where("kind <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies")
    )


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """For every conv_id of ``conversations``: what was wrong after ``damaged``, the cheapest repair and the digest of its result.

    A conversation that lost all its messages has zeros, an empty audit and the digest of the empty text.
    """
    repair = repair_conversations(damaged(conversations))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = {c: F.lit(None).cast("long") for c in counts} | {"audit": F.lit(None).cast("string"), "sha256": F.lit(None).cast("string")}
    padded = lambda df: df.select("conv_id", *[F.col(c) if c in df.columns else null.alias(c) for c, null in nothing.items()])
    parts = padded(conversations.select("conv_id")), padded(repair.conversations), padded(transcript_digests(repair.messages))
    together = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("conv_id").agg(*[F.max(c).alias(c) for c in nothing])
    return together.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
