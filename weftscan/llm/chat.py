"""Quotation linking for conversations, in DataFrame functions only.

A message is cut into passages: runs of lines with the same quote level (the number of
leading ``>`` marks). Passages are normalised (lower case, white space collapsed) and
hashed, whole and by their parts: paragraphs, lines, sentences, and sentences cut at line ends. A
quoted passage links to the message that says the most of it in its own words. Each part votes for
the first message of the same conversation before the quoting one that says it, whole or as a part, and for
the first in other conversations; votes count characters. Of equal votes those inside the conversation win, then
the first message. So one line of a longer message links, and so does a quote trimmed at either end if one
part of it is left whole; a quote of less than a sentence and a line does not.

The last quoted passage of level 1 that links inside the conversation names the message
that is replied to. Conversations are then ordered by threads: messages that reply to none begin a
thread, and (thread, turn) is an order in which every message follows what it replies to.
Bodies keep only the lines of level 0.

Originals are aggregated to one row for each hash of a part before any join, so a passage that a
third of all messages share is one row on that side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftscan.llm.store import let, materialize

#: Marks with any blanks between them; a possessive class, so a line of any number of marks needs no stack.
_MARKS = r"^[ \t]*+>[> \t]*+"
_BLANKS = " \t\n\x0b\f\r"
_PARAGRAPH, _LINE, _SENTENCE = r"\n\s*\n", r"\n", r"(?<=[.!?])\s+|(?<=[\x{3002}\x{ff01}\x{ff1f}])\s*"
#: Ways to cut a passage; each cuts all of it.
_CUTS = (_PARAGRAPH, _LINE, f"{_SENTENCE}|{_PARAGRAPH}", f"{_SENTENCE}|{_LINE}")


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, _MARKS, 0)
    return F.length(marks) - F.length(F.translate(marks, ">", ""))


def _lines(text: Column) -> Column:
    return F.transform(
        F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n"),
        lambda line: F.struct(_level(line).alias("level"), F.regexp_replace(line, _MARKS, "").alias("line")),
    )


def _passages(lines: Column) -> Column:
    """Runs of one level as (level, text), in order; blank lines end no run and blank runs are left out."""
    def cut(x: Column) -> Column:
        begins = F.filter(F.transform(x, lambda own, i: F.when(~own["level"].eqNullSafe(F.get(x, i - 1)["level"]), i)), lambda i: i.isNotNull())
        return let(begins, lambda at: F.transform(at, lambda i, k: run(x, i, F.coalesce(F.get(at, k + 1), F.size(x)))))

    def run(x: Column, begin: Column, end: Column) -> Column:
        text = F.array_join(F.transform(F.slice(x, begin + 1, end - begin), lambda own: own["line"]), "\n")
        return F.struct(F.get(x, begin)["level"].alias("level"), text.alias("text"))

    return F.filter(let(lines, cut), lambda p: F.length(_normal(p["text"])) > 0)


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\x{00a0}]+", " "))


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _pieces(text: Column, cut: str) -> Column:
    """Normalised pieces of a passage, without blank ones."""
    return F.filter(F.transform(F.split(text, cut), _normal), lambda t: F.length(t) > 0)


def _said(text: Column) -> Column:
    """The distinct hashes of a passage and its parts."""
    texts = F.array_distinct(F.concat(F.array(_normal(text)), *[_pieces(text, cut) for cut in _CUTS]))
    return F.transform(texts, _hash)


def _asked(text: Column) -> Column:
    """(cut, hash, n) of a quoted passage (cut 0) and its parts, n being the characters other than white space."""

    def counted(cut: int):
        return lambda t: F.struct(F.lit(cut).alias("cut"), _hash(t).alias("hash"), F.length(F.replace(t, F.lit(" "))).cast("long").alias("n"))

    return F.concat(F.transform(F.array(_normal(text)), counted(0)), *[F.transform(_pieces(text, cut), counted(k)) for k, cut in enumerate(_CUTS, 1)])


def quoted_messages(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, body (level 0 only), passages (array of level, text) of each message."""
    plain = F.col("text").cast("string")
    quoting = F.coalesce(plain, F.lit("")).rlike(r"(?m)^[ \t]*>")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), plain.alias("_text"), quoting.alias("_quoting"))
    whole = F.array(F.struct(F.lit(0).alias("level"), F.regexp_replace(F.coalesce(F.col("_text"), F.lit("")), "\r\n?", "\n").alias("text")))
    # a message without a quote mark is one passage and needs no fold over its lines
    found = F.when(F.col("_quoting"), _passages(_lines(F.col("_text")))).otherwise(F.filter(whole, lambda p: F.length(_normal(p["text"])) > 0))
    body = F.when(
        F.col("_quoting"),
        F.btrim(F.array_join(F.transform(F.filter(_lines(F.col("_text")), lambda x: x["level"] == 0), lambda x: x["line"]), "\n"), F.lit(_BLANKS)),
    ).otherwise(F.coalesce(F.col("_text"), F.lit("")))
    return rows.select("conv_id", "turn", "role", body.alias("body"), found.alias("passages"))


def link_quotations(conversations: DataFrame) -> DataFrame:
    """Links (conv_id, turn, position, level, source_conv, source_turn) of quoted passages.

    ``conversations`` are rows of ``quoted_messages``. source columns are null where no message
    says the passage in its own words.
    """
    passages = conversations.select("conv_id", "turn", F.posexplode("passages").alias("position", "p")).select("conv_id", "turn", "position", "p.level", "p.text")
    quotes = passages.where("level > 0")
    asked = materialize(quotes.select("conv_id", "turn", "position", "level", F.explode(_asked(F.col("text"))).alias("q")).select("conv_id", "turn", "position", "level", "q.*"))
    wanted = asked.select("hash").distinct()
    said = passages.where("level = 0").select("conv_id", "turn", F.explode(_said(F.col("text"))).alias("hash"))
    own = said.join(wanted, "hash", "left_semi")
    # the first time in each conversation decides whether it was said before the quote
    in_conversation = own.where("conv_id is not null and turn is not null").groupBy("conv_id", "hash").agg(F.min("turn").alias("here"))
    # the first two conversations, as one may be the quoting one; Spark cuts a hash to two rows before it shuffles them
    ranked = in_conversation.withColumn("_k", F.row_number().over(Window.partitionBy("hash").orderBy("conv_id"))).where("_k <= 2")
    said_at = F.struct("conv_id", F.col("here").alias("turn"))
    first_said = ranked.groupBy("hash").agg(F.min(F.when(F.col("_k") == 1, said_at)).alias("first"), F.min(F.when(F.col("_k") == 2, said_at)).alias("second"))
    linked = asked.join(in_conversation, ["conv_id", "hash"], "left").join(first_said, "hash", "left")
    other = F.when(F.col("first.conv_id").eqNullSafe(F.col("conv_id")), F.col("second")).otherwise(F.col("first"))
    inner = F.when(F.col("here") < F.col("turn"), F.struct(F.lit(0).alias("far"), F.col("conv_id").alias("source_conv"), F.col("here").alias("source_turn")))
    outer = F.when(other.isNotNull(), F.struct(F.lit(1).alias("far"), other["conv_id"].alias("source_conv"), other["turn"].alias("source_turn")))
    quote = ["conv_id", "turn", "position", "level"]
    sources = F.filter(F.array(inner, outer), lambda x: x.isNotNull())
    votes = linked.select(*quote, "cut", "n", F.explode_outer(sources).alias("source"))
    # pieces of one cut do not overlap, so what they cover can be summed
    covered = votes.groupBy(*quote, "cut", "source").agg(F.sum("n").alias("n"))
    best = F.min(F.when(F.col("source").isNotNull(), F.struct((-F.col("n")).alias("_n"), "source")))["source"]
    return covered.groupBy(*quote).agg(best.alias("best")).select(*quote, "best.source_conv", "best.source_turn")


def reply_threads(edges: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth) for reply edges (conv_id, turn, parent).

    Pointer doubling: each round replaces what a message points at by what that points
    at, so chains of n replies take log2(n) rounds. Parents are earlier turns, so it ends.
    """
    at = edges.select("conv_id", "turn", F.col("parent").alias("thread"), F.lit(1).cast("long").alias("depth"))
    while True:
        at = materialize(at)
        nxt = at.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("_up"), F.col("depth").alias("_more"))
        joined = at.join(nxt, ["conv_id", "thread"], "left")
        if joined.where(F.col("_up").isNotNull()).isEmpty():
            return at
        at = joined.select("conv_id", "turn", F.coalesce("_up", "thread").alias("thread"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"))


def format_chat(conversations: DataFrame) -> DataFrame:
    """Reply-ordered messages without quotes.

    One row for each message: conv_id, turn, role, n_quotes, n_linked, source_conv and source_turn (of the
    passage that decides the reply, else of the last linked one), parent_turn, thread,
    depth, body, formatted. Sorting a conversation by (thread, turn) puts it in reply order; formatted is the
    message as ``<|role|>``, newline, body.

    Defined cases: null and blank texts have no passages and an empty body; a null role is formatted
    as "unknown"; null conv_id or turn link with nothing and are their own thread; repeated (conv_id,
    turn) rows with equal text are one message, with different texts they share links of both;
    what quotes itself or a later turn has no source inside its conversation; an empty table gives no
    rows; other columns are not read.
    """
    messages = materialize(quoted_messages(conversations).distinct())
    links = link_quotations(messages)
    found = F.col("source_turn").isNotNull()
    inside = F.when(found & F.col("source_conv").eqNullSafe(F.col("conv_id")) & (F.col("level") == 1), F.struct("position", "source_conv", "source_turn"))
    summary = materialize(
        links.groupBy("conv_id", "turn")
        .agg(
            F.count(F.lit(1)).alias("n_quotes"),
            F.count_if(found).alias("n_linked"),
            F.max(inside).alias("_reply"),
            F.max(F.when(found, F.struct("position", "source_conv", "source_turn"))).alias("_last"),
        )
        .select(
            "conv_id",
            "turn",
            "n_quotes",
            "n_linked",
            F.coalesce("_reply", "_last")["source_conv"].alias("source_conv"),
            F.coalesce("_reply", "_last")["source_turn"].alias("source_turn"),
            F.col("_reply.source_turn").alias("parent_turn"),
        )
    )
    edges = summary.where("parent_turn is not null").select("conv_id", "turn", F.col("parent_turn").alias("parent"))
    threads = reply_threads(edges)
    joined = messages.join(summary, ["conv_id", "turn"], "left").join(threads, ["conv_id", "turn"], "left")
    header = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"))
    return joined.select(
        "conv_id",
        "turn",
        "role",
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "source_conv",
        "source_turn",
        "parent_turn",
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "body",
        F.concat(header, F.col("body")).alias("formatted"),
    )
