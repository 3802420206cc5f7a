"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a predicate over a document that says "reject". Its cost and selectivity are
estimated on a sample, the cost as the steps that it takes there and not by a clock, so a table gives one order
in every run. Rules are tried in the order of rejections per cost, so that
a document is usually rejected by something cheap. The order is that of the branches of one
CASE expression, which evaluates no branch after the first that holds, nor the counts that only such branches
need. A document's verdict does not depend on the order, so the sample never changes a result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftscan.llm.store import drop_clashes, let, materialize

WORD = "[^\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 8


def words_of(text: Column) -> Column:
    """The words of a text (null: none)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_chars(text: Column) -> Column:
    """Code points in words: all but the white space between them."""
    return F.length(F.translate(F.coalesce(text, F.lit("")), SPACES, "")).cast("long")


def symbol_count(text: Column) -> Column:
    """Characters of ``[#*$%&|<>]``."""
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(words: Column, window: int = WINDOW_WORDS) -> Column:
    """Words inside windows of ``window`` words that occur at least twice in the text.

    Each word is hashed once, and the hash of a window is that of its words' hashes. Only texts where some hash repeats sort their
    windows; equal neighbours in that order are the repeats. The words that they cover are counted
    in order of position: each window adds what reaches beyond the window before it.
    """
    n = F.size(words)

    def covered(w: Column) -> Column:
        hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda one: F.transform(F.sequence(F.lit(0), F.size(one) - window), lambda i: F.xxhash64(*[F.get(one, i + k) for k in range(window)])))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), from_hashes(h)).otherwise(F.lit(0)))

    def from_hashes(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(
            placed,
            lambda s: F.filter(
                F.transform(
                    s,
                    lambda x, k: F.when(
                        (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]),
                        x["i"],
                    ),
                ),
                lambda x: x.isNotNull(),
            ),
        )
        return F.aggregate(
            F.array_sort(twice),
            F.struct(F.lit(0).alias("total"), F.lit(0).alias("reach")),
            lambda acc, i: F.struct((acc["total"] + i + window - F.greatest(i, acc["reach"])).alias("total"), (i + window).alias("reach")),
            lambda acc: acc["total"],
        )

    return F.when(n <= window, F.lit(0).cast("long")).otherwise(let(words, covered).cast("long"))


def text_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long)."""
    text = F.col("text").cast("string")
    plain = drop_clashes(docs, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
    # apart from each other, so that a rule over the number of words looks for no repeats
    counts = {"n_words": F.size(words_of(text)).cast("long"), "n_repeat_words": let(words_of(text), lambda w: repeated_words(w)), "word_chars": word_chars(text), "n_symbols": symbol_count(text), "n_dup_lines": duplicate_lines(text)}
    return plain.withColumns(counts)


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for documents to drop; null counts as false. ``steps`` is about how many characters or words it looks at in a document."""

    name: str
    rejects: Column
    steps: Column | None = None


def base_rule() -> Rule:
    return Rule("base", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")), F.length("text") + 2 * WINDOW_WORDS * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Rules over the columns of ``text_counts`` and the text, with bounds that prose keeps well within.

    symbols: more than one symbol for every ten words; duplicate_lines: three and over 30 % of lines repeat;
    stutter: over half of the words equal the word before; word_length: mean outside 2 to 15 characters; shouting: over half of the cased letters
    of a text with at least 40 of them are capitals.
    """
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    capitals = F.length(F.regexp_replace(t, "[^\\p{Lu}]+", ""))
    small = F.length(F.regexp_replace(t, "[^\\p{Ll}]+", ""))
    lines = F.length(t) - F.length(F.translate(t, "\n", "")) + 1
    chars, words = F.length(t), F.col("n_words")
    return [
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words"), 2 * chars),
        Rule("duplicate_lines", (F.col("n_dup_lines") >= 3) & (10 * F.col("n_dup_lines") > 3 * lines), 3 * chars),
        Rule("stutter", let(words_of(t), lambda w: 2 * F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))) > F.size(w)), chars + 2 * words),
        Rule("word_length", (F.col("word_chars") > 15 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words")), 2 * chars),
        Rule("shouting", (capitals + small >= 40) & (capitals > small), 4 * chars),
    ]


#: Texts of more bytes are not drawn into the sample, which passes through the driver.
SAMPLE_TEXT_BYTES = 65_536


def sample_of(docs: DataFrame, sample_rows: int) -> DataFrame:
    """The texts of at most ``sample_rows`` rows of a sample by hash of the text, as a small table in the shared folder.

    Rows are taken from as few partitions as give enough of them, so a large table is not read for it. No other column passes through the driver.
    """
    text = F.col("text").cast("string").alias("text")
    drawn = docs.select(text).where((F.octet_length("text") <= SAMPLE_TEXT_BYTES) & (F.pmod(F.xxhash64(F.lit(11), "text"), F.lit(4)) == 0))
    return materialize(docs.sparkSession.createDataFrame(drawn.take(sample_rows), "text string").coalesce(1))


def cascade_order(docs: DataFrame, rules: list[Rule], sample_rows: int = 2000) -> list[Rule]:
    """``rules`` by rejections per step, both counted in one pass over the texts of at most ``sample_rows`` rows of ``docs``.

    A rule reads the text and the columns of ``text_counts``; without ``steps`` it is taken to look at each character once.
    Equal ratios keep the given order.
    """
    counted = text_counts(sample_of(docs, sample_rows))
    steps = [F.length("text") if r.steps is None else r.steps for r in rules]
    found = counted.agg(*[F.count_if(r.rejects) for r in rules], *[F.sum(x.cast("double")) for x in steps]).first()
    per_step = [found[k] / max(found[len(rules) + k] or 0.0, 1.0) for k in range(len(rules))]
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: -per_step[k])]


def verdict_of(ordered: list[Rule]) -> Column:
    """True where some rule holds, decided by the first that does."""
    verdict = F.lit(False)
    if ordered:
        verdict = F.when(F.coalesce(ordered[0].rejects, F.lit(False)), F.lit(True))
        for r in ordered[1:]:
            verdict = verdict.when(F.coalesce(r.rejects, F.lit(False)), F.lit(True))
        verdict = verdict.otherwise(F.lit(False))
    return verdict


def quality_cascade(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """``docs`` with the counts of ``text_counts``, base_failed and kept.

    kept is false where any rule rejects, the base rule among them. The order of the rules is that of
    ``cascade_order``; where only kept is read, what no rule before a rejection needs is not counted.

    Defined cases: a null text is a text without words; texts without words have counts of 0
    and fail the base rule; texts of any length are counted whole; equal rows get equal
    verdicts; an empty table gives no rows; columns of ``docs`` with the names of
    results are replaced, all others are kept.
    """
    counted = text_counts(drop_clashes(docs, ["base_failed", "kept"]))
    rules = [base_rule(), *(default_rules() if rules is None else rules)]
    ordered = cascade_order(counted, rules, sample_rows) if len(rules) > 1 else rules
    return counted.withColumns({"base_failed": base_rule().rejects, "kept": ~verdict_of(ordered)})


#: The same counts and verdicts for DuckDB.
QUALITY_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS s
  FROM base, unnest(range(1, greatest(len(w) - 6, 1))) AS t(i)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT doc_id, sum(least(8, i - before)) AS n FROM (
    SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) AS before FROM dup) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counted AS (
  SELECT b.doc_id, b.text, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(b.text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(b.text) - length(regexp_replace(b.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(b.text, '[^\p{Lu}]+', '', 'g')) AS capitals,
         length(regexp_replace(b.text, '[^\p{Ll}]+', '', 'g')) AS small,
         length(b.text) - length(replace(b.text, chr(10), '')) + 1 AS n_lines,
         len(list_filter(list_zip(w, w[2:]), lambda p: p[1] = p[2])) AS n_stutter
  FROM base b LEFT JOIN lines l ON b.doc_id = l.doc_id LEFT JOIN cov c ON b.doc_id = c.doc_id
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)
            OR 2 * n_stutter > n_words OR word_chars > 15 * n_words OR word_chars < 2 * n_words
            OR (capitals + small >= 40 AND capitals > small)) AS kept
FROM judged
"""
