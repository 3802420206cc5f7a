"""Documents drawn by importance: those most like a target text, by hashed n-gram features, with a random term.

Features are runs of consecutive words. A worker keeps them in a trie whose edges are words: a node is a feature, its path the feature's
words, and it holds the checksum of its text so far, so that a longer feature goes on from the shorter one it begins with
and no feature is written out or hashed from its start twice. While counting, nodes hold counts, and a full trie is
turned into bucket totals and begun anew; while scoring, nodes hold the gain of their bucket, and a document is one walk.
Words never leave their partition: what is merged is totals by bucket, and what is sent back is one gain for each bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftscan.llm.store import materialize

#: Nodes of a worker's trie before it is begun anew, about 250 bytes each.
TRIE_NODES = 400_000

# Bytes that make words after lower-casing; every byte of a character beyond ASCII is one of them.
_LOWER = bytes(range(256)).lower()
_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TO_WORDS = bytes(_LOWER[b] if _LOWER[b] in _WORD_BYTES else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text in lower case (A to Z only): runs of digits, letters and characters beyond ASCII."""
    return text.translate(_TO_WORDS).split() if text else []


class Node:
    """A feature: its checksum, the bucket or gain of it, how often it occurred, and the features that go on from it."""

    __slots__ = ("crc", "value", "count", "next")

    def __init__(self, crc: int, value: int):
        self.crc, self.value, self.count = crc, value, 0
        self.next: dict[bytes, Node] | None = None


class Trie:
    """Features of up to ``longest`` words; a node's value is its bucket, or with ``gains`` what its bucket gains."""

    def __init__(self, longest: int, buckets: int, gains: np.ndarray | None = None, nodes: int = TRIE_NODES):
        self.longest, self.buckets, self.most = longest, buckets, nodes
        self.gains = gains.tolist() if gains is not None else None
        self.counted = np.zeros(buckets, np.int64)
        self.root: dict[bytes, Node] = {}
        self.nodes = 0

    def _node(self, place: dict[bytes, Node], word: bytes, before: Node | None) -> Node:
        crc = zlib.crc32(word) if before is None else zlib.crc32(word, zlib.crc32(b" ", before.crc))
        bucket = crc % self.buckets
        node = place[word] = Node(crc, bucket if self.gains is None else self.gains[bucket])
        self.nodes += 1
        return node

    def walk(self, words: list[bytes]) -> Iterator[Node]:
        """The node of every feature of a document; a full trie is begun anew between two words."""
        longest = self.longest
        for k, word in enumerate(words):
            if self.nodes >= self.most:
                self.begin_anew()
            node = self.root.get(word) or self._node(self.root, word, None)
            yield node
            for more in words[k + 1 : k + longest]:
                if node.next is None:
                    node.next = {}
                node = node.next.get(more) or self._node(node.next, more, node)
                yield node

    def begin_anew(self) -> None:
        """Adds the counts of all nodes to the totals by bucket and drops the nodes."""
        todo = [self.root] if self.gains is None else []
        while todo:
            for node in todo.pop().values():
                self.counted[node.value] += node.count
                if node.next is not None:
                    todo.append(node.next)
        self.root, self.nodes = {}, 0


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()


def _counting(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(longest, buckets)
        for batch in batches:
            for text in _texts(batch):
                for node in trie.walk(words_of(text)):
                    node.count += 1
        trie.begin_anew()
        used = np.flatnonzero(trie.counted)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(trie.counted[used])], ["bucket", "n"])

    return run


def bucket_totals(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(bucket, n) over all texts of ``docs``: a row for each bucket that a partition used, then one for each bucket."""
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counting(longest, buckets), "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for every bucket: thousandths of the log of how much likelier it is in ``target`` than in ``source``, each count with one added."""
    spark = source.sparkSession
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    both = both.unionByName(spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    counted = materialize(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    sums = counted.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    ratio = ((F.col("t") + 1.0) * (F.col("all_s") + float(buckets))) / ((F.col("s") + 1.0) * (F.col("all_t") + float(buckets)))
    return counted.join(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def _scoring(longest: int, buckets: int, gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(longest, buckets, gains)
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            for text in _texts(batch):
                words, n, weight = words_of(text), 0, 0
                for node in trie.walk(words):
                    n += 1
                    weight += node.value
                rows.append((len(words), n, weight))
            made = [pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ([], [], []))]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *made], ["doc_id", "n_words", "n_features", "weight"])

    return run


def random_term(doc_id: Column, seed: int) -> Column:
    """Thousandths of a standard Gumbel value from the digest of ``seed:doc_id``; with it, the highest scores are a draw without replacement."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place from 1 on in ``order``: sorted by ranges, numbered in each, moved by the rows of ranges before.

    No task holds more than a range. ``order`` has to tell rows apart, or equal rows share a range.
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    spread = materialize(spread)
    part = F.shiftright("_at", 33)
    sizes = spread.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row for each partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = spread.withColumn("_part", part).join(F.broadcast(before), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_before")


def importance_resample(docs: DataFrame, target: DataFrame, *, longest: int = 2, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 0) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text).

    weight is how much likelier its features are in ``target`` (text) than in ``docs``; score adds a random term that doc_id and ``seed``
    decide. Of the documents with ``least_words`` words or more, ``percent`` in a hundred (rounded down) with the highest scores are drawn, of
    equal ones those with the smaller doc_id (null last); rank is their place, and null for all others. A null or empty text has no
    words and weight 0. Rows that share a doc_id count each by itself; a null doc_id is drawn with the seed alone. An empty table of documents gives no
    rows; an empty target makes what is rare in ``docs`` likely. Columns other than these are not read.
    """
    totals = [bucket_totals(t, longest, buckets) for t in (docs, target)]
    gains = np.zeros(buckets, np.int64)
    for r in bucket_gains(*totals, buckets).collect():  # one row for each bucket, a parameter
        gains[r.bucket] = r.gain
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_scoring(longest, buckets, gains), "doc_id long, n_words long, n_features long, weight long")
    scored = materialize(scored.withColumns({"score": F.col("weight") + random_term(F.col("doc_id"), seed), "eligible": F.col("n_words") >= least_words, "row": F.monotonically_increasing_id()}))
    drawn = scored.agg(F.count_if("eligible").alias("n")).select(F.floor(F.lit(percent) * F.col("n") / 100).cast("long").alias("drawn"))
    placed = ranked(scored, [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], "place").join(F.broadcast(drawn))
    rank = F.when(F.col("eligible") & (F.col("place") <= F.col("drawn")), F.col("place"))
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
