"""Counts of greedy word pieces by a linear longest-match automaton.

A word is matched against the vocabulary from the left, each time by the longest
entry. The automaton is the vocabulary's trie with, at every node, a failure link and the number
of pieces that are final when the link is taken. A word is read once; no byte is read twice
and no piece is built.

For the node v reached from u by byte c: if v spells an entry, its link is the root and it
pops one piece. Otherwise its link follows the links of u until one has a child for c, and
it pops what those links pop. A node without a link means that the word cannot be cut up
greedily; such a word counts as one unknown piece.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftscan.llm.byte_bpe import load_ranks

#: Words a worker remembers before it starts anew, and the longest that it remembers.
MEMO_WORDS, MEMO_WORD_BYTES = 600_000, 64


class LongestMatchAutomaton:
    """Trie over bytes with failure links and popped-piece counts."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.children: list[dict[int, int]] = [{}]
        final = [False]
        for entry in vocabulary:
            if not entry:
                continue
            at = 0
            for c in entry:
                nxt = self.children[at].get(c)
                if nxt is None:
                    nxt = self.children[at][c] = len(self.children)
                    self.children.append({})
                    final.append(False)
                at = nxt
            final[at] = True
        self.link = [-1] * len(final)
        self.popped = [0] * len(final)
        waiting = deque([0])
        while waiting:
            u = waiting.popleft()
            for c, v in self.children[u].items():
                waiting.append(v)
                if final[v]:
                    self.link[v], self.popped[v] = 0, 1
                    continue
                z, pops = self.link[u], self.popped[u]
                while z >= 0 and c not in self.children[z]:
                    pops, z = pops + self.popped[z], self.link[z]
                if z >= 0:
                    self.link[v], self.popped[v] = self.children[z][c], pops

    def count(self, word: bytes) -> int:
        """Pieces of a word; 0 for the empty word, 1 for a word that cannot be cut up."""
        children, link, popped = self.children, self.link, self.popped
        at = pieces = 0
        for c in word:
            while (nxt := children[at].get(c)) is None:
                pieces += popped[at]
                at = link[at]
                if at < 0:
                    return 1
            at = nxt
        while at > 0:
            pieces += popped[at]
            at = link[at]
        return pieces if at == 0 else 1


@functools.lru_cache(maxsize=2)
def _automaton(path: str) -> LongestMatchAutomaton:
    return LongestMatchAutomaton(load_ranks(path))


class _Memo(dict):
    def __init__(self, automaton: LongestMatchAutomaton, prefix: bytes):
        super().__init__()
        self.automaton, self.prefix = automaton, prefix

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(self.prefix + word)
        if len(word) <= MEMO_WORD_BYTES:
            if len(self) > MEMO_WORDS:
                self.clear()
            self[word] = n
        return n


def _counts(batches: Iterator[pa.RecordBatch], path: str, prefix: bytes) -> Iterator[pa.RecordBatch]:
    memo = _Memo(_automaton(path), prefix)
    for b in batches:
        words_n, tokens_n, most = [], [], []
        for text in b.column(1):
            buffer = text.as_buffer() if text.is_valid else None
            counts = [memo[w] for w in buffer.to_pybytes().split()] if buffer is not None else []
            words_n.append(len(counts))
            tokens_n.append(sum(counts))
            most.append(max(counts, default=0))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (words_n, tokens_n, most))], names=["doc_id", "n_words", "n_tokens", "most_in_word"])


def token_counts(docs: DataFrame, vocabulary_path: str, prefix: bytes = b" ") -> DataFrame:
    """Greedy word-piece counts of whole texts: doc_id, n_words, n_tokens, most_in_word.

    Words are stretches without space, tab, newline, vertical tab, form feed and carriage return;
    each is matched as UTF-8 bytes after ``prefix``, the mark of a word's start in
    the vocabulary.

    Defined cases: null and empty texts, and texts of white space, have 0 words and 0
    tokens; repeated rows and null ids are kept; an empty table gives no rows; other
    columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _counts(it, vocabulary_path, prefix), "doc_id long, n_words long, n_tokens long, most_in_word long")
