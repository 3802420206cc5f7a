"""Encoding of whole texts by the chunk, with a bounded memo.

Texts repeat their words, so a worker that remembers the ids of each chunk encodes
only new ones. A chunk is a stretch of text whose encoding does not depend on what is
around it; where to cut depends on the pre-tokenizer and is stated at each splitter.
Ids travel as packed little-endian unsigned 32-bit integers (``bytes``), so a document
is one join of chunk encodings and its checksum needs no unpacking.
"""

from __future__ import annotations

import functools
import json
import re
import struct
from collections.abc import Callable, Iterable
from itertools import pairwise

#: Entries of one generation of a memo, about 200 bytes each; a worker holds two generations.
MEMO_ENTRIES = 500_000
#: Longer chunks are encoded each time they occur.
MEMO_CHUNK_CHARS = 64
#: Letters below U+0250; not the dotted capital I, which ends in a mark when lower-cased.
_LETTERS = "".join(chr(k) for k in range(0x250) if chr(k).isalpha() and k != 0x130)
#: Marks that follow words; not the apostrophe, which opens pre-tokens of letters.
_ENDS = re.escape("".join(chr(k) for k in range(0x21, 0x7F) if not chr(k).isalnum() and chr(k) != "'"))
# what they match in a list of chunks, one a line; a chunk of several lines is none of them
_ENDED = re.compile(rf"^( ?[{_LETTERS}]{{1,1000}})([{_ENDS}]+)$", re.MULTILINE)
_ASCII_WORD, _WORD = (re.compile(rf"^ ?[{letters}]{{1,1000}}$", re.MULTILINE) for letters in ("A-Za-z", _LETTERS))

# The normalizer and pre-tokenizer, as tokenizer files write them, that the splitters are right for.
_DROPS_SPACE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
_KEEPS_SPACE = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})


def whole_text(text: str) -> list[str]:
    """One chunk, for pre-tokenizers of which nothing is known."""
    return [text] if text else []


def split_dropping_space(text: str) -> list[str]:
    """Chunks for pre-tokenizers that drop white space: cut at spaces and newlines."""
    return [c for c in text.replace("\n", " ").split(" ") if c]


def split_leading_space(text: str) -> list[str]:
    """Chunks for byte-level pre-tokenizers, where one space belongs to the next word.

    With single spaces and newlines between visible characters, a match always ends
    before the space, before the newline and after the newline. Any other text is
    one chunk.
    """
    if not text:
        return []
    words = text.split()
    gaps = len(words) - 1
    # every gap is one character, each of them a space or a newline, and none is at an end
    regular = sum(map(len, words)) + gaps == len(text) and text.count(" ") + text.count("\n") == gaps and not text[0].isspace()
    if not regular or "\x00" in text:
        return [text]
    return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")


class ChunkEncoder:
    """``encode(texts)`` gives the packed ids of each text.

    ``encode_many`` encodes a list of chunks to packed ids; ``split`` cuts a text. The memo has two
    generations: when the young one is full it becomes the old one, and what is met again
    returns to the young one, so common chunks stay and memory is bounded.
    """

    def __init__(self, encode_many: Callable[[list[str]], Iterable[bytes]], split: Callable[[str], list[str]], entries: int = MEMO_ENTRIES, special: tuple[str, ...] = (), encode_whole: Callable[[str], bytes] | None = None):
        """Texts that hold a string of ``special`` are not cut and go to ``encode_whole``."""
        self._encode_many, self._split, self._entries, self._special, self._encode_whole = encode_many, split, entries, special, encode_whole
        self._memo: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = self._split
        alone = {k: self._encode_whole(t) for s in self._special for k, t in enumerate(texts) if t and s in t}
        chunks = [split(t) if t and k not in alone else [] for k, t in enumerate(texts)]
        new = set().union(*chunks).difference(self._memo)
        if new:
            self._learn(new)
        get = self._memo.__getitem__
        out = [alone[k] if k in alone else b"".join(map(get, c)) for k, c in enumerate(chunks)]
        if max(map(len, new), default=0) > MEMO_CHUNK_CHARS:
            for c in new:
                if len(c) > MEMO_CHUNK_CHARS:
                    del self._memo[c]
        if len(self._memo) > self._entries:
            self._memo, self._old = {}, self._memo
        return out

    def _learn(self, new: set[str]) -> None:
        memo, old = self._memo, self._old
        known = old.keys() & new
        memo.update(zip(known, map(old.__getitem__, known), strict=True))
        whole = new - known
        # stops, commas and the like after letters are a pre-token of their own
        ended = _ENDED.findall("\n".join(c for c in whole if "\n" not in c)) if self._split is not whole_text else []
        words = [head + tail for head, tail in ended]
        whole.difference_update(words)
        for part in zip(*ended, strict=True):
            whole.update(part)
        missing = list(whole.difference(memo))
        memo.update(zip(missing, self._encode_many(missing), strict=True))
        memo.update((word, memo[head] + memo[tail]) for word, (head, tail) in zip(words, ended, strict=True) if word in new)
        if max(map(len, missing), default=0) > MEMO_CHUNK_CHARS:
            for c in missing:
                if len(c) > MEMO_CHUNK_CHARS and c not in new:
                    del memo[c]


_PACKS = [struct.Struct(f"<{n}I").pack for n in range(64)]


def pack_ids(ids: list[int]) -> bytes:
    return _PACKS[len(ids)](*ids) if len(ids) < len(_PACKS) else struct.pack(f"<{len(ids)}I", *ids)


def byte_alphabet() -> list[str]:
    """The characters that byte-level vocabularies write bytes as: visible Latin-1 ones stand for themselves,
    the others in order for U+0100 onwards."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(0x100 + hidden.index(b)) for b in range(256)]


@functools.lru_cache(maxsize=4)
def library_encoder(path: str) -> ChunkEncoder:
    """A memoised encoder over the tokenizers library, one for each worker and file.

    Strings of special tokens in a text become those tokens, as the library has it: such a text is encoded by it alone. What
    follows holds for the two kinds of normalizer and pre-tokenizer that are known here: one keeps white space (byte-level), one
    drops it (word ends). Files with any others are encoded by the library, text by text.

    New chunks of letters below U+0250 are one pre-token each, normal as they are but for their case, and go
    straight to the library's model, 4,096 in a call; the bytes that tokens stand for tell where a chunk ends. Other new chunks go to the library in one call, joined by a pre-token that is one token and stays
    apart: a newline where white space is kept, else a bar between spaces. The ids between two
    of these are those of a chunk. Chunks that hold it themselves, and very long ones, are encoded alone.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import numpy as np
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import CharDelimiterSplit

    tokenizer = Tokenizer.from_file(path)
    written = json.loads(tokenizer.to_str())
    kind = (written["normalizer"], written["pre_tokenizer"])
    plain = all(t["special"] and not t["normalized"] for t in written["added_tokens"])
    special = tuple(t["content"] for t in written["added_tokens"])
    if not plain or kind not in (_DROPS_SPACE, _KEEPS_SPACE):
        return ChunkEncoder(lambda texts: [pack_ids(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts], whole_text)
    keeps_space = kind == _KEEPS_SPACE
    held, mark = ("\n", "\n") if keeps_space else ("|", " | ")
    (mark_id,) = tokenizer.encode(held, add_special_tokens=False).ids
    alphabet = byte_alphabet()

    normalize = str if keeps_space else str.lower
    # the model alone, over words that need no more than to be kept apart by a bar
    words_only = Tokenizer(tokenizer.model)
    words_only.pre_tokenizer = CharDelimiterSplit("|")
    suffix = written["model"].get("end_of_word_suffix") or ""
    vocabulary = tokenizer.get_vocab()
    n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # of text that a token stands for
    for token, k in vocabulary.items():
        n_bytes[k] = len(token.removesuffix(suffix))
    to_alphabet = dict(enumerate(alphabet))

    def by_model(words: list[str]) -> list[bytes]:
        """Each word is one pre-token: what normalizer and pre-tokenizer would hand to the model, by the byte alphabet."""
        text = normalize("|".join(words))
        raw = text.encode()
        ids = np.array(words_only.encode_batch_fast([text.replace(" ", "\u0120") if len(raw) == len(text) else raw.decode("latin-1").translate(to_alphabet)], add_special_tokens=False)[0].ids, "<u4")
        bars = np.flatnonzero(np.frombuffer(raw, np.uint8) == ord("|"))
        ends = np.append(bars - np.arange(bars.size), len(raw) - bars.size)
        reached = n_bytes[ids].cumsum()
        last = reached.searchsorted(ends)
        if not ids.size or last[-1] != ids.size - 1 or (reached[last] != ends).any():
            # the vocabulary lacks a byte: tokens do not tell which word they are of
            return [pack_ids([t.id for t in tokenizer.model.tokenize("".join(map(alphabet.__getitem__, normalize(w).encode())))]) for w in words]
        packed, cuts = ids.tobytes(), [0, *(4 * last + 4).tolist()]
        return [packed[i:j] for i, j in pairwise(cuts)]

    def encode_many(chunks: list[str]) -> list[bytes]:
        lines = "\n".join(c for c in chunks if "\n" not in c)
        plain = _ASCII_WORD.findall(lines)
        latin, got = list(set(_WORD.findall(lines)).difference(plain)), {}
        for words in (plain, latin):
            for at in range(0, len(words), 4096):
                part = words[at : at + 4096]
                got.update(zip(part, by_model(part), strict=True))
        rest = []
        for c in chunks:
            if c in got:
                continue
            if held in c or len(c) > 1000 or (keeps_space and c[-1].isspace()):
                got[c] = pack_ids(tokenizer.encode(c, add_special_tokens=False).ids)
            else:
                rest.append(c)
        if rest:
            ids = np.array(tokenizer.encode_batch_fast([mark.join(rest)], add_special_tokens=False)[0].ids, "<u4")
            raw, at = ids.tobytes(), 0
            for c, end in zip(rest, [*np.flatnonzero(ids == mark_id).tolist(), ids.size], strict=True):
                got[c] = raw[4 * at : 4 * end]
                at = end + 1
        return [got[c] for c in chunks]

    return ChunkEncoder(encode_many, split_leading_space if keeps_space else split_dropping_space, special=special, encode_whole=lambda t: pack_ids(tokenizer.encode(t, add_special_tokens=False).ids))
