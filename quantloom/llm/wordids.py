"""Token ids of texts by a tokenizer that drops white space: each piece of text is encoded once and then looked up.

Texts are cut at blanks and, where the tokenizer's own splitting is known, between letters, digits and
punctuation. Pieces are found again by a key in an open-addressing table, all pieces of a batch at once.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

from quantloom.llm.shingles import mixed, text_bytes

_U = np.uint64
#: Slots of a worker's table; when half of them are taken it is begun anew.
SLOTS = 1 << 22
#: Pieces of letters only are handed to the tokenizer in rows of this many.
ROW = 500
#: A text of more characters is encoded in parts of about this size, cut at a blank.
PART = 1 << 22
#: The splitting in which the cuts between kinds of characters are certain (fixed value of the public vocabulary).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BLANK, _LETTER, _DIGIT, _MARK, _QUOTE, _HIGH = range(6)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0D]] = _BLANK
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[ord("'")] = _QUOTE
_KIND[128:] = _HIGH
#: Control characters may be white space to the tokenizer; they are not cut off.
_KIND[[*range(0, 9), 11, 12, *range(14, 32), 127]] = _HIGH
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
_CUT = np.zeros((6, 6), bool)
for _a, _b in ((_LETTER, _DIGIT), (_LETTER, _MARK), (_LETTER, _QUOTE), (_DIGIT, _LETTER), (_DIGIT, _MARK), (_DIGIT, _QUOTE), (_MARK, _LETTER), (_MARK, _DIGIT)):
    _CUT[_a, _b] = True
_CUT = _CUT.ravel()
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_ANY_BLANK = re.compile(r"[ \t\n\r]")


def keys(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A key of each piece data[start : start + size]: up to 7 bytes are the key themselves, longer ones are hashed to keys of another range."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    key = eight[start] & _BYTES[np.minimum(size, 8)]
    short = size < 8
    out = key | size.astype(np.uint64) << _U(56)
    at = np.flatnonzero(~short)
    h = mixed(key[at] + size[at].astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    left, done = np.arange(len(at)), 8
    huge = size[at] > 512
    while True:
        left = left[(size[at[left]] > done) & ~huge[left]]
        if not len(left):
            break
        rest = size[at[left]] - done
        h[left] = mixed(h[left] * _U(0xD6E8FEB86659FD93) + (eight[start[at[left]] + done] & _BYTES[np.minimum(rest, 8)]))
        done += 8
    for k in np.flatnonzero(huge).tolist():
        a = start[at[k]]
        h[k] = int.from_bytes(blake2b(data[a : a + size[at[k]]].tobytes(), digest_size=8).digest(), "little")
    out[at] = h | _U(1 << 63)
    return out


class WordIds:
    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            known = json.load(f)
        self.tokenizer = Tokenizer.from_file(file)
        self.special = [x["content"].encode() for x in known.get("added_tokens", [])]
        self.cuts = SPLIT in json.dumps(known.get("pre_tokenizer") or {}, ensure_ascii=False).replace("\\\\", "\\")
        suffix = known["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.joins = bool(suffix) and self.cuts
        if suffix:
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._empty()

    def _empty(self) -> None:
        self.slots, self.index = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.n = self.used = 0
        self.begin, self.count, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mixed(key) >> _U(65 - SLOTS.bit_length())).astype(np.int64)

    def _found(self, key: np.ndarray) -> np.ndarray:
        """Each key's number, -1 if it is new."""
        out = np.full(len(key), -1, np.int64)
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            there = self.slots[slot]
            hit = there == key[todo]
            out[todo[hit]] = self.index[slot[hit]]
            on = ~hit & (there != 0)
            todo, slot = todo[on], slot[on] + 1 & SLOTS - 1
        return out

    def _add(self, key: np.ndarray, ids: list[np.ndarray]) -> None:
        n, sizes = len(key), np.array([len(x) for x in ids], np.int64)
        new = np.concatenate(ids)
        while self.n + n > len(self.begin):
            self.begin, self.count = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.count, 2 * len(self.count))
        while self.used + len(new) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        own = slice(self.n, self.n + n)
        self.begin[own], self.count[own] = self.used + np.cumsum(sizes) - sizes, sizes
        self.flat[self.used : self.used + len(new)] = new
        todo, slot = np.arange(n), self._slot(key)
        while len(todo):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = key[todo[free]]
            won = self.slots[slot] == key[todo]
            self.index[slot[won]] = self.n + todo[won]
            todo, slot = todo[~won], slot[~won] + 1 & SLOTS - 1
        self.n += n
        self.used += len(new)

    def _encoded(self, pieces: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(pieces)
        alone = range(len(pieces))
        if self.joins:
            letters = [k for k, x in enumerate(pieces) if x.isalpha()]
            rows = [letters[k : k + ROW] for k in range(0, len(letters), ROW)]
            alone = [k for k, x in enumerate(pieces) if not x.isalpha()]
            for row, e in zip(rows, self.tokenizer.encode_batch_fast([" ".join([pieces[k] for k in row]) for row in rows], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.int64)
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) != len(row) or ends[-1] != len(ids):
                    alone += row  # a piece is more than one word to the tokenizer
                    continue
                for k, x in zip(row, np.split(ids, ends[:-1]), strict=True):
                    out[k] = x
        todo = list(alone)
        for k in range(0, len(todo), 20_000):
            part = todo[k : k + 20_000]
            for j, e in zip(part, self.tokenizer.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False), strict=True):
                out[j] = np.array(e.ids, np.int64)
        return out

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each text has; null counts as empty."""
        data, offsets = text_bytes(text)
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(text), np.int64)
        kind = _KIND[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        edge[0] = True
        edge[1:-1] |= kind[:-1] == _BLANK
        # a special token is one piece, in its own case; so no text of such a batch is cut between kinds
        whole = bytes(data) if self.special else b""
        if self.cuts and not any(s in whole for s in self.special):
            edge[1:-1] |= _CUT[kind[:-1] * 6 + kind[1:]]
            data = _LOWER[data]
        inside = kind != _BLANK
        start = np.flatnonzero(inside & edge[:-1])
        stop = edge[1:].copy()
        stop[:-1] |= ~inside[1:]
        size = np.flatnonzero(inside & stop) + 1 - start
        key = keys(data, start, size)
        if self.n * 2 > SLOTS:
            self._empty()
        at = self._found(key)
        new = np.flatnonzero(at < 0)
        if len(new):
            some, where = np.unique(key[new], return_index=True)
            pieces = [data[a : a + n].tobytes().decode() for a, n in zip(start[new[where]].tolist(), size[new[where]].tolist(), strict=True)]
            self._add(some, self._encoded(pieces))
            at[new] = self._found(key[new])
        n = self.count[at].astype(np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.begin[at] - ends + n, n) + np.arange(total)]
        upto = np.concatenate(([0], ends))[np.searchsorted(start, offsets)]
        return ids, np.diff(upto)


def parts(text: str, size: int | None = None) -> Iterator[str]:
    """The text in parts of about `size` characters, cut at blanks only."""
    at, size = 0, size or PART
    while len(text) - at > size:
        m = _ANY_BLANK.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


@functools.lru_cache(maxsize=1)
def word_ids(file: str) -> WordIds:
    """Once a Python worker."""
    return WordIds(file)
