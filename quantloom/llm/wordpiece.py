"""Token counts by a linear longest-match automaton.

A trie of the vocabulary gets failure links as in linear-time word-piece matching: where the next
byte has no edge, the longest pieces of what has been read are popped and the state moves to what
is left of them. Each link carries the NUMBER of pieces it pops, so lengths need no pieces. Links
are followed once, when the table is built: table[state, byte] is the next state and how many
pieces were popped on the way, and the words of a batch step through it side by side.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Byte 0x20 and 0x09 to 0x0D part words.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: With fewer words than this still going, a plain loop is faster than arrays.
FEW = 48


class Automaton:
    """first: pieces that a word may begin with; rest: pieces that may follow (both as bytes)."""

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes]):
        edges: list[dict[int, int]] = [{}, {}]  # state 0: a word's start; state 1: after a piece
        final = [False, False]
        order: list[tuple[int, int, int]] = []
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                at = root
                for byte in piece:
                    nxt = edges[at].get(byte)
                    if nxt is None:
                        nxt = edges[at][byte] = len(edges)
                        edges.append({})
                        final.append(False)
                    at = nxt
                final[at] = at > 1
        n = len(edges)
        dead = n  # nothing matches: the word is unknown
        table = np.full((n + 1, 256), dead, np.int32)
        popped = np.zeros((n + 1, 256), np.int16)
        link, pops = [dead] * n, [0] * n
        level = [0, 1]
        for state in level:
            for byte, to in edges[state].items():
                table[state, byte] = to
        while level:  # by depth: a state's link leads to a shallower piece of text
            below = []
            for state in level:
                below += [(state, byte, to) for byte, to in edges[state].items()]
            for state, byte, to in below:
                if final[to]:
                    link[to], pops[to] = 1, 1
                elif link[state] != dead:
                    at, count = link[state], pops[state]
                    link[to], pops[to] = int(table[at, byte]), count + int(popped[at, byte])
                if link[to] != dead:
                    table[to] = table[link[to]]
                    popped[to] = popped[link[to]] + pops[to]
                for b, nxt in edges[to].items():
                    table[to, b], popped[to, b] = nxt, 0
            order += below
            level = [to for _, _, to in below]
        self.dead = dead
        self.table, self.popped = table.ravel(), popped.ravel()
        # at a word's end, what is left is popped until nothing is
        self.rest = np.zeros(n + 1, np.int32)
        self.fits = np.zeros(n + 1, bool)
        self.fits[1] = True
        for _, _, state in order:
            if link[state] != dead:
                self.fits[state] = self.fits[link[state]]
                self.rest[state] = pops[state] + self.rest[link[state]]

    def count(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lead: int | None = None) -> np.ndarray:
        """Pieces of every word data[start : start + size]; an unknown word counts as one.

        lead: a byte that is read before each word (a vocabulary's mark of a word's start).
        """
        order = np.argsort(-sizes, kind="stable")
        begin, size = starts[order], sizes[order]
        state = np.full(len(order), int(self.table[lead]) if lead is not None else 0, np.int32)
        total = np.zeros(len(order), np.int64)
        going, step = len(order), 0
        while going:
            going = int(np.searchsorted(-size, -step, "left"))  # words longer than step
            if going <= FEW:
                break
            at = state[:going].astype(np.int64) << 8 | data[begin[:going] + step]
            total[:going] += self.popped[at]
            state[:going] = self.table[at]
            step += 1
        table, popped = self.table, self.popped
        for k in range(going):
            s, t = int(state[k]), 0
            for byte in data[begin[k] + step : begin[k] + size[k]].tobytes():
                at = s << 8 | byte
                t += int(popped[at])
                s = int(table[at])
            state[k] = s
            total[k] += t
        out = np.empty(len(order), np.int64)
        out[order] = np.where(self.fits[state], total + self.rest[state], 1)
        return out


@functools.lru_cache(maxsize=2)
def from_ranks(path: str) -> tuple[Automaton, int]:
    """Automaton of a byte-level rank file: pieces with a leading blank begin a word, the others follow."""
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    first = [t for t in tokens if t[:1] == b" " and not _BLANK[list(t[1:])].any()]
    rest = [t for t in tokens if not _BLANK[list(t)].any()]
    return Automaton(first, rest), 0x20


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and size of every word in the texts data[offsets[i] : offsets[i + 1]], and its text's number."""
    blank = _BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~blank
    start = np.flatnonzero(inside & (np.concatenate(([True], blank[:-1])) | edge[:-1]))
    end = np.flatnonzero(inside & (np.concatenate((blank[1:], [True])) | edge[1:])) + 1
    return start, end - start, np.searchsorted(offsets, start, "right") - 1


def token_counts(docs: DataFrame, vocabulary: str, load=from_ranks, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words long, n_tokens long, longest long (tokens of the word that needs most) of every whole text.

    Words are runs of bytes other than ASCII white space. Null, empty and blank texts: zeros.
    Repeated rows stay repeated; other columns are ignored. vocabulary: a file that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, lead = load(vocabulary)
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                batch = whole.slice(k, 2048)
                text = batch.column(1).fill_null("")
                text = pa.concat_arrays([text]) if text.offset else text
                wide = pa.types.is_large_string(text.type)
                offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
                data = np.frombuffer(text.buffers()[2], np.uint8)[: offsets[-1]] if text.buffers()[2] is not None else np.empty(0, np.uint8)
                data, offsets = data[offsets[0] :], offsets - offsets[0]
                n = batch.num_rows
                if len(data):
                    start, size, doc = words(data, offsets)
                else:
                    start = size = doc = np.empty(0, np.int64)
                count = automaton.count(data, start, size, lead)
                longest = np.zeros(n, np.int64)
                np.maximum.at(longest, doc, count)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc, weights=count, minlength=n).astype(np.int64)), pa.array(longest)], ["doc_id", "n_words", "n_tokens", "longest"])

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long, longest long")
