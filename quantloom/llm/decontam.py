"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised to words and all their word runs stand in one automaton, whose states are classes of runs
that end at the same places. A document's words stream through it: the state and the longest matching length
at every word say which windows of the items end there. Words that no item has lead back to the start, so only
the runs of known words between them are stepped through, side by side, as arrays. A window is `length`
consecutive words of an item, or the whole of a shorter item.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import Tables
from quantloom.llm.shingles import mixed, text_bytes

#: Words of items in one automaton, about; more items make more automata, each met by all documents.
BLOCK_WORDS = 1 << 20
#: A longer item is cut into parts of so many words, which overlap so that no window is lost.
PART_WORDS = 1 << 16
#: Words of a lane; a longer run of known words goes on in the next lane, which begins a window earlier.
LANE = 256
#: Bytes of text that are worked on at once (a document is not cut).
SLICE_BYTES = 1 << 22
#: What a document's words are made of: digits, letters and all bytes beyond ASCII; A-Z count as a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True
_U = np.uint64
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and size of every word of the texts data[offsets[i] : offsets[i + 1]] (lower-cased), and its text's number."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = _INSIDE[data]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    # texts stand end to end: where one begins, no word goes on
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut], last[cut - 1] = inside[cut + 1], inside[cut]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1 - start, np.searchsorted(offsets, start, "right") - 1


def ends(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last (at most) eight bytes of every word; data is padded with eight bytes at both ends."""
    at = np.ndarray((len(data) - 7,), "<u8", data.tobytes() if not data.flags.c_contiguous else data, strides=(1,))
    keep = _KEEP[np.minimum(size, 8)]
    return at[start + 8] & keep, at[start + size] >> ((8 - np.minimum(size, 8)) * 8).astype(np.uint64)


class Vocabulary:
    """Numbers of the items' words, looked up for all words of many texts at once, exactly."""

    def __init__(self, known: list[bytes]):
        data = np.frombuffer(b"\0" * 8 + b"".join(known) + b"\0" * 8, np.uint8)
        size = np.array([len(w) for w in known], np.int64)
        low, high = ends(data, np.cumsum(size) - size, size)
        key = self.key(low, high, size)
        order = np.argsort(key, kind="stable")
        self.known, self.order, self.keys = known, order, key[order]
        self.low, self.high, self.size = low[order], high[order], size[order]
        #: Several words may have one key: so many entries are looked at from the first on.
        self.most = int(np.unique(key, return_counts=True)[1].max()) if len(key) else 0

    @staticmethod
    def key(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mixed(low * _U(0x9E3779B97F4A7C15) + mixed(high + size.astype(np.uint64)))

    def numbers(self, padded: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Each word's number, -1 if no item has it."""
        out = np.full(len(start), -1, np.int64)
        if not len(self.keys) or not len(start):
            return out
        low, high = ends(padded, start, size)
        key = self.key(low, high, size)
        first = np.searchsorted(self.keys, key)
        for k in range(self.most):
            at = np.minimum(first + k, len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == key)
            at = at[hit]
            some = (self.low[at] == low[hit]) & (self.high[at] == high[hit]) & (self.size[at] == size[hit])
            hit, found = hit[some], self.order[at[some]]
            long = np.flatnonzero(size[hit] > 16)  # what the two ends don't cover
            if len(long):
                wrong = [self.known[n] != padded[s + 8 : s + 8 + z].tobytes() for n, s, z in zip(found[long].tolist(), start[hit[long]].tolist(), size[hit[long]].tolist(), strict=True)]
                hit, found = np.delete(hit, long[wrong]), np.delete(found, long[wrong])
            out[hit] = found
        return out


class SuffixAutomaton:
    """The generalised suffix automaton of sequences of word numbers, and the windows of `length` in it."""

    def __init__(self, items: list[list[int]], length: int):
        self.length = length
        edges: list[dict[int, int]] = [{}]
        link, size = [-1], [0]

        def new(n: int, out: dict[int, int], to: int) -> int:
            edges.append(out)
            size.append(n)
            link.append(to)
            return len(edges) - 1

        def split(p: int, q: int, word: int) -> int:
            """The part of state q that p leads to by word, as a state of its own."""
            clone = new(size[p] + 1, dict(edges[q]), link[q])
            link[q] = clone
            while p >= 0 and edges[p].get(word) == q:
                edges[p][word] = clone
                p = link[p]
            return clone

        def extended(last: int, word: int) -> int:
            q = edges[last].get(word)
            if q is not None:
                return q if size[q] == size[last] + 1 else split(last, q, word)
            at, p = new(size[last] + 1, {}, 0), last
            while p >= 0 and word not in edges[p]:
                edges[p][word] = at
                p = link[p]
            if p >= 0:
                q = edges[p][word]
                link[at] = q if size[q] == size[p] + 1 else split(p, q, word)
            return at

        for item in items:
            last = 0
            for word in item:
                last = extended(last, word)
        n = len(edges)
        self.link, self.size = np.array(link, np.int64), np.array(size, np.int64)
        self.width = max((w for item in items for w in item), default=0) + 1
        keys = np.array([s * self.width + w for s, out in enumerate(edges) for w in out], np.int64)
        to = np.array([t for out in edges for t in out.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]
        self.start = np.zeros(self.width, np.int64)  # the first state's edges
        for w, t in edges[0].items():
            self.start[w] = t
        # a state's windows: the shorter state, or itself, whose runs' longest suffixes are `length` words
        self.window, self.short = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        by_size = np.argsort(self.size, kind="stable").tolist()
        for s in by_size:
            if size[s] >= length:
                self.window[s] = s if size[link[s]] < length else self.window[link[s]]
        self.items: dict[int, set[int]] = {}
        whole: set[int] = set()
        for k, item in enumerate(items):
            at = 0
            if len(item) < length:
                for word in item:
                    at = edges[at][word]
                # the item's own state: the longest run of it is the item, as it was inserted
                whole.add(at)
                self.items.setdefault(at, set()).add(k)
                continue
            for matched, word in enumerate(item, 1):
                at = edges[at][word]
                if matched >= length:
                    self.items.setdefault(int(self.window[at]), set()).add(k)
        for s in by_size:
            if s:
                self.short[s] = s if s in whole else self.short[link[s]]

    def step(self, state: np.ndarray, matched: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state and longest matching length of many streams, by their next words (all known)."""
        state, matched = state.copy(), matched.copy()
        left = np.arange(len(state))
        while len(left):
            at, w = state[left], word[left]
            key = at * self.width + w
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            done = left[hit]
            state[done] = self.to[k[hit]]
            matched[done] += 1
            left = left[~hit]
            # a shorter suffix of what has been matched; from the start every known word goes on
            back = self.link[state[left]]
            state[left], matched[left] = back, self.size[back]
        return state, matched

    def track(self, word: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and longest matching length (exact up to `length`) at every word of the runs word[begin : begin + size] of known words."""
        state, matched = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        # long runs go on in lanes that begin so much earlier that no window is cut
        more = np.maximum(0, -(-(size - LANE) // LANE))
        of = np.repeat(np.arange(len(size)), more + 1)
        number = np.arange(len(of)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
        early = np.where(number > 0, self.length - 1, 0)
        early = np.minimum(early, number * LANE)
        lane = begin[of] + number * LANE - early
        width = np.minimum(LANE, size[of] - number * LANE) + early
        order = np.argsort(-width, kind="stable")
        lane, width, early = lane[order], width[order], early[order]
        at, got = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
        for t in range(int(width[0]) if len(width) else 0):
            going = int(np.searchsorted(-width, -t, "left"))
            at, got = self.step(at[:going], got[:going], word[lane[:going] + t])
            own = early[:going] <= t
            state[lane[:going][own] + t], matched[lane[:going][own] + t] = at[own], got[own]
        return state, matched


class Matcher:
    """An automaton with its vocabulary and item names, as it is sent to tasks."""

    def __init__(self, names: list[str], texts: list[bytes], length: int):
        self.names, self.length = names, length
        number: dict[bytes, int] = {}
        items = []
        for text in texts:
            data = _LOWER[np.frombuffer(text, np.uint8)]
            start, size, _ = words(data, np.array([0, len(data)]))
            raw = data.tobytes()
            items.append([number.setdefault(raw[s : s + z], len(number)) for s, z in zip(start.tolist(), size.tolist(), strict=True)])
        kept = [k for k, item in enumerate(items) if item]
        self.names = [names[k] for k in kept]
        self.least = min((min(len(items[k]), length) for k in kept), default=1)
        self.vocabulary = Vocabulary(list(number))
        self.automaton = SuffixAutomaton([items[k] for k in kept], length)

    def match(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
        """Of a batch of texts: the words' starts, sizes, texts and whether they are hit; the texts' offsets and items."""
        data, offsets = text_bytes(text)
        padded = np.zeros(len(data) + 16, np.uint8)
        padded[8 : len(data) + 8] = _LOWER[data]
        start, size, doc = words(padded[8 : len(data) + 8], offsets)
        number = self.vocabulary.numbers(padded, start, size)
        known = number >= 0
        found: list[set[str]] = [set() for _ in range(len(text))]
        if not known.any():
            return start, size, doc, known, offsets, found
        # runs of known words inside a text; those shorter than any window are left out
        same = np.concatenate((doc[1:] == doc[:-1], [False]))
        goes = np.concatenate((known[:-1] & known[1:], [False])) & same
        first = np.flatnonzero(known & ~np.concatenate(([False], goes[:-1])))
        many = np.flatnonzero(known & ~goes) + 1 - first
        wide = many >= self.least
        a = self.automaton
        state, matched = a.track(number, first[wide], many[wide])
        at = np.flatnonzero(matched >= self.length)
        events = [(at, a.window[state[at]], np.full(len(at), self.length))]
        at = np.flatnonzero(matched > 0)
        s = a.short[state[at]]
        # the state's own item may be longer than what has been matched
        s = np.where((s >= 0) & (a.size[s] > matched[at]), a.short[a.link[s]], s)
        while len(at := at[s >= 0]):
            s = s[s >= 0]
            events.append((at, s, a.size[s]))
            s = a.short[a.link[s]]
        cover = np.zeros(len(start) + 1, np.int64)
        for at, s, n in events:
            np.add.at(cover, at - n + 1, 1)
            np.add.at(cover, at + 1, -1)
            for d, x in np.unique(np.stack((doc[at], s)), axis=1).T.tolist():
                found[d] |= {self.names[k] for k in a.items[x]}
        return start, size, doc, np.cumsum(cover[:-1]) > 0, offsets, found

    def columns(self, text: pa.Array) -> list[pa.Array]:
        """n_words, n_hit, items and spans of a batch of texts."""
        start, size, doc, hit, offsets, found = self.match(text)
        n = len(text)
        spans: list[list[dict]] = [[] for _ in range(n)]
        goes = np.concatenate((hit[:-1] & hit[1:] & (doc[1:] == doc[:-1]), [False])) if len(hit) else hit
        first, last = np.flatnonzero(hit & ~np.concatenate(([False], goes[:-1]))) if len(hit) else [], np.flatnonzero(hit & ~goes)
        zero = np.searchsorted(doc, np.arange(n))
        for a, b in zip(first, last, strict=True):
            d = doc[a]
            spans[d].append({"first": start[a] - offsets[d], "last": start[b] + size[b] - offsets[d] - 1, "first_word": a - zero[d], "last_word": b - zero[d]})
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "first_word", "last_word")]))
        return [pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc[hit], minlength=n)), pa.array([sorted(f) for f in found], pa.list_(pa.string())), pa.array(spans, kind)]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE_BYTES of text, a text at least."""
    size = np.cumsum(np.array(pa.compute.binary_length(batch.column(column)).fill_null(0), np.int64))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right"))
        end = max(at + 1, end)
        yield batch.slice(at, end - at)
        at = end


def items_of(benchmark: DataFrame, length: int) -> DataFrame:
    """item (its id as text; null: an item without a name), text of every item; long ones in parts that overlap."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), text.alias("text"))
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - length), F.lit(PART_WORDS)), lambda k: F.array_join(F.slice(w, k + 1, F.lit(PART_WORDS + length - 1)), " "))
    whole = F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    # parts begin so that every window is whole in one of them
    return rows.select("item", F.explode(F.when(F.length("text") <= PART_WORDS, F.array("text")).otherwise(cut(whole))).alias("text"))


def matchers(benchmark: DataFrame, length: int, tables: Tables) -> Iterator[Matcher]:
    """The automata, built in tasks and brought here one at a time; each holds about BLOCK_WORDS words."""
    items = tables.stored(items_of(benchmark, length), "items")
    size = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-size // (4 * BLOCK_WORDS)))

    def built(rows: pd.DataFrame) -> pd.DataFrame:
        names = ["" if pd.isna(x) else str(x) for x in rows["item"]]
        return pd.DataFrame({"matcher": [pickle.dumps(Matcher(names, [t.encode() for t in rows["text"]], length))]})

    parted = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    made = tables.stored(parted.groupBy("block").applyInPandas(built, "matcher binary").withColumn("number", F.monotonically_increasing_id()), "automata")
    for (number,) in made.select("number").orderBy("number").toLocalIterator():
        yield pickle.loads(made.where(F.col("number") == number).first().matcher)
    if made.isEmpty():
        yield Matcher([], [], length)


_SPANS = "array<struct<first:long,last:long,first_word:long,last_word:long>>"


def _merged(spans: Column) -> Column:
    """Spans in order, those that overlap or touch made one."""
    start = F.array().cast(_SPANS)

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (x.first_word <= F.try_element_at(acc, F.lit(-1)).last_word + 1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"), last.first_word.alias("first_word"), F.greatest(last.last_word, x.last_word).alias("last_word"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), start, step)


def matched(docs: DataFrame, benchmark: DataFrame, length: int = 10, keep: tuple[str, ...] = ("doc_id",), tables: Tables | None = None) -> DataFrame:
    """row (a struct of the columns `keep`), n_words, n_hit, items (array<string>, in order), spans of every row of docs.

    spans: runs of hit words: first and last byte (of the UTF-8 text, from 0) and first and last word. A word is hit
    if it lies in a window of an item that occurs there. Null and empty texts have no words; repeated rows stay;
    rows of one item_id are one item; an item without an id is listed as an empty name; items without words are nowhere.
    """
    tables = tables or Tables()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.monotonically_increasing_id().alias("uid"), F.col("text").cast("string").alias("text"))
    shape = f"row {rows.schema['row'].dataType.simpleString()}, uid long, n_words long, n_hit long, items array<string>, spans {_SPANS}"
    parts = []
    for matcher in matchers(benchmark, length, tables):
        sent = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, all_=not parts) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in _slices(whole, 2):
                    columns = [*batch.columns[:2], *sent.value.columns(batch.column(2))]
                    out = pa.RecordBatch.from_arrays(columns, ["row", "uid", "n_words", "n_hit", "items", "spans"])
                    yield out if all_ else out.filter(pa.compute.greater(columns[3], 0))

        parts.append(rows.mapInArrow(run, shape))
    out = parts[0]
    if len(parts) > 1:  # only rows with hits meet again
        some = out.where("n_hit > 0")
        for part in parts[1:]:
            some = some.unionByName(part)
        each = some.groupBy("uid").agg(_merged(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        hits = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x.last_word - x.first_word + 1)
        out = out.select("row", "uid", "n_words").join(each.withColumn("n_hit", hits), "uid", "left").select("row", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))
    return out.select("row", "n_words", "n_hit", "items", "spans")


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row: see matched(); other columns are ignored."""
    tables = Tables()
    found = matched(docs, benchmark, length, tables=tables)
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, length: int = 10, longest: int = 0, coverage: float = 0.5) -> DataFrame:
    """docs without what is known from the benchmark, with all their columns.

    Runs of hit words of more than `longest` words are cut out of a text; a text of whose words more than `coverage` are
    hit goes as a whole. Other texts, null ones too, stay as they are.
    """
    kept = matched(docs, benchmark, length, tuple(docs.columns)).where(F.col("n_hit") <= F.col("n_words") * coverage)
    text = F.col("row.text").cast("string")
    cuts = F.filter("spans", lambda x: x.last_word - x.first_word + 1 > longest)
    raw = F.encode(text, "UTF-8")
    first = F.concat(F.array(F.lit(0).cast("long")), F.transform(cuts, lambda x: x["last"] + 1))
    last = F.concat(F.transform(cuts, lambda x: x["first"]), F.array(F.octet_length(text).cast("long")))
    pieces = F.zip_with(first, last, lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8"))
    new = F.when(F.size(cuts) > 0, F.array_join(pieces, "")).otherwise(text)
    return kept.select(*[(new if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: The same in DuckDB: every document's runs of words of each window size, joined with the windows.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_SQL_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS run
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
runs AS (SELECT uid, n, k, array_to_string(w[k:k + n - 1], ' ') AS run FROM (SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT r.uid, r.n, r.k, x.item FROM runs r JOIN windows x ON r.n = x.n AND r.run = x.run),
hits AS (SELECT uid, count(DISTINCT place) AS n_hit FROM (SELECT uid, unnest(range(k, k + n)) AS place FROM found) GROUP BY uid),
items AS (SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT uid, item FROM found) GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (uid) LEFT JOIN items USING (uid)
"""
