"""Decontamination against brute force on windows of words."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quantloom.llm import decontam

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(text, items, length):
    w = split(text)
    hit, found = set(), set()
    for name, t in items:
        x = split(t)
        n = min(length, len(x))
        for k in range(len(x) - n + 1) if n else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == x[k : k + n]:
                    hit |= set(range(j, j + n))
                    found.add(name)
    return len(w), len(hit), sorted(found), hit


def random_text(r, n, letters="abc"):
    return " ".join(r.choice(letters) for _ in range(n))


def test_automaton_equals_brute_force(monkeypatch):
    monkeypatch.setattr(decontam, "LANE", 7)
    r = random.Random(3)
    for trial in range(60):
        length = r.randint(2, 6)
        items = [(str(k), random_text(r, r.randint(0, 12), "abcd"[: r.randint(1, 4)])) for k in range(r.randint(1, 6))]
        m = decontam.Matcher([k for k, _ in items], [t.encode() for _, t in items], length)
        texts = [random_text(r, r.randint(0, 60), "abcde"[: r.randint(1, 5)]) for _ in range(8)] + [None, "", items[0][1]]
        n, hit, names, spans = (x.to_pylist() for x in m.columns(pa.array(texts)))
        for k, t in enumerate(texts):
            expected = brute(t, items, length)
            assert (n[k], hit[k], names[k]) == expected[:3], (trial, items, t)
            assert {i for s in spans[k] for i in range(s["first_word"], s["last_word"] + 1)} == expected[3]


def test_words_are_told_apart_exactly():
    long = "x" * 30
    m = decontam.Matcher(["a"], [f"{long}y{long} one two".encode()], 3)
    texts = [f"{long}Y{long} ONE, two", f"{long}z{long} one two", "Ä one two", f"{long}y{long}one two"]
    assert m.columns(pa.array(texts))[1].to_pylist() == [3, 0, 0, 0]
    known = [b"a", b"ab", b"abcdefgh", b"abcdefghi", b"abcdefghabcdefgh", b"abcdefghXabcdefgh", "é漢".encode()]
    v = decontam.Vocabulary(known)
    data = np.frombuffer(b"\0" * 8 + b" ".join([*known, b"abcdefghYabcdefgh", b"b"]) + b"\0" * 8, np.uint8)
    size = np.array([len(w) for w in [*known, b"abcdefghYabcdefgh", b"b"]])
    assert v.numbers(data, np.cumsum(size + 1) - size - 1, size).tolist() == [*range(len(known)), -1, -1]


def test_contamination(spark, monkeypatch):
    r = random.Random(8)
    passage = [f"p{r.randrange(10**6)}" for _ in range(40)]
    items = [(1, " ".join(passage)), (2, "Only four words here!"), (2, "and more of the same item " + " ".join(passage[5:15])), (None, "nameless thing"), (4, None), (5, " ,. "), (6, " ".join(passage[:10]))]
    docs = [(1, "Start. " + ", ".join(passage[3:20]).upper() + ". The end"), (2, " ".join(passage[:9])), (3, "only FOUR words-here"), (4, None), (5, ""), (6, "x " * 3000 + " ".join(passage) + " y" * 3000), (7, "A nameless thing, nameless thing"), (7, "A nameless thing, nameless thing"), (None, " ".join(passage[5:15])), (9, "clean text")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as uid")
    df = spark.createDataFrame([(*d, "clash", [1]) for d in docs], "doc_id long, text string, row string, spans array<int>")
    named = [("" if k is None else str(k), t) for k, t in items]

    def check():
        got = sorted((str(x.doc_id), x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontam.contamination(df, bench).collect())
        expected = []
        for d, t in docs:
            n, hit, names, _ = brute(t, named, 10)
            expected.append((str(d), n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0))
        assert got == sorted(expected)

    check()
    kept = {x.doc_id: x for x in decontam.decontaminated(df, bench, longest=10, coverage=0.9).collect()}
    assert kept[1].text == "Start. . The end" and kept[9].text == "clean text" and kept[4].text is None
    assert 3 not in kept and kept[2].text == docs[1][1] and kept[9].row == "clash"
    assert decontam.contamination(df.limit(0), bench).count() == 0
    assert not any(x.contaminated for x in decontam.contamination(df, bench.limit(0)).collect())
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 20)  # several automata, and hits of several in one document
    check()
    assert {x.doc_id: x.text for x in decontam.decontaminated(df, bench, longest=10, coverage=0.9).collect()} == {k: x.text for k, x in kept.items()}


def test_long_items_are_cut_into_parts_that_overlap(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PART_WORDS", 8)
    w = [f"w{k}" for k in range(50)]
    bench = spark.createDataFrame([(1, " ".join(w)), (2, "short one " + "-" * 100)], "item_id long, text string")
    parts = [split(x.text) for x in decontam.items_of(bench, 4).where("item = '1'").collect()]
    windows = {tuple(p[k : k + 4]) for p in parts for k in range(len(p) - 3)}
    assert windows == {tuple(w[k : k + 4]) for k in range(47)} and max(map(len, parts)) == 11
    assert [split(x.text) for x in decontam.items_of(bench, 4).where("item = '2'").collect()] == [["short", "one"]]


def test_slices_hold_whole_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "", "b" * (decontam.SLICE_BYTES + 5), "c"])], ["t"])
    got = [x for s in decontam._slices(batch, 0) for x in s.column(0).to_pylist()]
    assert got == batch.column(0).to_pylist() and pytest.approx(len(list(decontam._slices(batch, 0))), abs=2) == 3
