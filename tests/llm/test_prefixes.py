"""The prefix trie against dictionaries of prefixes."""

import hashlib
import random
import re
import zlib

from quantloom.llm import common, prefixes

SCHEMA = "conv_id long, turn long, role string, text string, start string, path int"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))

    def tie(t):
        body = f"{len(t[1])}:{t[1]}{t[2]}"
        return (t[0] is not None, t[0] or 0, hashlib.sha256(body.encode()).hexdigest()[:32])

    for turns in own.values():
        turns.sort(key=tie)
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = [t[1:] for t in own.get(c - c % 20, [])[:h]] + [t[1:] for t in turns[h:]]
    nodes = {}
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(nodes[p]) - 1) * words + sum(saved[q] for q in kids.get(p, ()))
        leaves[p] = sum(leaves[q] for q in kids.get(p, ())) or 1
    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(seqs[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, ())), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in prefixes.prefix_trie(df).collect()), key=str)


def test_trie(spark, monkeypatch):
    r = random.Random(6)
    rows = []
    for c in range(1, 70):  # families of 20; the base of the first is absent
        stem = [f"q{c // 20}", f"a{c % 3}", "same words here"][: r.randint(0, 3)]
        for k, t in enumerate([*stem, *[f"turn {r.randrange(3)}" for _ in range(r.randint(0, 4))]]):
            rows.append((c, k if k else None, ("user", "assistant", None)[k % 3], t if k != 2 else None))
    # long ones: copies of a long one, one that parts from it late, one alone, and one that is another's prefix
    long = [f"word {k % 7} of {k}" for k in range(30)]
    for c, turns in ((100, long), (101, long), (102, long), (103, [*long[:21], "other", *long[22:]]), (104, [f"alone {k}" for k in range(25)]), (105, long[:19]), (106, long[:16]), (107, long[:8])):
        rows += [(c, k, "user", t) for k, t in enumerate(turns)]
    rows += [(200, 1, "user", "x")] * 2 + [(None, 0, "user", "of none"), (-7, 0, "user", "below zero"), (220, 0, "a", "b"), (221, 0, "a", "b")]
    rows += [(c, 0, "user", "short") for c in range(300, 420)]
    expected = brute(rows)
    assert trie(spark, rows) == expected
    assert any(row[3] > 20 and row[1] == 0 for row in expected) and max(row[1] for row in expected) == 30
    monkeypatch.setattr(prefixes, "PIECE", 7)  # ends of many conversations, hashed piece by piece
    assert trie(spark, rows) == expected
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "x")]) == []


def test_random_tries(spark):
    r = random.Random(11)
    rows = [(c, k, "u", r.choice("ab")) for c in range(40) for k in range(r.randint(1, 12))]
    assert trie(spark, rows) == brute(rows)


def test_turn_ids_carry_their_words(spark):
    rows = [("user", "one two  three"), ("", ""), ("a", "1:b c"), ("a1", ":b c")]
    df = spark.createDataFrame(rows, "role string, text string")
    got = df.select("text", prefixes.turn_id(df.role, df.text).alias("id")).withColumn("n", prefixes.words_of("id")).collect()
    assert [x.n for x in got] == [3, 0, 2, 2] and len({bytes(x.id) for x in got}) == 4 and all(len(x.id) == 20 for x in got)


def test_classes_are_equal_conversations(spark):
    t = common.Tables()
    turns = spark.createDataFrame([(c, p, x.encode()) for c, s in ((1, "ab"), (2, "ba"), (3, "ab"), (4, "a"), (6, "abb"), (7, "bab")) for p, x in enumerate(s)], "conv_id long, pos long, id binary")
    convs = spark.createDataFrame([(1, 2), (2, 2), (3, 2), (4, 1), (5, 0), (6, 3), (7, 3), (8, 0)], "conv_id long, length long")
    assert {(x.conv_id, x.rep, x.n) for x in prefixes.classes(turns, convs, t).collect()} == {(1, 1, 2), (3, 1, 2), (2, 2, 1), (4, 4, 1), (5, 5, 2), (8, 5, 2), (6, 6, 1), (7, 7, 1)}
