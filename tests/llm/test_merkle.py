"""The Merkle manifest against a plain recursive one."""

import hashlib
import zlib

from pyspark.sql import functions as F

from quantloom.llm import common, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos string, tree int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def entry(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return h(*[entry(v) for v in (r[0], r[3], r[2], r[4], text)])


def tree(nodes):
    """Root, and each node's (place, siblings) by level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    proofs = []
    for i in range(len(nodes)):
        proof, at = [], i
        for level in levels[:-1]:
            run = level[at // 16 * 16 : at // 16 * 16 + 16]
            proof.append((at % 16, run[: at % 16] + run[at % 16 + 1 :]))
            at //= 16
        proofs.append(proof)
    return levels[-1][0], proofs


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = [tree([leaf(r, r[1]) for r in by[s]]) for s in names]
    root, upper = tree([t[0] for t in trees])
    out = []
    for k, s in enumerate(names):
        for r, proof in zip(by[s], trees[k][1], strict=True):
            at = own = leaf(r, r[1])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                at = leaf(r, r[1].translate(str.maketrans(merkle.UPPER, merkle.LOWER)))
            whole = proof + upper[k]
            for place, others in whole:
                at = h(*others[:place], at, *others[place:])
            out.append((r[0], own, trees[k][0], root, h(*[x for _, o in whole for x in o]), at, at == root))
    return out


def rows_of(df):
    return [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()]


def key(r):
    return tuple(str(x) for x in r)


def test_manifest(spark):
    rows = [(k, f"Text {k} é" if k % 7 else None, "en" if k % 3 else None, f"s{k % 3}" if k % 4 else None, k if k % 5 else None, "x", 1) for k in range(60)]
    rows += [(None, "no id", None, "s1", 3, "x", 1)] * 2 + [(5, "", "", "", 0, "x", 1), (7, "again", "en", "s1", 1, "x", 1), (7, "again", "en", "s1", 1, "x", 1), (200, "ALONE", "en", "ž", 5, "x", 1), (201, "X" * 100_000, "en", "S", 5, "x", 1)]
    rows += [(1000 + k, f"ONE {k}", "en", "big", 4, "x", 1) for k in range(300)]  # two rounds: more than a block
    docs = spark.createDataFrame(rows, DOCS)
    got = rows_of(merkle.manifest(docs))
    expected = brute(rows)
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert any(not r[6] for r in got) and any(r[6] for r in got)
    assert merkle.manifest(docs.limit(0)).count() == 0
    one = [(1, None, None, None, None, "x", 1)]
    assert rows_of(merkle.manifest(spark.createDataFrame(one, DOCS))) == brute(one)


def test_many_sources_make_a_deep_upper_tree(spark):
    rows = [(k, "A", "en", f"s{k:04d}", 1, "x", 1) for k in range(270)]
    assert sorted(rows_of(merkle.manifest(spark.createDataFrame(rows, DOCS))), key=key) == sorted(brute(rows), key=key)


def test_a_block_climbs_as_far_as_its_tree():
    for n in (1, 2, 16, 17, 255, 256):
        digests = [hashlib.sha256(str(k).encode()).digest() for k in range(n)]
        block = merkle.Block(0, digests, n)
        root, proofs = tree([d.hex() for d in digests])
        assert block.root.hex() == root
        assert {k: [(p, [x.hex() for x in s]) for p, s in proof] for k, proof in block.proofs(())} == dict(enumerate(proofs))


def test_places_in_groups(spark):
    rows = [(k % 2 if k % 3 else None, k // 10, k) for k in range(200)] + [(0, 1, 7)] * 50
    df = common.Tables().stored(spark.createDataFrame(rows, "g int, o int, x int"), "rows")
    got = common.placed(df, ["g"], ["o", "x"], "at", common.Tables()).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r["at"], r.o, r.x))
    assert len(got) == len(rows)
    for cells in by.values():
        cells.sort()
        assert [c[0] for c in cells] == list(range(len(cells))) and [c[1:] for c in cells] == sorted(c[1:] for c in cells)
    alone = common.placed(df, [], ["x"], "at", common.Tables()).orderBy("at").collect()
    assert [r["at"] for r in alone] == list(range(len(rows))) and [r.x for r in alone] == sorted(r[2] for r in rows)
    assert common.placed(df.where(F.lit(False)), ["g"], ["x"], "at", common.Tables()).count() == 0
