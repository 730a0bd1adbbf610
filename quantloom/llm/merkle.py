"""Merkle manifest of a dataset by time-forward processing: digests, proofs and their check.

Nodes are processed in the order of their labels (the last leaf below, then the level), as on a disk of any
size: a node sends its digest to its parent through a priority queue ordered by label, and when the sweep
comes to the parent, all its children's digests stand at the queue's head. A sweep is cut into blocks of
RUN ** LIFT nodes. What a block sends within itself waits in a heap of at most RUN messages a level; what it
sends beyond goes to the queue's outer part, a table in the shared folder that the next round's blocks read.
The way back is the same with labels descending: a node sends each child the siblings' digests and what it
got itself, so a proof's suffix comes down from the root, and leaves hash and fold whole proofs.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import Tables, placed

#: Consecutive nodes that have one parent.
RUN = 16
#: Levels that a block of a sweep climbs.
LIFT = 2
#: Letters that tampering changes.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_QUEUE = "tree long, pos long, digest binary, n long"
_SUFFIX = "tree long, pos long, places array<int>, siblings array<binary>, subroot binary"


def entry(value: Column) -> Column:
    """A field as it is hashed: `-` if null, else its bytes' count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[entry(c) for c in fields]), 256))


def hashed(parts: list[bytes]) -> bytes:
    """Digest of digests, which are put end to end as hexadecimal text."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


class Block:
    """A part of a tree: nodes first, first + 1, .. of a level that has n nodes in all, and what stands above them, up to LIFT levels."""

    def __init__(self, first: int, digests: list[bytes], n: int, lift: int = LIFT):
        self.first, self.n, self.top = first, n, 0
        while self.top < lift and RUN**self.top < n:
            self.top += 1
        self.children: dict[tuple[int, int], list[bytes]] = {}
        queue: list[tuple] = []

        def send(level: int, index: int, value: bytes) -> None:
            if level == self.top:
                self.root, self.index = value, index
            else:
                heapq.heappush(queue, (*self.label(level + 1, index // RUN), index // RUN, index % RUN, value))

        for p, value in enumerate(digests, first):
            send(0, p, value)
            while queue and queue[0][0] <= p:
                _, level, index, _, _ = queue[0]
                got = []
                while queue and queue[0][1:3] == (level, index):
                    got.append(heapq.heappop(queue)[4])
                self.children[level, index] = got
                send(level, index, hashed(got))

    def label(self, level: int, index: int) -> tuple[int, int]:
        """A node's time: the last node of the lowest level below it, then its level."""
        return min((index + 1) * RUN**level, self.n) - 1, level

    def proofs(self, suffix: tuple) -> Iterator[tuple[int, tuple]]:
        """(place from first on, proof) of every node of the lowest level, the last one first; a proof: (place, siblings) by level, upwards."""
        queue = [(*(-x for x in self.label(self.top, self.index)), self.index, suffix)]
        while queue:
            _, level, index, proof = heapq.heappop(queue)
            if not level:
                yield index - self.first, proof
                continue
            got = self.children[-level, index]
            for k, _ in enumerate(got):
                child = index * RUN + k
                heapq.heappush(queue, (*(-x for x in self.label(-level - 1, child)), child, ((k, got[:k] + got[k + 1 :]), *proof)))


def _block(rows: pa.Table) -> tuple[pa.Table, Block]:
    """A group's rows by their place, and the block that they are."""
    rows = rows.take(pa.array(np.argsort(rows["pos"].to_numpy(), kind="stable")))
    return rows, Block(rows["pos"][0].as_py(), rows["digest"].to_pylist(), rows["n"][0].as_py())


def _table(rows: list[tuple], columns: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(columns.items())})


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("pos") / RUN**LIFT).cast("long"))


def climbed(queue: DataFrame, tables: Tables) -> tuple[list[DataFrame], DataFrame]:
    """The outer queue of every round (the first is the given one), and the trees' roots: tree, digest.

    queue: tree, pos (0..n-1 of each tree, without gaps), digest, n.
    """

    def up(rows: pa.Table) -> pa.Table:
        rows, block = _block(rows)
        return pa.table({"tree": rows["tree"][:1], "pos": pa.array([block.index], pa.int64()), "digest": pa.array([block.root]), "n": pa.array([-(-block.n // RUN**block.top)], pa.int64())})

    rounds, roots = [queue], None
    most = queue.agg(F.max("n").alias("n")).first().n or 0
    while True:
        at = tables.stored(_in_blocks(rounds[-1].select("tree", "pos", "digest", "n")).groupBy("tree", "block").applyInArrow(up, _QUEUE), "queue")
        done = at.where("n = 1").select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        most = -(-most // RUN**LIFT)
        if most <= 1:
            return rounds, roots
        rounds.append(tables.stored(at.where("n > 1"), "queue"))


def _suffix(rows: pa.Table) -> tuple:
    return tuple((k, [s[i : i + 32] for i in range(0, len(s), 32)]) for k, s in zip(rows["places"][0].as_py(), rows["siblings"][0].as_py(), strict=True))


def delivered(cells: DataFrame, above: DataFrame) -> DataFrame:
    """What each node of a round gets from above: tree, pos, places, siblings, subroot; above: the same for the round's blocks."""

    def down(rows: pa.Table, got: pa.Table) -> pa.Table:
        rows, block = _block(rows)
        tree, subroot = rows["tree"][0].as_py(), got["subroot"][0].as_py()
        out = [(tree, block.first + k, [p for p, _ in proof], [b"".join(s) for _, s in proof], subroot) for k, proof in block.proofs(_suffix(got))]
        return _table(out, {"tree": pa.int64(), "pos": pa.int64(), "places": pa.list_(pa.int32()), "siblings": pa.list_(pa.binary()), "subroot": pa.binary()})

    nodes = _in_blocks(cells.select("tree", "pos", "digest", "n"))
    return nodes.groupBy("tree", "block").cogroup(above.groupBy("tree", "pos")).applyInArrow(down, _SUFFIX)


def received(rounds: list[DataFrame], tops: DataFrame, tables: Tables) -> DataFrame:
    """What the first round's blocks get from above: tree, pos (the block's), places, siblings, subroot.

    tops: tree, places, siblings, subroot: the proof of each tree's root within what stands above it.
    """
    got = None
    for k in range(len(rounds) - 1, -1, -1):
        # a tree that ends in this round has one block here, and its root's proof comes from above
        ends = rounds[k].where(F.col("pos") == 0).where(F.col("n") <= RUN**LIFT).select(F.col("tree").alias("_tree"))
        own = tops.join(ends, F.col("tree") == F.col("_tree")).select("tree", F.lit(0).cast("long").alias("pos"), "places", "siblings", "subroot")
        got = own if got is None else got.unionByName(own)
        if k:
            got = tables.stored(delivered(rounds[k], got), "suffixes")
    return got


def judged(cells: DataFrame, above: DataFrame, root: bytes) -> DataFrame:
    """The manifest's rows of the leaves (tree, pos, doc_id, digest, fake, n), from what their blocks get from above."""

    def down(rows: pa.Table, got: pa.Table) -> pa.Table:
        rows, block = _block(rows)
        tree, subroot, out = rows["tree"][0].as_py(), got["subroot"][0].as_py(), []
        ids, leaves, fakes = (rows[c].to_pylist() for c in ("doc_id", "digest", "fake"))
        for k, proof in block.proofs(_suffix(got)):
            folded = leaves[k] if fakes[k] is None else fakes[k]
            for place, others in proof:
                folded = hashed([*others[:place], folded, *others[place:]])
            siblings = hashed([x for _, others in proof for x in others])
            out.append((ids[k], tree, block.first + k, leaves[k].hex(), subroot.hex(), root.hex(), siblings.hex(), folded.hex(), folded == root))
        return _table(out, {c: pa.int64() for c in ("doc_id", "source_ix", "position")} | {c: pa.string() for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")} | {"verified": pa.bool_()})

    schema = "doc_id long, source_ix long, position long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _in_blocks(cells).groupBy("tree", "block").cogroup(above.groupBy("tree", "pos")).applyInArrow(down, schema)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source_ix, position, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    A leaf is the digest of the row's fields (FIELDS), each marked with its length. A source's leaves go by doc_id
    (null first; rows of one id by their leaves) into a tree of RUN children a node; the sources' roots, in order of
    source (null, which is a source like any other, first), likewise into one root. proof_sha256 hashes the
    siblings from the leaf up to the root. folded_root is folded from the proof and the leaf, which for ids with
    crc32 divisible by 5 is that of the tampered text (A-Z in lower case; a text without them stays as it is);
    verified: whether it is the root. Repeated rows are leaves of their own; empty texts differ from null ones; other
    columns are ignored; without rows there is no root and no row.
    """
    tables = Tables()
    fields = [F.col(c) for c in FIELDS]
    false = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    tampered = digest([*fields[:-1], F.translate(F.col("text").cast("string"), UPPER, LOWER)])
    leaves = tables.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), digest(fields).alias("digest"), F.when(false, tampered).alias("fake")), "leaves")
    at = placed(leaves, ["source"], ["doc_id", "digest"], "pos", tables)
    sources = placed(tables.stored(leaves.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("n")), "sources"), [], ["_source"], "tree", tables)
    first = tables.stored(at.join(sources, F.col("source").eqNullSafe(F.col("_source"))).select("tree", "pos", "doc_id", "digest", "fake", "n"), "queue")
    rounds, subroots = climbed(first, tables)
    subroots = tables.stored(subroots, "subroots")
    nodes = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", F.lit(subroots.count()).cast("long").alias("n"))
    upper, roots = climbed(tables.stored(nodes, "queue"), tables)
    top = roots.first()
    none = roots.select("tree", F.array().cast("array<int>").alias("places"), F.array().cast("array<binary>").alias("siblings"), F.col("digest").alias("subroot"))
    proofs = delivered(upper[0], received(upper, none, tables)).select(F.col("pos").alias("_tree"), "places", "siblings")
    tops = tables.stored(subroots.join(proofs, F.col("tree") == F.col("_tree")).select("tree", "places", "siblings", F.col("digest").alias("subroot")), "proofs")
    above = tables.stored(received(rounds, tops, tables), "suffixes")
    tables.drop((first, above))
    return judged(first, above, bytes(top.digest) if top else b"")


def _levels(name: str, many: int, key: str) -> str:
    """SQL of `many` levels of trees, with what stands left and right of each node in its run."""
    parts = []
    for k in range(many):
        run = f"(PARTITION BY {key}pos // 16 ORDER BY pos ROWS BETWEEN"
        parts.append(f"""{name}{k}s AS (SELECT *, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,
  CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r FROM {name}{k})""")
        parts.append(f"{name}{k + 1} AS (SELECT {key}pos // 16 AS pos, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h, (n + 15) // 16 AS n FROM {name}{k} GROUP BY {key}pos // 16, n)")
    return ",\n".join(parts)


def _oracle(deep: int = 6, wide: int = 4) -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    body = lambda text: "sha256(" + " || ".join([*(field(c) for c in FIELDS[:-1]), field(text)]) + ")"
    joins, proof = [], []
    for k in range(deep):
        joins.append(f"JOIN a{k}s ON a{k}s.ix = d.ix AND a{k}s.pos = d.pos // {16**k}")
        proof.append(f"a{k}s.l || a{k}s.r")
    for k in range(wide):
        joins.append(f"JOIN b{k}s ON b{k}s.pos = d.ix // {16**k}")
        proof.append(f"b{k}s.l || b{k}s.r")
    folds = []
    for k, t in [*((k, "a") for k in range(deep)), *((k, "b") for k in range(wide))]:
        folds.append(f"CASE WHEN {t}n{k} > 1 THEN sha256({t}l{k} || f || {t}r{k}) ELSE f END AS f")
    parts, at = [], "j"
    for k, text in enumerate(folds):
        parts.append(f"j{k} AS (SELECT * EXCLUDE (f), {text} FROM {at})")
        at = f"j{k}"
    wanted = [f"{t}{k}s.{c} AS {t}{c}{k}" for t, m in (("a", deep), ("b", wide)) for k in range(m) for c in ("l", "r", "n")]
    return f"""
WITH c AS (
  SELECT *, CASE WHEN doc_id IS NULL THEN NULL ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(doc_id::VARCHAR) + 1),
    lambda i: list_prepend(ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
    lambda s, e: CASE WHEN e >= 0 THEN xor(s, e) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295) % 5 = 0 END AS bad FROM documents),
h AS (SELECT doc_id, source, {body('text')} AS h, CASE WHEN bad THEN {body(f"translate(text, '{UPPER}', '{LOWER}')")} END AS fake FROM c),
d AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS ix,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM h),
a0 AS (SELECT ix, pos, h, n FROM d),
{_levels('a', deep, 'ix, ')},
b0 AS (SELECT ix AS pos, h, count(*) OVER () AS n FROM a{deep}),
{_levels('b', wide, '')},
j AS (SELECT d.doc_id, d.ix, d.pos, d.h, coalesce(fake, d.h) AS f, b0s.h AS subroot, sha256({' || '.join(proof)}) AS proof_sha256, {', '.join(wanted)} FROM d {' '.join(joins)}),
{', '.join(parts)}
SELECT doc_id, ix::BIGINT AS source_ix, {at}.pos::BIGINT AS position, {at}.h AS leaf, subroot, b{wide}.h AS root, proof_sha256, f AS folded_root, f = b{wide}.h AS verified FROM {at}, b{wide}
"""


#: The same in DuckDB, for up to 16**6 leaves a source and 16**4 sources.
ORACLE = _oracle()
