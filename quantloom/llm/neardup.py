"""Near-duplicates: MinHash signatures, a multi-index Hamming join, and a check on the full sets.

Every distinct shingle set gets SYMBOLS minima, of which BITS bits are kept. Two sets of similarity s
differ in about (1 - s) * SYMBOLS symbols; `distance` allows five standard deviations more than that
at the threshold. The signature is split into so few chunks that by the pigeonhole principle two
signatures within the distance agree, but for at most one symbol, in some chunk; that error is
enumerated by leaving out each symbol of a chunk in turn. So a signature is found under SYMBOLS keys,
and all pairs within the distance meet under one of them.

Copies never make pairs: equal sets are one class. Under a key, every member first meets one leader
only. What these links leave apart is compared in blocks of bounded size, whatever the key's size, by
parity bitmaps (whose Hamming distance never exceeds the sets' difference) and signatures; only what
passes becomes a pair, and each pair is confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.llm.common import Tables
from quantloom.llm.components import components
from quantloom.llm.shingles import mixed, shingle_sets

SYMBOLS = 64
BITS = 16
#: Words of 64 bits in a parity bitmap.
BITMAP = 16
#: Members of a key that are compared with each other in one row of work (two blocks at most).
BLOCK = 1024
_U = np.uint64
_FACTOR = np.random.default_rng(7).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) | _U(1)
_MARK = np.random.default_rng(11).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) | _U(1)


def distance(percent: int) -> int:
    """Greatest signature distance that is searched, in symbols."""
    p = 1 - percent / 100
    return math.floor(SYMBOLS * p + 5 * math.sqrt(SYMBOLS * p * (1 - p)))


def chunks(most: int) -> list[np.ndarray]:
    """Symbols of each chunk; with most // 2 + 1 chunks, one of them has at most one error."""
    return np.array_split(np.arange(SYMBOLS), most // 2 + 1)


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[k : k + 4096, None] * _FACTOR).min(axis=0))
    return (mixed(low) >> _U(64 - BITS)).astype(np.uint16)


def keys(sig: np.ndarray, most: int) -> np.ndarray:
    """The keys of a signature: each chunk without one of its symbols, hashed."""
    marked = mixed(sig.astype(np.uint64) + _MARK)
    out = np.empty(SYMBOLS, np.uint64)
    for chunk in chunks(most):
        out[chunk] = marked[chunk].sum(dtype=np.uint64) - marked[chunk]
    return mixed(out ^ _MARK)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles at each of BITMAP * 64 places."""
    odd = np.bincount((shingles >> _U(20)).astype(np.int64) & (BITMAP * 64 - 1), minlength=BITMAP * 64) & 1
    return np.packbits(odd.astype(bool))


def sketches(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """A row a row of docs: doc_id, h (hash of the text), row (its own number), n_shingles, d1, d2 (digest of the set; null if it is empty), keys, sig, bitmap."""
    most = distance(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                rows = []
                for s in shingle_sets(batch.column(1), width):
                    if len(s):
                        sig = signature(s)
                        d = mixed(s)
                        rows.append((len(s), int(d.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mixed(d + _U(len(s)))).view(np.int64)), keys(sig, most).view(np.int64), sig.tobytes(), bitmap(s).tobytes()))
                    else:
                        rows.append((0, None, None, None, None, None))
                n, d1, d2, key, sig, bits = zip(*rows, strict=True) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(key, pa.list_(pa.int64())), pa.array(sig, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "h", "row", "n_shingles", "d1", "d2", "keys", "sig", "bitmap"])

    text = F.col("text").cast("string")
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    return kept.mapInArrow(run, "doc_id long, h long, row long, n_shingles long, d1 long, d2 long, keys array<long>, sig binary, bitmap binary")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|, of two sorted arrays without repeats."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _texts(pairs: DataFrame, side: str, sources: DataFrame, text: DataFrame, again: bool) -> DataFrame:
    """pairs with text_a or text_b: the text of one row of the class."""

    def joined(at: DataFrame, rows: DataFrame) -> DataFrame:
        same = F.col("_id").eqNullSafe(F.col("source.doc_id")) & (F.col("_h") == F.col("source.h"))
        return at.join(rows, same).drop("source", "again", "_id", "_h").withColumnRenamed("_text", f"text_{side}")

    at = pairs.join(sources.withColumnRenamed("rep", side), side)
    if not again:
        return joined(at, text)
    # repeated rows of an id and a text: one of them, else each pair would meet all
    few = sources.where("again").select("source")
    once = text.join(few, F.col("_id").eqNullSafe(F.col("source.doc_id")) & (F.col("_h") == F.col("source.h")), "left_semi").dropDuplicates(["_id", "_h"])
    return joined(at.where("not again"), text).unionByName(joined(at.where("again"), once))


def confirmed(pairs: DataFrame, docs: DataFrame, sources: DataFrame, again: bool, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked, by the full sets of a text of each.

    sources: rep, source (doc_id and h of a row of the class), again (whether several rows have these); the
    argument again says whether any class has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                a, at_a = np.unique(np.array(batch.column(0)), return_index=True)
                known = dict(zip(a.tolist(), shingle_sets(batch.column(2).take(pa.array(at_a)), width), strict=True))
                yes = [linked(known[x], y, percent) for x, y in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(3), width), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(yes, pa.bool_())), batch.column(1).filter(pa.array(yes, pa.bool_()))], ["a", "b"])

    t = F.col("text").cast("string")
    text = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(t).alias("_h"), t.alias("_text"))
    joined = _texts(_texts(pairs, "b", sources, text, again), "a", sources, text, again)
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def first_shared(differ: np.ndarray, most: int) -> np.ndarray:
    """The first slot whose key two signatures share, given where they differ (pairs x symbols); -1 if there is none."""
    out = np.full(len(differ), -1)
    for chunk in chunks(most)[::-1]:
        d = differ[:, chunk]
        errors = d.sum(axis=1)
        out[errors == 0] = chunk[0]
        one = errors == 1
        out[one] = chunk[d[one].argmax(axis=1)]
    return out


def _near(a: dict, b: dict | None, percent: int, most: int, slot: int) -> np.ndarray:
    """Index pairs (i, j) of two blocks (or of one block, i < j) that may be linked and aren't yet known to be.

    A pair that shares several keys comes under the first of them only.
    """
    x, y = a, b or a
    found = []
    step = max(1, (1 << 21) // max(1, len(y["n"])))
    for k in range(0, len(x["n"]), step):
        rows = slice(k, k + step)
        n = x["n"][rows, None] + y["n"][None, :]
        # |difference| = n - 2 * common and the threshold bound it by (100 - percent) * n / (100 + percent)
        ok = (x["comp"][rows, None] != y["comp"][None, :]) & (np.abs(x["n"][rows, None] - y["n"][None, :]) * (100 + percent) <= (100 - percent) * n)
        if b is None:
            ok &= np.arange(k, k + ok.shape[0])[:, None] < np.arange(len(y["n"]))[None, :]
        i, j = np.nonzero(ok)
        i += k
        for w in range(0, len(i), 1 << 18):
            p, q = i[w : w + (1 << 18)], j[w : w + (1 << 18)]
            apart = np.bitwise_count(x["bits"][p] ^ y["bits"][q]).sum(axis=1, dtype=np.int64)
            some = apart * (100 + percent) <= (100 - percent) * (x["n"][p] + y["n"][q])
            p, q = p[some], q[some]
            differ = x["sig"][p] != y["sig"][q]
            some = (differ.sum(axis=1) <= most) & (first_shared(differ, most) == slot)
            found.append(np.stack((p[some], q[some])))
    return np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)


def candidates(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a key and pass the signature distance and the exact bound.

    members: key, slot and size (of the key), rep, comp, n_shingles, sig, bitmap. A key of any size is dealt out
    in pairs of blocks of about BLOCK members each.
    """
    most = distance(percent)
    fields = [("rep", np.int64), ("comp", np.int64), ("n_shingles", np.int64)]

    def block(rows: pa.StructArray, kept: np.ndarray) -> dict:
        take = rows.take(pa.array(np.flatnonzero(kept)))
        out = {name: np.array(take.field(name)).astype(kind) for name, kind in fields}
        return {"rep": out["rep"], "comp": out["comp"], "n": out["n_shingles"], "sig": np.frombuffer(b"".join(take.field("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS), "bits": np.frombuffer(b"".join(take.field("bitmap").to_pylist()), np.uint64).reshape(-1, BITMAP)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lo, hi, slot, rows = *(batch.column(k)[row].as_py() for k in range(3)), batch.column(3)[row].values
                side = np.array(rows.field("block"))
                a = block(rows, side == lo)
                if lo == hi:
                    i, j = _near(a, None, percent, most, slot)
                    x, y = a["rep"][i], a["rep"][j]
                else:
                    b = block(rows, side == hi)
                    i, j = _near(a, b, percent, most, slot)
                    x, y = a["rep"][i], b["rep"][j]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = (
        members.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "slot", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.struct("rep", "comp", "n_shingles", "sig", "bitmap", "block").alias("row"))
    )
    work = dealt.groupBy("key", "lo", "hi").agg(F.min("slot").alias("slot"), F.collect_list("row").alias("rows")).where(F.size("rows") > 1)
    return work.select("lo", "hi", "slot", "rows").mapInArrow(run, "a long, b long").distinct()


def _same_id(some: DataFrame, classes: DataFrame, tables: Tables) -> DataFrame:
    """Links (a, b) of the classes that rows of one doc_id are in."""
    of = ["d1", "d2", "n_shingles"]
    several = some.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*of)).alias("low"), F.max(F.struct(*of)).alias("high")).where("low != high")
    several = tables.stored(several.select("doc_id"), "several")
    at = some.join(several, "doc_id", "left_semi").select("doc_id", *of).distinct().join(classes.select(*of, "rep"), of).select("doc_id", "rep")
    return at.join(at.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("rep != a").select("a", F.col("rep").alias("b")).distinct()


def judged(docs: DataFrame, percent: int, width: int, tables: Tables) -> DataFrame:
    """near_duplicates() with h, the hash of the text.

    Nodes are classes (equal sets) under numbers of their own, so that it doesn't matter which ids their rows
    have; ids come back at the end.
    """
    of = ["d1", "d2", "n_shingles"]
    info = tables.stored(sketches(docs, percent, width), "sketches")
    some = info.where("n_shingles > 0")
    source = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("source")
    parts = [F.first(c).alias(c) for c in ("keys", "sig", "bitmap")]
    reps = tables.stored(some.groupBy(*of).agg(F.min("doc_id").alias("first_id"), F.min("row").alias("first_row"), F.count("*").alias("n_class"), source, *parts).withColumn("rep", F.monotonically_increasing_id()), "representatives")
    repeated = some.groupBy("doc_id", "h").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    same = F.col("_id").eqNullSafe(F.col("source.doc_id")) & (F.col("_h") == F.col("source.h"))
    sources = tables.stored(reps.select("rep", "source").join(repeated, same, "left").select("rep", "source", F.col("_h").isNotNull().alias("again")), "sources")
    again = not sources.where("again").isEmpty()
    entries = reps.select("rep", "d1", F.posexplode("keys").alias("slot", "key"))
    # the leader: the same for all keys of much the same members, so that a document meets few leaders
    shared = tables.stored(entries.groupBy("key").agg(F.count("*").alias("size"), F.min("slot").alias("slot"), F.min_by("rep", "d1").alias("leader")).where("size > 1"), "keys")
    members = tables.stored(entries.select("rep", "key").join(shared, "key"), "members")
    stars = members.where("rep != leader").select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
    sizes = reps.select("rep", "n_shingles", "bitmap")
    sized = stars.join(sizes.withColumnsRenamed({"rep": "a", "n_shingles": "n_a", "bitmap": "bits_a"}), "a").join(sizes.withColumnsRenamed({"rep": "b", "n_shingles": "n_b", "bitmap": "bits_b"}), "b")
    close = F.abs(F.col("n_a") - F.col("n_b")) * (100 + percent) <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    first = tables.stored(confirmed(_bounded(sized.where(close), percent), docs, sources, again, percent, width), "links")
    label = tables.stored(components(first, tables=tables).select(F.col("node").alias("rep"), F.col("component").alias("comp")), "labels")
    marked = tables.stored(members.select("key", "slot", "size", "rep").join(label, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "marked")
    apart = marked.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("key")
    left = tables.stored(marked.join(tables.stored(apart, "apart"), "key", "left_semi"), "left").join(reps.select("rep", "n_shingles", "sig", "bitmap"), "rep")
    pairs = tables.stored(candidates(left, percent), "pairs").join(first, ["a", "b"], "left_anti")
    links = first.unionByName(tables.stored(confirmed(pairs, docs, sources, again, percent, width), "links"))
    links = links.unionByName(tables.stored(_same_id(some, reps, tables), "links"))
    classes = reps.select(*of, "n_class", "first_id", "first_row", "rep").join(components(links, tables=tables), F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep")).drop("node")
    names = classes.groupBy("component").agg(F.min("first_id").alias("component_id"), F.min("first_row").alias("component_row"))
    named = tables.stored(classes.join(names, "component").select(*of, "n_class", "component_id", "component_row"), "classes")
    tables.drop((info, named))
    out = info.select("doc_id", "h", "row", *of).join(named, of, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    kept = F.when(F.col("doc_id").isNull() & (F.col("n_shingles") > 0), component.isNull() & (F.col("row") == F.col("component_row"))).otherwise(F.col("doc_id").eqNullSafe(component))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), F.coalesce("n_class", F.lit(1)).cast("long").alias("n_class"), "h")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, n_class (rows of the same set) of every row.

    Documents whose shingle sets have a similarity of at least percent / 100 are linked; component_id is
    the smallest doc_id reachable. Null, empty and blank texts have the empty set and are linked with
    nothing. Rows of the same doc_id are the same document, rows without one are a document each; a
    component of these only has a null component_id and one kept row. Other columns are ignored.
    """
    return judged(docs, percent, width, Tables()).drop("h")


def _bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose bitmaps don't rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, BITMAP) for k in (4, 5))
            n = np.array(batch.column(2)) + np.array(batch.column(3))
            ok = pa.array(np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) * (100 + percent) <= (100 - percent) * n)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def deduplicated(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """One document of each component, with all its columns: the one whose id names the component.

    Of repeated rows of one doc_id the first by the hashes of its text and its columns stays. A null doc_id is
    dropped only if its component has an id or another kept row; so all rows without id and words stay.
    """
    tables = Tables()
    of = judged(docs, percent, width, tables).where("doc_id <=> component_id").groupBy("doc_id", "h").agg(F.count("*").alias("n"), F.max("kept").alias("kept"), (F.col("doc_id").isNull() & (F.max("n_shingles") == 0)).alias("all")).where("kept")
    one = of.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("h")).alias("null")).agg(F.min(F.struct("h", "n", "all")).alias("first"))
    kept = tables.stored(one.select(F.col("doc_id").alias("kept"), "first.h", F.when(F.col("first.all"), 1).otherwise(F.col("first.n")).alias("n")), "kept")
    tables.drop((kept,))
    # few rows repeat, as a rule none: their table's size is known to the planner, and only the others' texts are shuffled
    again = tables.stored(kept.where("n > 1").select("kept", F.col("h").alias("kept_h")), "repeated")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    hashed, name = F.xxhash64(F.col("row.text").cast("string")), F.col("row.doc_id").cast("long")
    same = name.eqNullSafe(F.col("kept")) & (hashed == F.col("kept_h"))
    single = rows.join(kept.where("n = 1").select("kept", F.col("h").alias("kept_h")), same, "left_semi")
    order = Window.partitionBy(name, hashed).orderBy(F.xxhash64("row"))
    first = rows.join(again, same, "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1")
    return single.select("row.*").unionByName(first.select("row.*"))
