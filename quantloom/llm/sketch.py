"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs.

A text's distinct paragraphs (pieces between line breaks and sentence ends) are 64-bit digests. Each falls
into one cell of each of three tables; a cell holds a count, the xor of its digests and the xor of their
checks. Two texts' sketches are subtracted cell by cell, so that what they share cancels, and peeling takes
out the digests that stand alone in a cell, until the difference is recovered or nothing is pure. Texts
whose difference doesn't peel from the fingerprints get larger sketches, again one a text, which are
subtracted and peeled alike. All of it is DataFrame operations; the fingerprints are subtracted and peeled
within a row, and the larger sketches of one comparison stay in one partition, so rounds need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.llm.common import TIES, Tables, order_buckets

TABLES = 3
#: Cells of a table in a fingerprint.
CELLS = 8
#: Sketches are doubled at most so often; no two distinct digests share all their cells in so large ones.
TRIES = 24
#: Cells of larger sketches that a task holds, so that they fit its memory; beyond MOST_PARTS tasks they spill.
PART_CELLS = 1 << 20
MOST_PARTS = 1 << 15
_PIECES = r"\n|(?<=[.!?]) "


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs; empty pieces are left out."""
    return F.array_distinct(F.transform(F.filter(F.split(text, _PIECES), lambda x: x != ""), lambda x: F.xxhash64(x)))


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(104729))


def cell(digest: Column, table: int, cells: Column) -> Column:
    """Number of a digest's cell among those of all tables."""
    return F.lit(table) * cells + F.pmod(F.xxhash64(digest, F.lit(table)), cells)


def _cell(n: Column, d: Column, c: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), d.alias("d"), c.alias("c"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sketch(set_: Column) -> Column:
    """The fingerprint's cells, of all tables in order: array of (n, d, c)."""
    zero = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))
    marked = F.transform(set_, lambda d: F.struct(d.alias("d"), check(d).alias("c"), *[F.pmod(F.xxhash64(d, F.lit(t)), F.lit(CELLS)).alias(f"k{t}") for t in range(TABLES)]))

    places = F.sequence(F.lit(0).cast("long"), F.lit(CELLS - 1).cast("long"))

    def table(all_: Column, t: int) -> Column:
        own = lambda k: F.filter(all_, lambda x: x[f"k{t}"] == k)
        return F.transform(places, lambda k: F.aggregate(own(k), zero, lambda a, x: _cell(a.n + 1, a.d.bitwiseXOR(x.d), a.c.bitwiseXOR(x.c))))

    return bound(marked, lambda all_: F.concat(*[table(all_, t) for t in range(TABLES)]))


def fingerprint(cells: Column, size: Column) -> Column:
    """A sketch as text: the number of digests, then count, digest xor and check xor of each cell."""
    return F.concat_ws(":", F.hex(size), F.array_join(F.transform(cells, lambda x: F.concat_ws(".", F.hex(x.n), F.hex(x.d), F.hex(x.c))), ","))


def packed(cells: Column) -> Column:
    """A sketch as three arrays, to be stored and shuffled: a fingerprint's text takes twice the bytes."""
    return F.struct(*[cells.getField(f).cast(f"array<{kind}>").alias(f) for f, kind in (("n", "int"), ("d", "long"), ("c", "long"))])


def unpacked(arrays: Column) -> Column:
    return F.transform(arrays.d, lambda d, i: _cell(F.get(arrays.n, i), d, F.get(arrays.c, i)))


def subtracted(a: Column, b: Column) -> Column:
    """Cells of one sketch less those of another."""
    return F.zip_with(a, b, lambda x, y: _cell(x.n - y.n, x.d.bitwiseXOR(y.d), x.c.bitwiseXOR(y.c)))


def peeled_cells(cells: Column, rounds: int = 12) -> Column:
    """(found, left) of a subtracted fingerprint: the digests recovered, and whether any cell is left.

    A round takes one table in turn: in it every digest has one cell only, so what is pure there comes out once.
    """
    start = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("found"))

    def step(acc: Column, r: Column) -> Column:
        own = F.slice(acc.cells, (r % TABLES) * CELLS + 1, F.lit(CELLS))
        pure = F.filter(own, lambda x: (F.abs(x.n) == 1) & (check(x.d) == x.c))

        def taken(out: Column) -> Column:
            hits = F.flatten(F.transform(out, lambda p: F.array(*[F.struct(cell(p.d, t, F.lit(CELLS)).cast("int").alias("at"), p.alias("p")) for t in range(TABLES)])))
            less = lambda at: F.transform(acc.cells, lambda x, i: F.aggregate(F.filter(at, lambda h: h["at"] == i), x, lambda s, h: _cell(s.n - h.p.n, s.d.bitwiseXOR(h.p.d), s.c.bitwiseXOR(h.p.c))))
            return F.struct(bound(hits, less).alias("cells"), F.concat(acc.found, F.transform(out, lambda p: p.d)).alias("found"))

        return bound(pure, lambda out: F.when(F.size(out) == 0, acc).otherwise(taken(out)))

    left = lambda acc: F.struct(acc.found.alias("found"), F.exists(acc.cells, lambda x: (x.n != 0) | (x.d != 0) | (x.c != 0)).alias("left"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, left)


def sketches(sets: DataFrame) -> DataFrame:
    """uid, cells, kind, cell, n, d, c: the sketch of each text of a comparison, one row a cell that is not empty.

    sets: uid, cells, and kinds, an array of (kind, set).
    """
    texts = sets.select("uid", "cells", F.explode("kinds").alias("x"))
    rows = texts.select("uid", "cells", F.col("x.kind").alias("kind"), F.explode("x.set").alias("d"))
    rows = rows.select("*", check(F.col("d")).alias("c"), F.explode(F.array(*[cell(F.col("d"), t, F.col("cells")) for t in range(TABLES)])).alias("cell"))
    return rows.groupBy("uid", "cells", "kind", "cell").agg(F.count("*").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("c").alias("c"))


def peeled(cells: DataFrame, rounds: int, keep: bool) -> DataFrame:
    """uid, pair, found, left of every comparison; found: the digests recovered if they are to be kept, else how many.

    cells: uid, pair, cells, cell, n, d, c of subtracted sketches. What has been recovered stands in rows of
    negative cells.
    """
    by = ["uid", "pair", "cells", "cell", *(["item"] if keep else [])]
    item = F.lit(0).cast("long").alias("item")
    at = cells.select("uid", "pair", "cells", "cell", *([item] if keep else []), "n", "d", "c")
    for r in range(rounds):
        t = r % TABLES
        pure = (F.floor(F.col("cell") / F.col("cells")) == t) & (F.abs("n") == 1) & (check(F.col("d")) == F.col("c"))

        def row(cell_: Column, n: Column, d: Column, c: Column, mark: Column) -> Column:
            return F.struct(cell_.cast("long").alias("cell"), n.cast("long").alias("n"), d.alias("d"), c.alias("c"), *([mark.alias("item")] if keep else []))

        zero = F.lit(0).cast("long")
        mine = row(F.col("cell"), F.col("n"), F.col("d"), F.col("c"), F.col("item") if keep else zero)
        one = row(F.lit(-1), F.lit(1), zero, zero, F.col("d"))
        out = [row(cell(F.col("d"), k, F.col("cells")), -F.col("n"), F.col("d"), F.col("c"), zero) for k in range(TABLES) if k != t]
        moved = at.select("uid", "pair", "cells", F.explode(F.when(pure & (F.col("cell") >= 0), F.array(one, *out)).otherwise(F.array(mine))).alias("x")).select("uid", "pair", "cells", "x.*")
        at = moved.groupBy(*by).agg(F.sum("n").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("c").alias("c")).where("n != 0 or d != 0 or c != 0")
    got = F.col("cell") < 0
    found = F.collect_list(F.when(got, F.col("item"))) if keep else F.coalesce(F.sum(F.when(got, F.col("n"))), F.lit(0))
    return at.groupBy("uid", "pair").agg(found.alias("found"), F.count_if(~got).alias("left"))


def differences(sets: DataFrame, tables: Tables | None = None, keep: bool = True, rounds: int = 12) -> DataFrame:
    """uid, pair, found: the digests in which set a and the set others[pair] differ (keep=False: how many), by larger sketches.

    sets: uid, a (array<long>), others (array<array<long>>), todo (array<int>, the pairs wanted; all without that
    column), read from a stored table. Sketches have as many cells as the largest pair of sets asks for, doubled until it peels.
    A comparison in which everything cancels has no row.
    """
    tables = tables or Tables()
    if "todo" not in sets.columns:
        sets = sets.withColumn("todo", F.transform("others", lambda _, i: i))
    out, cells = None, F.pow(F.lit(2.0), F.ceil(F.log2((F.size("a") + F.array_max(F.transform("todo", lambda p: F.size(F.get("others", p))))) * 0.6 + 8))).cast("long")
    rows = sets.withColumn("cells", cells)
    for attempt in range(TRIES):
        most = rows.agg(F.sum(F.col("cells") * (1 << attempt) * TABLES * (F.size("todo") + 1)).alias("n")).first().n
        parts = max(1, min(MOST_PARTS, -(-(most or 0) // PART_CELLS)))
        own = F.array(F.struct(F.lit(-1).alias("kind"), F.col("a").alias("set")))
        kinds = F.concat(own, F.transform("todo", lambda p: F.struct(p.cast("int").alias("kind"), F.get("others", p).alias("set"))))
        made = sketches(rows.repartition(parts, "uid").select("uid", F.struct((F.col("cells") * (1 << attempt)).alias("cells"), "todo").alias("cells"), kinds.alias("kinds")).select("uid", F.col("cells.cells").alias("cells"), "kinds"))
        # kind -1 is set a: it is subtracted from nothing, but once for each pair
        pairs = rows.repartition(parts, "uid").select(F.col("uid").alias("_uid"), "todo")
        signed = made.join(pairs.hint("merge"), F.col("uid") == F.col("_uid")).select("uid", "cells", "cell", "n", "d", "c", "kind", F.explode(F.when(F.col("kind") < 0, F.col("todo")).otherwise(F.array("kind"))).alias("pair"))
        less = signed.groupBy("uid", "pair", "cells", "cell").agg(F.sum(F.when(F.col("kind") < 0, F.col("n")).otherwise(-F.col("n"))).alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("c").alias("c")).where("n != 0 or d != 0 or c != 0")
        got = tables.stored(peeled(less, rounds, keep), "peeled")
        done = got.where("left = 0").select("uid", "pair", "found")
        out = done if out is None else out.unionByName(done)
        failed = tables.stored(got.where("left > 0").groupBy("uid").agg(F.collect_set("pair").alias("todo")), "failed")
        if failed.isEmpty():
            return out
        rows = rows.drop("todo").join(failed.hint("merge"), "uid")
    raise RuntimeError("some sketches don't peel")


def with_next(docs: DataFrame, tables: Tables) -> DataFrame:
    """uid, doc_id, text, own (digests), cells (sketch), and next_text, next, next_cells of every row.

    The next is that of the next smaller doc_id, after the last the first. Rows go by descending doc_id (null
    last) and the texts' hashes. Ranges of ids are dealt to tasks, and each range also gets the first row of
    the next range, so no task sees more than its range. A text's digests and sketch are made once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashed = F.xxhash64("text")
    rows = rows.withColumn("hash", hashed).withColumn("bucket", order_buckets(rows, "doc_id", hashed))
    first = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "hash"))
    heads = rows.groupBy("bucket").agg(first.alias("head"))
    order = Window.orderBy(F.desc("bucket"))  # a row a range
    ring = tables.stored(heads.withColumn("before", F.coalesce(F.lag("bucket").over(order), F.last("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))), "ranges")
    wanted = ring.select(F.col("bucket").alias("_b"), "head.doc_id", "head.hash", "before").withColumnsRenamed({"doc_id": "_id", "hash": "_h"})
    extra = rows.join(wanted, (F.col("bucket") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_h")))
    extra = extra.dropDuplicates(["_b"]).select("doc_id", "text", "hash", F.col("before").alias("bucket"), F.lit(1).alias("extra"))
    both = rows.withColumn("extra", F.lit(0)).unionByName(extra).repartition("bucket")
    # made after the texts are dealt, and before the next row's are looked at
    both = both.withColumn("own", digests(F.col("text"))).withColumn("cells", sketch(F.col("own")))
    inside = Window.partitionBy("bucket").orderBy("extra", F.desc_nulls_last("doc_id"), F.desc("hash"))
    nexts = {f"next{n}": F.lead(c).over(inside) for n, c in (("_text", "text"), ("", "own"), ("_cells", "cells"))}
    placed = both.withColumns(nexts | {"place": F.row_number().over(inside)}).where("extra = 0")
    return placed.withColumn("uid", (F.col("bucket") + F.lit(1 << TIES)) * F.lit(1 << 26) + F.col("place")).drop("bucket", "place", "extra", "hash")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs of every row.

    The edited text has its last floor(n / 2) characters replaced by the first as many of the next
    document. near_*: shared over all distinct paragraphs, from the peeled difference of the two
    sketches; 1.0 if both texts are without paragraphs. Null text counts as empty; repeated rows and
    equal ids stay rows of their own; other columns are ignored.
    """
    tables = Tables()
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    texts = with_next(docs, tables).withColumn("edited", edited)
    texts = texts.withColumn("new", digests(F.col("edited"))).withColumn("new_cells", sketch(F.col("new")))
    for name in ("new", "next"):
        texts = texts.withColumn(f"{name}_diff", peeled_cells(subtracted(F.col("cells"), F.col(f"{name}_cells"))))
    todo = F.array_compact(F.array(*[F.when(F.col(f"{name}_diff.left"), F.lit(k)) for k, name in enumerate(("new", "next"))]))
    kept = lambda c: F.when(F.size(todo) > 0, F.col(c))
    made = tables.stored(
        texts.select(
            "uid", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("cells")).alias("packed"), packed(F.col("new_cells")).alias("new_packed"),
            F.size("own").alias("n_own"), F.size("new").alias("n_new"), F.size("next").alias("n_next"), *[F.when(~F.col(f"{name}_diff.left"), F.size(f"{name}_diff.found")).alias(f"d_{name}") for name in ("new", "next")],
            todo.alias("todo"), kept("own").alias("a"), F.when(F.size(todo) > 0, F.array("new", "next")).alias("others"),
        ), "fingerprints",
    )
    found = differences(made.where("size(todo) > 0").select("uid", "a", "others", "todo"), tables, keep=False)
    by_uid = found.groupBy("uid").agg(*[F.sum(F.when(F.col("pair") == k, F.col("found"))).alias(f"late_{name}") for k, name in enumerate(("new", "next"))])

    def near(other: str) -> Column:
        total, apart = F.col("n_own") + F.col(f"n_{other}"), F.coalesce(F.col(f"d_{other}"), F.col(f"late_{other}"), F.lit(0))
        return F.when(total == 0, F.lit(1.0)).otherwise((total - apart) / (total + apart))

    joined = made.join(by_uid, "uid", "left")
    return joined.select("doc_id", "n_chars", "edited_sha256", fingerprint(unpacked(F.col("packed")), F.col("n_own")).alias("fingerprint"), fingerprint(unpacked(F.col("new_packed")), F.col("n_new")).alias("edited_fingerprint"), near("new").alias("near_edited"), near("next").alias("near_next"), F.col("n_own").cast("long").alias("n_paragraphs"))
