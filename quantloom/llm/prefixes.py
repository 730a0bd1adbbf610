"""The prefix trie of conversations, by ROLLUP over columns of turn ids.

A conversation's turns stand in TURNS positional columns of turn ids, and one GROUP BY ROLLUP over them
aggregates all prefixes together; grouping_id says how deep a group is. Longer conversations go on in
further blocks of columns, keyed by the node at which the block before ended (its smallest member). A second
ROLLUP, over the nodes, from the last block to the first, sums up subtrees. Equal conversations are one row with
a count. Where a single row is left on a path, the rest of it is a chain that needs no more rounds, so
there are as many rounds as the longest prefix that different conversations share has blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import WORD, Tables, placed, running_totals

#: Turn columns of a block.
TURNS = 8
#: Conversations of one family share their first turns: those of ids with the same whole number of FAMILY, up to SHARED turns less one.
FAMILY, SHARED = 20, 4
#: Conversation ids in one piece of text when they are hashed.
PIECE = 1024
_COLUMNS = [f"t{i + 1}" for i in range(TURNS)]
_NOTHING = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """A turn as 20 bytes: 16 of its digest, 4 of the number of its words."""
    body = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.concat(F.substring(F.sha2(body, 256), 1, 32), F.lpad(F.hex(F.regexp_count(text, F.lit(WORD))), 8, "0")))


def words_of(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, 17, 4)), 16, 10).cast("long")


def rebuilt(conversations: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (conv_id, pos, id) a turn, and (conv_id, length) a conversation, those without turns too."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_id(text("role"), text("text")).alias("id")).where("conv_id is not null")
    at = tables.stored(placed(tables.stored(rows, "turns"), ["conv_id"], ["turn", "id"], "pos", tables), "turns")
    first = F.when(F.col("pos") < SHARED - 1, F.struct("pos", "id"))
    convs = tables.stored(at.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(first)).alias("head")), "conversations")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED)).cast("int")
    bases = convs.select(F.col("conv_id").alias("_base"), F.transform("head", lambda x: x.id).alias("_head"))
    own = convs.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")).join(bases, F.col("base") == F.col("_base"), "left")
    shape = own.select("conv_id", "h", F.slice(F.coalesce("_head", F.array().cast("array<binary>")), F.lit(1), F.col("h")).alias("first"), (F.col("n") - F.col("h")).alias("rest"))
    shape = tables.stored(shape.withColumn("length", F.size("first") + F.greatest(F.col("rest"), F.lit(0))), "shapes")
    kept = at.join(shape.select(F.col("conv_id").alias("_conv"), "h", F.size("first").alias("k")), F.col("conv_id") == F.col("_conv")).where("pos >= h")
    turns = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "id").unionByName(shape.select("conv_id", F.posexplode("first").alias("pos", "id")))
    return tables.stored(turns, "rebuilt"), shape.select("conv_id", F.col("length").cast("long").alias("length"))


def classes(turns: DataFrame, convs: DataFrame, tables: Tables) -> DataFrame:
    """conv_id, length, rep (the smallest conv_id with the same turns), n (how many have them) of every conversation."""
    mark = lambda k: F.bit_xor(F.xxhash64("pos", "id", F.lit(k)))
    marks = turns.groupBy(F.col("conv_id").alias("_conv")).agg(mark(1).alias("a"), mark(2).alias("b"))
    zero = F.lit(0).cast("long")
    known = tables.stored(convs.join(marks, F.col("conv_id") == F.col("_conv"), "left").select("conv_id", "length", F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b")), "marks")
    each = known.groupBy(F.col("length").alias("_length"), F.col("a").alias("_a"), F.col("b").alias("_b")).agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"))
    same = (F.col("length") == F.col("_length")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))
    return tables.stored(known.join(each, same).select("conv_id", "length", "rep", "n"), "classes")


def listed(members: DataFrame, tables: Tables) -> DataFrame:
    """rep, sha: the digest of each class's conv_ids, ascending and joined by commas.

    Ids of a large class are put together in pieces, wherever they are; only the hash itself, which is
    sequential, reads one class's pieces in one task, as a stream.
    """
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    few = members.where(F.col("n") <= PIECE).groupBy("rep").agg(F.sha2(text, 256).alias("sha"))
    many = tables.stored(members.where(F.col("n") > PIECE).select("rep", "conv_id"), "large")
    pieces = placed(many, ["rep"], ["conv_id"], "at", tables).groupBy("rep", F.floor(F.col("at") / PIECE).alias("piece")).agg(text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h = None, None
        for batch in batches:
            out: list[tuple[int, str]] = []
            for rep, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rep != at:
                    if h is not None:
                        out.append((at, h.hexdigest()))
                    at, h = rep, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([x for _, x in out], pa.string())], ["rep", "sha"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([h.hexdigest()])], ["rep", "sha"])

    return few.unionByName(pieces.repartition("rep").sortWithinPartitions("rep", "piece").select("rep", "text").mapInArrow(run, "rep long, sha string"))


def _path(level: Column) -> Column:
    return F.slice(F.array(*_COLUMNS), F.lit(1), level)


def _parent(path: Column) -> Column:
    return F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))


def rolled(rows: DataFrame) -> DataFrame:
    """start, the turn columns, more, level (how many of these columns a group has), n_convs, conv_id, n_classes of every group of the block's ROLLUP."""
    columns = ", ".join([*_COLUMNS, "more"])
    text = f"SELECT start, {columns}, {TURNS + 1} - bit_count(grouping_id()) AS level, sum(n) AS n_convs, min(rep) AS conv_id, count(*) AS n_classes FROM {{rows}} GROUP BY start, ROLLUP({columns})"
    return rows.sparkSession.sql(text, rows=rows)


def nodes(groups: DataFrame) -> DataFrame:
    """start, path, n_convs, conv_id, ends (the class that ends here, by its conv_id), n_children of the block's nodes.

    A group whose last column is null holds the one class that ends a turn earlier. The node that the block starts
    from has an empty path; but for the root it brings its children only.
    """
    last = F.get(F.array(*_COLUMNS, F.when(F.col("more"), F.lit(b"\1"))), F.col("level") - 1)
    before = F.get(F.array(*_COLUMNS), F.col("level") - 2)
    none = F.lit(None).cast("long")
    at = lambda path, *values: F.struct(path.alias("path"), *[v.alias(c) for c, v in zip(("n_convs", "conv_id", "ends", "child"), values, strict=True)])
    path = _path(F.least("level", F.lit(TURNS)))
    own = F.when((F.col("level") == 0) | ((F.col("level") <= TURNS) & last.isNotNull()), at(path, F.col("n_convs"), F.col("conv_id"), none, none))
    child = F.when(F.col("level").between(1, TURNS) & last.isNotNull(), at(_parent(path), none, none, none, F.lit(1).cast("long")))
    end = F.when((F.col("level") >= 1) & last.isNull() & ((F.col("level") == 1) | before.isNotNull()), at(_path(F.greatest(F.col("level") - 1, F.lit(0))), none, none, F.col("conv_id"), none))
    told = groups.select("start", F.explode(F.array_compact(F.array(own, child, end))).alias("x")).select("start", "x.*")
    return told.groupBy("start", "path").agg(F.max("n_convs").alias("n_convs"), F.max("conv_id").alias("conv_id"), F.max("ends").alias("ends"), F.coalesce(F.sum("child"), F.lit(0)).alias("n_children"))


def summed(at: DataFrame, carry: DataFrame | None) -> DataFrame:
    """start, path, n_leaves, saved of every node's subtree, in the block and in what carry (start, n_leaves, saved, n_children) brings from the next."""
    if carry is not None:
        below = carry.select(F.col("start").alias("_start"), F.col("n_leaves").alias("_leaves"), F.col("saved").alias("_saved"), F.col("n_children").alias("_children"))
        at = at.join(below, (F.size("path") == TURNS) & (F.col("conv_id") == F.col("_start")), "left").withColumn("n_children", F.col("n_children") + F.coalesce("_children", F.lit(0)))
    else:
        zero = F.lit(0).cast("long")
        at = at.withColumns({"_leaves": zero, "_saved": zero})
    words = F.when(F.size("path") > 0, words_of(F.element_at("path", -1))).otherwise(0)
    own = at.select("start", *[F.get("path", F.lit(i)).alias(c) for i, c in enumerate(_COLUMNS)], (F.when(F.col("n_children") == 0, 1).otherwise(0) + F.coalesce("_leaves", F.lit(0))).alias("leaves"), ((F.col("n_convs") - 1) * words + F.coalesce("_saved", F.lit(0))).alias("saved"))
    columns = ", ".join(_COLUMNS)
    text = f"SELECT start, {columns}, {TURNS} - bit_count(grouping_id()) AS level, sum(leaves) AS n_leaves, sum(saved) AS saved FROM {{own}} GROUP BY start, ROLLUP({columns})"
    sums = own.sparkSession.sql(text, own=own)
    return sums.where((F.col("level") == 0) | F.get(F.array(*_COLUMNS), F.col("level") - 1).isNotNull()).select("start", _path(F.col("level")).alias("path"), "n_leaves", "saved")


def chains(turns: DataFrame, starts: DataFrame) -> DataFrame:
    """The nodes of paths that one class follows alone: from (a depth) on, those of starts (rep, from).

    turns: rep, n, length, pos, id.
    """
    rows = turns.join(starts.select(F.col("rep").alias("_rep"), "from"), F.col("rep") == F.col("_rep")).where(F.col("pos") >= F.col("from")).withColumn("words", words_of(F.col("id")))
    after = running_totals(rows.select("rep", "n", "length", "pos", "from", "words"), "words", "after", [-F.col("pos")], ["rep"], F.floor((F.col("length") - 1 - F.col("pos")) / 4096).cast("int"))
    last = F.col("pos") + 1 == F.col("length")
    return after.select(F.col("rep").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.col("rep").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * (F.col("after") + F.col("words"))).alias("saved_tokens"), F.when(last, F.col("rep")).alias("ends"), "from")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the rebuilt conversations' trie.

    A conversation begins with the first h turns of its family's first conversation (its id less its remainder by
    FAMILY; h: crc32 of the id modulo SHARED) and goes on with its own after the first h. Turns go by turn (null
    first), those of one turn by the digest of role and text; null role and text are empty; repeated rows are turns
    of their own. Rows without conv_id belong to no conversation and are left out. A node is named by its smallest
    member and depth; the root has depth 0 and no parent. Without conversations there is no node.
    """
    tables = Tables()
    turns, convs = rebuilt(conversations, tables)
    members = classes(turns, convs, tables)
    reps = members.where("conv_id = rep")
    rows = tables.stored(turns.join(reps.select("rep", "n", "length"), F.col("conv_id") == F.col("rep")).select("rep", "n", "length", "pos", "id"), "distinct")
    wide = rows.groupBy("rep", "n", "length", F.floor(F.col("pos") / TURNS).alias("block")).agg(*[F.max(F.when(F.col("pos") % TURNS == i, F.col("id"))).alias(c) for i, c in enumerate(_COLUMNS)])
    empty = reps.where("length = 0").select("rep", "n", "length", F.lit(0).cast("long").alias("block"), *[F.lit(None).cast("binary").alias(c) for c in _COLUMNS])
    blocks = tables.stored(wide.unionByName(empty).withColumn("more", F.when(F.col("length") > (F.col("block") + 1) * TURNS, True)), "blocks")

    made: list[DataFrame] = []  # the nodes of each block
    alone: DataFrame | None = None
    at = blocks.where("block = 0").withColumn("start", F.lit(0).cast("long"))
    while True:
        k = len(made)
        groups = tables.stored(rolled(at), "rolled")
        made.append(tables.stored(nodes(groups), "nodes"))
        on = groups.where(F.col("level") == TURNS + 1).where("more")
        single = on.where("n_classes = 1").select(F.col("conv_id").alias("rep"), F.lit((k + 1) * TURNS).cast("long").alias("from"))
        alone = single if alone is None else alone.unionByName(single)
        shared = on.where("n_classes > 1").select(F.col("conv_id").alias("next"), F.col("start").alias("_start"), *[F.col(c).alias(f"_{c}") for c in _COLUMNS])
        same = F.col("start") == F.col("_start")
        for c in _COLUMNS:
            same = same & (F.col(c) == F.col(f"_{c}"))
        starts = tables.stored(at.where("more").join(shared, same).select(F.col("rep").alias("_rep"), "next"), "starts")
        if starts.isEmpty():
            break
        at = tables.stored(blocks.where(F.col("block") == k + 1).join(starts, F.col("rep") == F.col("_rep")).drop("_rep").withColumnRenamed("next", "start"), "block")

    single = tables.stored(chains(rows, alone), "chains")
    first = single.where(F.col("depth") == F.col("from") + 1)
    out = [single.drop("from")]
    carry = None
    for k in range(len(made) - 1, -1, -1):
        chained = first.where(F.col("from") == (k + 1) * TURNS).select(F.col("conv_id").alias("start"), "n_leaves", F.col("saved_tokens").alias("saved"), F.lit(1).cast("long").alias("n_children"))
        carry = chained if carry is None else carry.unionByName(chained)
        own = made[k] if k == 0 else made[k].where(F.size("path") > 0)
        sums = tables.stored(summed(own, carry), "sums")
        below = carry.select(F.col("start").alias("_below"), F.col("n_children").alias("_more"))
        known = own.join(sums.withColumnsRenamed({"start": "_start", "path": "_path"}), (F.col("start") == F.col("_start")) & (F.col("path") == F.col("_path"))).drop("_start", "_path")
        known = known.join(below, (F.size("path") == TURNS) & (F.col("conv_id") == F.col("_below")), "left")
        over = own.select(F.col("start").alias("_start"), F.col("path").alias("_path"), F.col("conv_id").alias("_parent"))
        known = known.join(over, (F.size("path") > 0) & (F.col("start") == F.col("_start")) & (_parent(F.col("path")) == F.col("_path")), "left")
        parent = F.col("_parent") if k == 0 else F.coalesce("_parent", "start")
        out.append(known.select("conv_id", (F.size("path") + k * TURNS).cast("long").alias("depth"), parent.alias("parent_conv_id"), "n_convs", (F.col("n_children") + F.coalesce("_more", F.lit(0))).alias("n_children"), "n_leaves", F.col("saved").alias("saved_tokens"), "ends"))
        if k:
            children = made[k].where(F.size("path") == 0).select(F.col("start").alias("_of"), "n_children")
            carry = tables.stored(sums.where(F.size("path") == 0).join(children, F.col("start") == F.col("_of")).select("start", "n_leaves", "saved", "n_children"), "carried")
    all_ = out[0]
    for part in out[1:]:
        all_ = all_.unionByName(part)
    hashes = tables.stored(listed(members, tables), "ends")
    return all_.join(hashes, F.col("ends") == F.col("rep"), "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(_NOTHING)).alias("ends_sha256"))


#: The same in DuckDB: every prefix of every conversation as a list.
ORACLE = """
WITH raw AS (
  SELECT conv_id, turn, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS id,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(id ORDER BY turn NULLS FIRST, sha256(id)) AS l, list(words ORDER BY turn NULLS FIRST, sha256(id)) AS w FROM raw GROUP BY conv_id),
c AS (
  SELECT *, conv_id - conv_id % 20 AS base, (xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(conv_id::VARCHAR) + 1),
    lambda i: list_prepend(ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
    lambda s, e: CASE WHEN e >= 0 THEN xor(s, e) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295) % 4)::INT AS h FROM own),
r AS (
  SELECT c.conv_id, list_concat(coalesce(b.l[1:c.h], []), c.l[c.h + 1:]) AS l, list_concat(coalesce(b.w[1:c.h], []), c.w[c.h + 1:]) AS w
  FROM c LEFT JOIN own b ON b.conv_id = c.base),
p AS (SELECT conv_id, l[1:d] AS path, d, len(l) = d AS here, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS words FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM r)),
n AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE here), '')) AS ends_sha256 FROM p GROUP BY path, d),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
own_ AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON n.path = kids.path),
up AS (SELECT path[1:k] AS path, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM own_) GROUP BY 1)
SELECT o.conv_id, o.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, o.n_convs::BIGINT AS n_convs, o.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, o.ends_sha256
FROM own_ o JOIN up ON o.path = up.path LEFT JOIN n q ON o.depth > 0 AND q.path = o.path[1:o.depth - 1]
"""
