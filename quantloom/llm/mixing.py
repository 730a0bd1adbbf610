"""Mixing sources to target weights: fixed-length blocks, multinomial draws a shard, index permutations.

A source's words, its documents end to end, are cut into blocks of `block` words. The output is a number of
slots, one block each, in shards. For each shard, how many slots it gets of every source is a multinomial draw by the
sources' targets; what a source drew beyond its target is given up, and a closing shard brings each source to its
target. A source's slots are whole passes over its blocks and a partial pass. In a whole pass a keyed pseudorandom
permutation of the block indexes maps slots to blocks. The partial pass takes its slots without replacement from
parts of the index: how many each part gives is drawn, and a permutation says which. Blocks are joined by index.
So the target decides how many blocks of a source are taken, seed and the parts' draws which, and the shards'
draws where.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.llm.common import WORD, Tables, running_totals, unit

BLOCK = 64
SHARDS = 1024
#: Fewest slots a shard; with few slots there are fewer shards.
SHARD_SLOTS = 4096
#: Modulus of the permutations' rounds; the halves of an index stay below it, so there may be 2**61 blocks.
PRIME = 2147483647
#: Half-rounds of a permutation, and how often an index that is out of range goes through them at most.
ROUNDS, WALKS = 6, 64
#: Cells of the line of all slots by which a draw finds its source: this many, or more if there are many sources.
CELLS = 1024


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text; null text: 0)."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """ix, source, source_size, target: what each source gives, by weight, of share * all words.

    No source gives more than most * its size; the excess goes to the others by weight, until none is
    above. So target = least(limit, level * weight), with one level for all: sources in order of
    limit / weight reach their limit first. One task sees a row a source, made of partial sums.
    """
    of = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = of.withColumn("ix", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("int") - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = by_name.withColumn("weight", F.element_at(cycle, (F.col("ix") % len(weights)) + 1)).withColumn("limit", F.col("source_size") * most)
    full = Window.orderBy(F.col("limit") / F.col("weight"), "ix")
    before, onward = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    whole = full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    leveled = w.withColumn("level", level).withColumn("level", F.first(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level")), True).over(whole))
    return leveled.select("ix", "source", "source_size", F.coalesce(F.least("limit", F.col("level") * F.col("weight")), F.col("limit")).alias("target"))


def _key(ix: Column, turn: int, seed: int) -> Column:
    return (ix * 7919 + turn * 104729 + seed * 15485863) % PRIME


def _round(x: Column, key: Column) -> Column:
    """A pseudorandom number below PRIME of x and a key: two squarings modulo PRIME."""
    y = (x + key) % PRIME
    y = (y * y + key) % PRIME
    return (y * y) % PRIME


def permuted(rows: DataFrame, i: str, n: str, ix: str, out: str, seed: int) -> DataFrame:
    """rows with out: i of 0..n-1 under a keyed pseudorandom permutation of source ix.

    Feistel rounds on the two halves of i in a grid of a * b cells, a and b about the root of n; a cell beyond n, of
    which there are fewer than a, is put through the rounds again until it is not.
    """
    at = rows.withColumn("_b", F.ceil(F.sqrt(F.col(n).cast("double"))).cast("long")).withColumn("_a", F.ceil(F.col(n) / F.col("_b")).cast("long")).withColumn("_k", F.col(ix).cast("long"))
    at = at.withColumns({"_l": F.floor(F.col(i) / F.col("_b")).cast("long"), "_r": (F.col(i) % F.col("_b")).cast("long")})
    for turn in range(ROUNDS):
        half, other, size = ("_l", "_r", "_a") if turn % 2 == 0 else ("_r", "_l", "_b")
        at = at.withColumn(half, (F.col(half) + _round(F.col(other), _key(F.col("_k"), turn, seed))) % F.col(size))
    cell = F.col("_l") * F.col("_b") + F.col("_r")

    def half_round(pair: Column, turn: int) -> Column:
        own, other, size = ("l", "r", "_a") if turn % 2 == 0 else ("r", "l", "_b")
        new = (pair[own] + _round(pair[other], _key(F.col("_k"), turn, seed))) % F.col(size)
        return F.struct(*[(new if h == own else pair[h]).alias(h) for h in ("l", "r")])

    def nth(turn: int) -> Callable[[Column], Column]:
        return lambda p: half_round(p, turn)

    rounds = [nth(turn) for turn in range(ROUNDS)]

    def bound(value: Column, use: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def again(x: Column) -> Column:
        pair = F.struct(F.floor(x / F.col("_b")).cast("long").alias("l"), (x % F.col("_b")).cast("long").alias("r"))
        for turn in range(ROUNDS):
            pair = bound(pair, rounds[turn])
        return bound(pair, lambda p: p["l"] * F.col("_b") + p["r"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), cell, lambda x, _: F.when(x < F.col(n), x).otherwise(again(x)))
    value = F.when(cell < F.col(n), cell).otherwise(walked)
    done = at.withColumn(out, value).withColumn(out, F.when(F.col(out) < F.col(n), F.col(out)).otherwise(F.raise_error(F.lit("a permutation did not come back into range")).cast("long")))
    return done.drop("_a", "_b", "_k", "_l", "_r")


def _numbered(rows: DataFrame, first: str, count: str, out: str) -> DataFrame:
    """rows with out: first, first + 1, .., count numbers each; in two steps, so that no array grows with the data, and dealt out between them."""
    step = 1 << 14
    parts = rows.where(F.col(count) > 0).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(step).cast("long")))).repartition("ix", first, "_from")
    return parts.withColumn(out, F.explode(F.sequence(F.col(first) + F.col("_from"), F.col(first) + F.least(F.col("_from") + step, F.col(count)) - 1))).drop("_from")


def _shards(total: int) -> int:
    return max(1, min(SHARDS, total // SHARD_SLOTS))


def source_draws(sources: DataFrame, seed: int) -> DataFrame:
    """shard, ix, n: how many of a shard's places drew source ix, of those that any drew.

    sources: ix, slots, read from a stored table. There are as many places as slots, in shards of equal size. Each place draws a
    source by its share of all slots, with replacement, so a shard's counts are a multinomial draw. The place draws a point on the
    line of all slots, source after source; points and sources meet in cells of the line. One task sees a row a source.
    """
    known = sources.agg(F.sum("slots").alias("n"), F.count("*").alias("sources")).first()
    total = known.n or 0
    shards, width = _shards(total), max(1, total // max(CELLS, 8 * known.sources))
    line = sources.where("slots > 0").withColumn("_upto", F.sum("slots").over(Window.orderBy("ix"))).withColumn("_low", F.col("_upto") - F.col("slots"))
    cells = line.select("ix", "_low", "_upto", F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor((F.col("_upto") - 1) / width))).alias("_cell"))
    places = sources.sparkSession.range(total).select(F.floor(F.col("id") * shards / max(total, 1)).cast("int").alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(total, 1))).alias("_point"))
    drawn = places.join(cells, (F.floor(F.col("_point") / width) == F.col("_cell")) & (F.col("_point") >= F.col("_low")) & (F.col("_point") < F.col("_upto")))
    return drawn.groupBy("shard", "ix").agg(F.count("*").alias("n"))


def shard_spans(sources: DataFrame, seed: int) -> DataFrame:
    """shard, ix, blocks, passes (whole ones), start, end: the source's slots that the shard gets, from start to end - 1.

    sources: ix, blocks, slots, read from a stored table. Shards take a source's slots one after the other, each as many as it drew.
    Slots beyond the source's last are given up; those that no shard drew go to a closing shard, number SHARDS, so that each source has all
    its slots.
    """
    drawn = source_draws(sources, seed)
    closing = sources.select(F.lit(SHARDS).alias("shard"), "ix", F.col("slots").alias("n"))
    before = Window.partitionBy("ix").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spans = drawn.unionByName(closing).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).join(sources.select(F.col("ix").alias("_ix"), "blocks", "slots"), F.col("ix") == F.col("_ix"))
    cut = spans.select("shard", "ix", "blocks", F.floor(F.col("slots") / F.col("blocks")).alias("passes"), "start", F.least(F.col("start") + F.col("n"), "slots").alias("end"))
    return cut.where("start < end")


def shard_draws(sources: DataFrame, seed: int) -> DataFrame:
    """ix, blocks, shard (a part of the source's index), first (the first block index of the part), own (how many it has), n (how many it gives to the partial pass).

    sources: ix, blocks, slots, read from a stored table. A source's block indexes are in equal parts, as many as shards. The
    partial pass is drawn without replacement from all indexes, so the parts' counts are those of multinomial draws
    under the condition that no index is drawn twice.
    """
    total = sources.agg(F.sum("slots").alias("n")).first().n or 0
    shards = _shards(total)
    part = sources.select("ix", "blocks", (F.col("slots") % F.col("blocks")).alias("rest"))
    drawn = permuted(_numbered(part.where("rest > 0").withColumn("zero", F.lit(0).cast("long")), "zero", "blocks", "i"), "i", "blocks", "ix", "place", seed)
    # counted, not filtered: a filter would be pushed through the rounds' columns and write each of them out
    counts = drawn.groupBy(F.col("ix").alias("_ix"), F.floor(F.col("i") * shards / F.col("blocks")).cast("long").alias("_shard")).agg(F.count_if(F.col("place") < F.col("rest")).alias("n"))
    start = lambda k: F.ceil(k * F.col("blocks") / shards).cast("long")
    owned = part.select("ix", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    owned = owned.select("ix", "blocks", "shard", start(F.col("shard")).alias("first"), (start(F.col("shard") + 1) - start(F.col("shard"))).alias("own"))
    return owned.join(counts, (F.col("ix") == F.col("_ix")) & (F.col("shard") == F.col("_shard")), "left").select("ix", "blocks", "shard", "first", "own", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def partial_blocks(sources: DataFrame, seed: int) -> DataFrame:
    """ix, shard, place (in the partial pass, from 0), block: the blocks of each source's partial pass: each part's first n indexes, through the source's permutation."""
    before = Window.partitionBy("ix").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    draws = shard_draws(sources, seed).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    slots = _numbered(draws, "first", "n", "slot").withColumn("place", F.col("before") + F.col("slot") - F.col("first"))
    return permuted(slots, "slot", "blocks", "ix", "block", seed + 1).select("ix", "shard", "place", "block")


def slots(sources: DataFrame, seed: int, tables: Tables) -> DataFrame:
    """shard, ix, slot (a source's, from 0), block (an index in the source): the mix, a row a block taken.

    sources: ix, blocks, slots, read from a stored table. Tables of slots are merged, never broadcast: small files may hold many.
    """
    sources = sources.where("slots > 0")
    spans = tables.stored(shard_spans(sources, seed), "spans")
    partial = tables.stored(partial_blocks(sources, seed), "partial").select(F.col("ix").alias("_ix"), F.col("place").alias("_place"), "block").hint("merge")
    turned = F.col("passes") * F.col("blocks")
    whole = spans.withColumn("n", F.least("end", turned) - F.col("start"))
    whole = _numbered(whole, "start", "n", "slot").withColumns({"_turn": F.floor(F.col("slot") / F.col("blocks")), "_i": F.col("slot") % F.col("blocks")})
    # a permutation of its own for each pass
    whole = permuted(whole.withColumn("_key", F.col("ix") + (F.col("_turn") + 1) * 1000003), "_i", "blocks", "_key", "block", seed + 2)
    rest = spans.withColumn("from", F.greatest("start", turned)).withColumn("n", F.col("end") - F.col("from"))
    rest = _numbered(rest, "from", "n", "slot").join(partial, (F.col("ix") == F.col("_ix")) & (F.col("slot") - turned == F.col("_place")))
    out = ["shard", "ix", "slot", "block"]
    # stored: a join's filter would be pushed through the rounds' columns and write each of them out
    return tables.stored(whole.select(out).unionByName(rest.select(out)), "slots")


def _mixed(docs: DataFrame, block: int = BLOCK, seed: int = 5, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """The documents with ix, source_size and target; and their pieces (block, skip, words) with the slots that take them: shard, slot, null if none does."""
    tables = Tables()
    sizes = tables.stored(sized(docs), "sizes")
    n = F.ceil(F.col("source_size") / block)
    # a source's last block may be short, so slots count by the mean of its blocks
    wanted = F.when(n > 0, F.least(F.round(F.col("target") / (F.col("source_size") / n)), F.floor(n * most))).otherwise(0)
    sources = tables.stored(targets(sizes, weights, share, most).withColumn("blocks", n.cast("long")).withColumn("slots", wanted.cast("long")), "sources")
    taken = slots(sources, seed, tables).select(F.col("ix").alias("_ix"), F.col("block").alias("_block"), "shard", "slot").hint("merge")
    known = sizes.join(sources.select("ix", F.col("source").alias("_source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    with_words = known.where("size > 0")
    ordered = running_totals(with_words, "size", "start", [F.col("doc_id"), F.col("size")], ["ix"], F.coalesce(F.pmod(F.col("doc_id"), F.lit(1024)), F.lit(0)).cast("int"))
    last = F.col("start") + F.col("size")
    pieces = ordered.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((last - 1) / block))))
    first = F.greatest("start", F.col("block") * block)
    cut = pieces.withColumns({"skip": first - F.col("start"), "words": F.least(last, (F.col("block") + 1) * block) - first})
    return known, cut.join(taken, (F.col("ix") == F.col("_ix")) & (F.col("block") == F.col("_block")), "left").drop("_ix", "_block")


def mixed_blocks(docs: DataFrame, **options) -> DataFrame:
    """The mix: shard, source, slot, block, doc_id, skip, words, a row a document's piece in a slot: its words after the first `skip` ones.

    A source's slots are numbered from 0; a slot's pieces are those of its block, in the order of the source. Options and order are those of mix().
    """
    return _mixed(docs, **options)[1].where("slot IS NOT NULL").select("shard", "source", "slot", "block", "doc_id", "skip", "words")


def mix(docs: DataFrame, block: int = BLOCK, seed: int = 5, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted) of every document.

    A source's order is that of doc_id modulo a fixed number, then doc_id, then size. Null text has no
    words; a null source is one source, last in order; repeated rows are documents of their own; a null
    doc_id comes first. No row takes more than `most` times its size, since no block is taken more often.
    """
    known, pieces = _mixed(docs, block, seed, weights, share, most)
    taken = F.sum(F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(0)).alias("taken")
    sums = pieces.groupBy("ix", "start", "doc_id", "source", "size", "source_size", "target").agg(taken)
    out = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return sums.select(out).unionByName(known.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(out))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as whole documents, with all columns of docs: each row 0, 1 or 2 times.

    A document comes as often as its words are taken on average, rounded down, or once more: documents that are due a
    part of a copy get a whole one in a pseudorandom order, those due more sooner, until the source has what the mix takes
    of it, so that each source's words are off by one document at most. Documents without words are not taken;
    rows of one doc_id in one source come alike often; a null doc_id or source is one like any other. Columns may have any names.
    """
    tables = Tables()
    mixed = mix(docs.select("doc_id", "source", "text"), **options).groupBy("doc_id", "source").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).where("taken > 0")
    mixed = tables.stored(mixed.withColumn("whole", F.floor(F.col("taken") / F.col("size"))).withColumn("due", F.col("taken") - F.col("whole") * F.col("size")), "mixed")
    # u / part: the smaller, the sooner; brought between 0 and 1 for the buckets
    late = (unit("doc_id", "source", seed=17) + 1e-9) * F.col("size") / F.col("due")
    part = mixed.where("due > 0").withColumn("late", late / (1 + late))
    placed = running_totals(part, "size", "before", [F.col("late"), F.col("doc_id")], ["source"], F.floor(F.col("late") * 1024).cast("int"))
    due = mixed.groupBy(F.col("source").alias("_source")).agg(F.sum("due").alias("_due"))
    extra = placed.join(due, F.col("source").eqNullSafe(F.col("_source"))).where(F.col("before") + F.col("size") / 2 <= F.col("_due")).select(F.col("doc_id").alias("_id"), F.col("source").alias("_of"))
    times = F.col("whole") + F.when(F.col("_found").isNotNull(), 1).otherwise(0)
    more = mixed.join(extra.withColumn("_found", F.lit(1)), F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_of")), "left")
    often = more.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), times.cast("int").alias("times")).where("times > 0")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(often, F.col("row.doc_id").eqNullSafe(F.col("id")) & F.col("row.source").cast("string").eqNullSafe(F.col("of")))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def _permutation_sql(name: str, source: str, i: str, out: str, seed: int, walks: int = 8) -> str:
    """permuted() in DuckDB, with enough walks for some thousand blocks: each CTE is a half-round."""
    key = lambda turn: f"((ix * 7919 + {turn * 104729 + seed * 15485863}) % {PRIME})"
    parts = [f"{name}0 AS (SELECT *, {i} AS x_, ceil(sqrt(blocks::DOUBLE))::BIGINT AS b_, ceil(blocks / ceil(sqrt(blocks::DOUBLE)))::BIGINT AS a_ FROM {source})"]
    k = 0
    for walk in range(walks):
        parts.append(f"{name}{k + 1} AS (SELECT *, x_ // b_ AS l_, x_ % b_ AS r_ FROM {name}{k})")
        k += 1
        for turn in range(ROUNDS):
            half, other, size = ("l_", "r_", "a_") if turn % 2 == 0 else ("r_", "l_", "b_")
            first = f"(({other} + {key(turn)}) % {PRIME})"
            second = f"(({first} * {first} + {key(turn)}) % {PRIME})"
            parts.append(f"{name}{k + 1} AS (SELECT * REPLACE (({half} + ({second} * {second}) % {PRIME}) % {size} AS {half}) FROM {name}{k})")
            k += 1
        value = "l_ * b_ + r_" if walk == 0 else "CASE WHEN x_ < blocks THEN x_ ELSE l_ * b_ + r_ END"
        parts.append(f"{name}{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (l_, r_) REPLACE ({value} AS x_) FROM {name}{k})")
        k += 1
    parts.append(f"{name} AS (SELECT * EXCLUDE (x_, a_, b_), CASE WHEN x_ < blocks THEN x_ ELSE error('out of range') END AS {out} FROM {name}{k})")
    return ",\n".join(parts)


#: The same in DuckDB: targets, draws, permutations and block order are integer arithmetic.
ORACLE = f"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
of AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ix FROM of),
w AS (SELECT *, ([3.0, 1.0, 2.0])[(ix % 3) + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS lim FROM named),
lev AS (SELECT *, lim / weight AS rate,
  (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / weight, ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(weight) OVER (ORDER BY lim / weight, ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
chosen AS (SELECT level FROM lev WHERE level * weight <= lim ORDER BY rate, ix LIMIT 1),
sources AS (
  SELECT ix, source, source_size, coalesce(least(lim, chosen.level * weight), lim) AS target,
         ceil(source_size / {BLOCK}.0)::BIGINT AS blocks
  FROM lev LEFT JOIN chosen ON true),
counted AS (SELECT *, CASE WHEN blocks > 0 THEN least(round(target / (source_size / blocks::DOUBLE)), floor(blocks * 2.0)) ELSE 0 END::BIGINT AS slots FROM sources),
shards AS (SELECT greatest(1, least({SHARDS}, coalesce(sum(slots), 0)::BIGINT // {SHARD_SLOTS}))::BIGINT AS k FROM counted),
drawn AS (SELECT ix, blocks, slots % blocks AS rest, unnest(range(blocks)) AS i FROM counted WHERE blocks > 0 AND slots % blocks > 0),
{_permutation_sql("pa", "drawn", "i", "place", 5)},
took AS (SELECT ix, blocks, i * k // blocks AS shard, count(*) AS n FROM pa, shards WHERE place < rest GROUP BY ALL),
slots AS (SELECT ix, blocks, ceil(shard * blocks / k::DOUBLE)::BIGINT + unnest(range(n)) AS slot FROM took, shards),
{_permutation_sql("pb", "slots", "slot", "block", 6)},
taken AS (SELECT ix, block, 1 AS times FROM pb),
placed AS (
  SELECT s.doc_id, s.source, s.size, c.ix, c.source_size, c.target, CASE WHEN blocks > 0 THEN slots // blocks ELSE 0 END AS passes,
         coalesce(sum(s.size) OVER (PARTITION BY c.ix ORDER BY s.doc_id % 1024, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sizes s JOIN counted c ON s.source IS NOT DISTINCT FROM c.source),
pieces AS (
  SELECT *, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) AS block FROM placed WHERE size > 0),
summed AS (
  SELECT p.doc_id, p.ix, p.start, sum((least(start + size, (p.block + 1) * {BLOCK}) - greatest(start, p.block * {BLOCK})) * (p.passes + coalesce(t.times, 0))) AS taken
  FROM pieces p LEFT JOIN taken t ON p.ix = t.ix AND p.block = t.block GROUP BY 1, 2, 3)
SELECT p.doc_id, p.source, p.size, p.source_size, p.target, coalesce(s.taken, 0)::BIGINT AS taken
FROM placed p LEFT JOIN summed s ON p.doc_id = s.doc_id AND p.ix = s.ix AND p.start = s.start AND p.size > 0
"""
