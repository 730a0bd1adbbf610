"""Correlations of many columns from a table of co-moments.

Each task reduces its rows to the counts, sums and products of all pairs of columns, as matrix products over batches,
with missing cells left out pair by pair; the tasks' tables are summed by pair. Values are taken less their
column's mean first, so that nothing cancels. So the plan does not grow with the number of columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Columns of a block: tasks hold the moments of two blocks at a time.
BLOCK = 512
#: Series of a block that ask and that answer, those that are multiplied at once, and pairs computed one by one at once.
ASKED, ANSWERS, ROWS, PAIRS = 4096, 2048, 256, 4096


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; missing and not finite cells are NaN."""
    cells = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return np.where(np.isfinite(cells), cells, np.nan)


def means(wide: DataFrame, names: Sequence[str]) -> list[float]:
    """Each column's mean over the cells it has, 0 without any."""
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width), np.zeros(width, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            total += np.nansum(x, axis=0)
            n += (~np.isnan(x)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total), pa.array(n)], ["i", "total", "n"])

    rows = wide.select(F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("x")).mapInArrow(run, "i long, total double, n long")
    got = {r.i: r.total / r.n for r in rows.groupBy("i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect() if r.n}
    return [got.get(i, 0.0) for i in range(width)]


def co_moments(wide: DataFrame, left: Sequence[str], right: Sequence[str], at: dict[str, float]) -> DataFrame:
    """a, b, n, sx, sy, sxx, syy, sxy of each pair of a column of left and one of right, over rows that have both; values less `at`."""
    k, m = len(left), len(right)
    shift = np.array([at[c] for c in (*left, *right)])
    names_a, names_b = np.repeat(np.array(left, object), m), np.tile(np.array(right, object), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((k, m)) for _ in range(6)]
        for batch in batches:
            x = _matrix(batch.column(0), k + m) - shift
            have = (~np.isnan(x)).astype(np.float64)
            x = np.nan_to_num(x)
            (a, b), (p, q) = (x[:, :k], x[:, k:]), (have[:, :k], have[:, k:])
            for total, part in zip(sums, (p.T @ q, a.T @ q, p.T @ b, (a * a).T @ q, p.T @ (b * b), a.T @ b), strict=True):
                total += part
        n = np.rint(sums[0]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names_a, pa.string()), pa.array(names_b, pa.string()), pa.array(n.ravel()), *[pa.array(s.ravel()) for s in sums[1:]]], ["a", "b", "n", "sx", "sy", "sxx", "syy", "sxy"])

    cells = wide.select(F.array(*[F.col(f"`{c}`").cast("double") for c in (*left, *right)]).alias("x"))
    parts = cells.mapInArrow(run, "a string, b string, n long, sx double, sy double, sxx double, syy double, sxy double")
    return parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def correlations(wide: DataFrame, names: Sequence[str], least: int = 50) -> DataFrame:
    """a, b, corr, n of every pair of the columns (a before b by name), pairwise complete; corr is missing below `least` pairs, or where one doesn't vary."""
    names = sorted(set(names))
    at = dict(zip(names, means(wide, names), strict=True))
    blocks = [names[k : k + BLOCK] for k in range(0, len(names), BLOCK)]
    out = None
    for i, left in enumerate(blocks):
        for right in blocks[i:]:
            part = co_moments(wide, left, right, at).where("a < b")
            out = part if out is None else out.unionByName(part)
    x2, y2, xy = (F.col(f"s{u}{v}") - F.col(f"s{u}") * F.col(f"s{v}") / F.col("n") for u, v in (("x", "x"), ("y", "y"), ("x", "y")))
    varies = (x2 > F.col("sxx") * 1e-14) & (y2 > F.col("syy") * 1e-14)
    corr = F.when((F.col("n") >= least) & varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), xy / F.sqrt(x2 * y2))))
    return out.select("a", "b", corr.alias("corr"), F.col("n").cast("long").alias("n"))


def _two_pass(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Correlation of each row of x with that of y over the cells that both have (others NaN); NaN where one does not vary."""
    both = ~(np.isnan(x) | np.isnan(y))
    n = np.maximum(both.sum(axis=1), 1)
    # less a cell of the row itself, so that equal cells leave exactly 0
    parts = []
    for v in (x, y):
        d = np.where(both, v - np.where(both, v, np.inf).min(axis=1, initial=np.inf)[:, None], 0.0)
        parts.append(np.where(both, d - (d.sum(axis=1) / n)[:, None], 0.0) * (d.max(axis=1) > 0)[:, None])
    (a, b) = parts
    with np.errstate(divide="ignore", invalid="ignore"):
        return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def _correlated(x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    """Correlation of every row of x with every row of y over the cells that both have; NaN below `least` of them, or where one does not vary.

    By matrix products; pairs whose common cells vary so little beside their distance from the rows' means that digits
    would be lost are computed again one by one.
    """
    centred = [v - np.nan_to_num(np.nanmean(np.where(np.isnan(v).all(axis=1)[:, None], 0.0, v), axis=1))[:, None] for v in (x, y)]
    (p, q), (a, b) = [(~np.isnan(v)).astype(np.float64) for v in centred], [np.nan_to_num(v) for v in centred]
    n, sx, sy, sxx, syy = p @ q.T, a @ q.T, p @ b.T, (a * a) @ q.T, p @ (b * b).T
    with np.errstate(divide="ignore", invalid="ignore"):
        x2, y2 = sxx - sx * sx / n, syy - sy * sy / n
        corr = (a @ b.T - sx * sy / n) / np.sqrt(x2 * y2)
    enough = n > least - 0.5
    i, j = np.nonzero(enough & ~((x2 > 1e-3 * sxx) & (y2 > 1e-3 * syy)))
    for k in range(0, len(i), PAIRS):
        at = slice(k, k + PAIRS)
        corr[i[at], j[at]] = _two_pass(x[i[at]], y[j[at]])
    corr[~enough] = np.nan
    return np.clip(corr, -1.0, 1.0)


def _nearest(table: pa.Table, keys: int, least: int) -> pa.Table:
    """name, matched, corr of a block: for each series that asks, the one that answers with the greatest absolute correlation."""

    def dense(rows: pa.Table) -> np.ndarray:
        out, cells = np.full((rows.num_rows, keys), np.nan), rows["cells"].combine_chunks()
        flat = cells.flatten()
        out[np.repeat(np.arange(rows.num_rows), np.diff(cells.offsets.to_numpy())), flat.field("place").to_numpy()] = flat.field("value").to_numpy()
        return out

    answers = pc.equal(table["side"], 1)
    # the greatest name first, so that the first of equal correlations is its
    right = table.filter(answers).sort_by([("name", "descending")])
    left = table.filter(pc.invert(answers))
    found: list[tuple[str, str, float]] = []
    names, asking, y = right["name"].to_pylist(), left["name"].to_pylist(), dense(right)
    own = {name: j for j, name in enumerate(names)}
    for k in range(0, len(asking) if names else 0, ROWS):
        some = asking[k : k + ROWS]
        corr = np.abs(_correlated(dense(left.slice(k, ROWS)), y, least))
        for i, name in enumerate(some):
            if name in own:
                corr[i, own[name]] = np.nan
        corr = np.where(np.isnan(corr), -1.0, corr)
        best = np.round(corr, 9).argmax(axis=1)
        found += [(name, names[j], float(corr[i, j])) for i, (name, j) in enumerate(zip(some, best.tolist(), strict=True)) if corr[i, j] >= 0]
    return pa.table({"name": pa.array([f[0] for f in found], pa.string()), "matched": pa.array([f[1] for f in found], pa.string()), "corr": pa.array([f[2] for f in found], pa.float64())})


def nearest_series(series: DataFrame, asked: DataFrame, answers: DataFrame, least: int = 5) -> DataFrame:
    """group, name, matched, corr: for each asked name, of its group's other answers the one whose values correlate with its most, by absolute value.

    series: name, key, value, one row a name and key; asked, answers: group, name. A correlation is over the keys that both have,
    at least `least`; values that are missing or not finite are left out. Equal correlations (to 9 places) go to the greatest
    name; corr is that of a part of the answers, so there may be several rows a name. A group's names are dealt to blocks, and each block of
    asked names meets each block of answers as matrices: a task holds one such pair, and no pair of names is ever a row.
    """
    finite = series.where(F.abs("value") < float("inf"))
    places = finite.select(F.col("key").alias("_key")).distinct().withColumn("place", F.row_number().over(Window.orderBy("_key")) - 1)  # a row a key
    keys = finite.agg(F.count_distinct("key")).first()[0]
    cells = finite.join(places, F.col("key") == F.col("_key")).groupBy(F.col("name").alias("_name")).agg(F.collect_list(F.struct("place", "value")).alias("cells"))
    side = lambda df, asks: df.select("group", "name", F.lit(asks).alias("asks"), F.lit(1 - asks).alias("answers"))
    names = side(asked, 1).unionByName(side(answers, 0)).groupBy("group", "name").agg(F.max("asks").alias("asks"), F.max("answers").alias("answers"))
    blocks = lambda c, size: F.ceil(F.sum(c) / size).cast("int")
    sizes = names.groupBy(F.col("group").alias("_group")).agg(blocks("asks", ASKED).alias("_l"), blocks("answers", ANSWERS).alias("_r")).where("_l > 0 and _r > 0")
    own = lambda n: F.pmod(F.xxhash64("name"), F.col(n)).cast("int")
    all_ = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    spot = lambda left, right, k: F.struct(left.alias("left"), right.alias("right"), F.lit(k).alias("side"))
    none = F.array().cast("array<struct<left:int,right:int,side:int>>")
    asks = F.when(F.col("asks") == 1, F.transform(all_("_r"), lambda r: spot(own("_l"), r, 0))).otherwise(none)
    gives = F.when(F.col("answers") == 1, F.transform(all_("_l"), lambda k: spot(k, own("_r"), 1))).otherwise(none)
    dealt = names.join(sizes, F.col("group") == F.col("_group")).join(cells, F.col("name") == F.col("_name")).select("group", "name", "cells", F.explode(F.concat(asks, gives)).alias("at")).select("group", "name", "cells", "at.*")
    kind = dealt.schema["group"].dataType.simpleString()

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out = _nearest(table, keys, least)
        return out.add_column(0, "group", pa.array([key[0].as_py()] * out.num_rows, table.schema.field("group").type))

    return dealt.groupBy("group", "left", "right").applyInArrow(run, f"`group` {kind}, name string, matched string, corr double")
