"""Recursive means as prefix scans, and windows of one instrument in blocks of time.

A step of an exponential mean is an affine map of the value before. A run of present rows is one map too, with the
places of its first and last row, since rows missing in between age the old value. Runs are folded in blocks of BLOCK rows, blocks
of BLOCK blocks and so on, and what comes before a block is handed down again, so that an instrument of any length is spread over
tasks, all in SQL expressions. Rows are stored once, since levels and result read them.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.sources.shared import stored

#: Rows of a block, and blocks of a block of the next level.
BLOCK = 32
_RUN = "struct<first_t:bigint,first_x:double,last_t:bigint,a:double,b:double,n:bigint>"


def with_ordinal(df: DataFrame, name: str = "_t") -> DataFrame:
    """df with the date's number among all dates, from 0 (a row a date is numbered)."""
    dates = df.select(F.col("dt").alias("_dt")).distinct().withColumn(name, F.row_number().over(Window.orderBy("_dt")).cast("long") - 1)
    return df.join(dates, F.col("dt") == F.col("_dt")).drop("_dt")


def _run(t: Column, x: Column) -> Column:
    """One present row: the value after it is a * (value after its first row) + b."""
    return F.struct(t.cast("long").alias("first_t"), x.alias("first_x"), t.cast("long").alias("last_t"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(1).cast("long").alias("n"))


def _joined(p: Column, q: Column, alpha: float) -> Column:
    """Run p, then run q: the old value weighs (1 - alpha) to the number of rows since, the new one alpha."""
    old = F.pow(F.lit(1.0 - alpha), (q.first_t - p.last_t).cast("double"))
    total = old + alpha
    both = F.struct(p.first_t.alias("first_t"), p.first_x.alias("first_x"), q.last_t.alias("last_t"), (q.a * old * p.a / total).alias("a"), (q.a * (old * p.b + alpha * q.first_x) / total + q.b).alias("b"), (p.n + q.n).alias("n"))
    return F.when(p.isNull(), q).when(q.isNull(), p).otherwise(both)


def _folded(runs: Column, alpha: float, start: Column | None = None) -> Column:
    return F.aggregate(runs, F.lit(None).cast(_RUN) if start is None else start, lambda acc, q: _joined(acc, q, alpha))


def recursive_means(df: DataFrame, rules: Mapping[str, tuple[str, float, int]], most: int, spread: bool = False) -> DataFrame:
    """df with each named column: the exponential mean of an expression, (expression, alpha, least number of values) of each.

    df: instrument, _t (the row's place in time, from 0 to at most `most`). A missing row keeps the last mean; missing until
    `least` values have been seen. spread: deal one instrument's blocks to tasks, else rows stay as they are dealt.
    """
    inputs = {name: f"_x_{name}" for name in rules}
    rows = df.withColumns({inputs[n]: F.expr(text).cast("double") for n, (text, _, _) in rules.items()}).withColumn("_b0", F.floor(F.col("_t") / BLOCK).cast("long"))
    if spread:
        rows = rows.repartition("instrument", "_b0")
    upto = Window.partitionBy("instrument", "_b0").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    own = {n: F.collect_list(F.when(F.col(inputs[n]).isNotNull(), _run(F.col("_t"), F.col(inputs[n])))).over(upto) for n in rules}
    rows = rows.withColumns({f"_p_{n}": own[n] for n in rules}).withColumns({f"_p_{n}": _folded(F.col(f"_p_{n}"), rules[n][1]) for n in rules})
    rows = stored(rows, "runs")
    # a block's last row has the whole block's run
    levels = [rows.groupBy("instrument", F.col("_b0").alias("_k")).agg(*[F.max_by(f"_p_{n}", "_t").alias(n) for n in rules])]
    places = most // BLOCK + 1
    while places > 1:
        up = levels[-1].groupBy("instrument", F.floor(F.col("_k") / BLOCK).cast("long").alias("_k"))
        levels.append(up.agg(*[F.array_sort(F.collect_list(F.when(F.col(n).isNotNull(), F.struct("_k", F.col(n).alias("run"))))).alias(n) for n in rules]).select("instrument", "_k", *[_folded(F.transform(n, lambda x: x.run), rules[n][1]).alias(n) for n in rules]))
        places = -(-places // BLOCK)
    # what comes before each block: nothing before the top, then its block's and that of its earlier neighbours
    before: DataFrame | None = None
    for level in reversed(levels):
        earlier = Window.partitionBy("instrument", "_up").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
        at = level.withColumn("_up", F.floor(F.col("_k") / BLOCK).cast("long")).select("instrument", "_k", "_up", *[F.collect_list(n).over(earlier).alias(n) for n in rules])
        if before is None:
            at = at.select("instrument", "_k", *[_folded(F.col(n), rules[n][1]).alias(n) for n in rules])
        else:
            above = before.select(F.col("instrument").alias("_i"), F.col("_k").alias("_u"), *[F.col(n).alias(f"_s_{n}") for n in rules])
            at = at.join(above, F.col("instrument").eqNullSafe(F.col("_i")) & (F.col("_up") == F.col("_u"))).select("instrument", "_k", *[_folded(F.col(n), rules[n][1], F.col(f"_s_{n}")).alias(n) for n in rules])
        before = at
    entry = before.select(F.col("instrument").alias("_i"), F.col("_k").alias("_u"), *[F.col(n).alias(f"_s_{n}") for n in rules])
    out = rows.join(entry, F.col("instrument").eqNullSafe(F.col("_i")) & (F.col("_b0") == F.col("_u")))
    for n, (_, alpha, least) in rules.items():
        out = out.withColumn(n, _joined(F.col(f"_s_{n}"), F.col(f"_p_{n}"), alpha)).withColumn(n, F.when(F.col(f"{n}.n") >= least, F.col(f"{n}.a") * F.col(f"{n}.first_x") + F.col(f"{n}.b")))
    return out.drop("_b0", "_i", "_u", *[f"{p}_{n}" for n in rules for p in ("_s", "_p", "_x")])


_OWN = "PARTITION BY instrument"
_FRAME = re.compile(r"ROWS BETWEEN (\d+) PRECEDING")
_SHIFT = re.compile(r", (\d+)\) OVER \(PARTITION BY instrument ORDER BY dt\)")


def bounded(text: str) -> bool:
    """Whether a window's text looks at a fixed number of rows only."""
    return "row_number()" not in text and "UNBOUNDED" not in text and "OVER (PARTITION BY instrument)" not in text


def reach(texts: list[str]) -> tuple[int, int]:
    """Rows back and ahead that windows look at."""
    shifts = [int(n) for t in texts for n in _SHIFT.findall(t)]
    frames = [int(n) for t in texts for n in _FRAME.findall(t)]
    return max([0, *frames, *shifts]), max([0, *[int(n) for t in texts if "lead(" in t for n in _SHIFT.findall(t)]])


def in_blocks(df: DataFrame, columns: Mapping[str, str], rows: int) -> DataFrame:
    """df with the windows' columns, computed in blocks of about `rows` dates: a block gets copies of the rows its windows reach into.

    df: dense in (instrument, _t). All windows must be bounded(); blocks are at least as long as they reach.
    """
    back, ahead = reach(list(columns.values()))
    size = max(rows, back + ahead, 1)
    block = lambda t: F.floor(t / size).cast("long")
    dealt = df.withColumn("_block", F.explode(F.sequence(block(F.col("_t") - ahead), block(F.col("_t") + back)))).repartition("instrument", "_block")
    made = dealt.select("*", *[F.expr(text.replace(_OWN, f"{_OWN}, _block")).alias(name) for name, text in columns.items()])
    return made.where(F.col("_block") == block(F.col("_t"))).drop("_block")
