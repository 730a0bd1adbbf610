"""Windows of an instrument's rows as matrices in Arrow batches.

Spark's sliding frames add up every cell of a window again, function by function. Here a task goes through its
instruments' rows once, in order: a batch is a matrix of overlapping windows, all functions of a step are computed from it, and the
rows that the next batch's windows reach back to go on with it. So a task holds one batch, whatever it has to do.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

# the functions go to the workers with the tasks, so that a panel needs no library installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bound below which a covariance is noise beside the two deviations, and what is added to divisors.
NOISE = EPS = 1e-12
Windows = list[np.ndarray]


def _centred(a: np.ndarray) -> np.ndarray:
    """Windows less their means; less their first cell before, so that equal cells leave exactly 0."""
    d = a - a[:, :1]
    return d - d.mean(axis=1, keepdims=True)


def _added(cells: Iterable[np.ndarray]) -> np.ndarray:
    """The columns added one by one, in the order given: that of the SQL texts, so that sums round alike and ties stay ties."""
    return reduce(np.add, cells)


def _sum(a: np.ndarray) -> np.ndarray:
    """From the oldest cell on."""
    return _added(a[:, k] for k in range(a.shape[1]))


def _deviation(d: np.ndarray) -> np.ndarray:
    return np.sqrt((d * d).sum(axis=1) / (d.shape[1] - 1))


def _co_moment(x: Windows, ratio: bool) -> np.ndarray:
    a, b = _centred(x[0]), _centred(x[1])
    c, s = (a * b).sum(axis=1) / (a.shape[1] - 1), _deviation(a) * _deviation(b)
    # NaN is above all, as in Spark's comparisons
    return np.where((np.abs(c) <= NOISE * s) | np.isnan(s), 0.0, c / (s + EPS) if ratio else c)


def _quantile(x: Windows, low: int, high: int, at: float) -> np.ndarray:
    cells = np.partition(x[0], sorted({low, high}), axis=1)
    return cells[:, low] if low == high else (high - at) * cells[:, low] + (at - low) * cells[:, high]


def _argmin(x: Windows) -> np.ndarray:
    return (x[0] == np.fmin.reduce(x[0], axis=1)[:, None]).argmax(axis=1) + 1.0


def _rank(x: Windows) -> np.ndarray:
    last = x[0][:, -1:]
    return ((x[0] < last) | (np.isnan(last) & ~np.isnan(x[0]))).sum(axis=1) + 1.0


def _by_key(x: Windows) -> np.ndarray:
    """The second column's windows in the order of the first's, equal keys from the oldest."""
    return np.take_along_axis(x[1], np.argsort(x[0], axis=1, kind="stable"), axis=1)


#: Functions of windows, a row a window, oldest cell first, all cells present; NaN is greater than any number.
FULL: dict[str, Callable[..., np.ndarray]] = {
    "sum": lambda x: _sum(x[0]),
    "mean": lambda x: _sum(x[0]) / x[0].shape[1],
    "std": lambda x: _deviation(_centred(x[0])),
    "max": lambda x: x[0].max(axis=1),
    "min": lambda x: np.fmin.reduce(x[0], axis=1),
    "quantile": _quantile,
    "argmax": lambda x: x[0].argmax(axis=1) + 1.0,
    "argmin": _argmin,
    "rank": _rank,
    "cov": lambda x: _co_moment(x, False),
    "corr": lambda x: _co_moment(x, True),
    # from the newest cell on
    "weighted": lambda x, *weights: _added(v * x[0][:, -1 - i] for i, v in enumerate(weights)),
    "bucket": lambda x, first, n: _sum(_by_key(x)[:, first - 1 : first - 1 + n]),
    "spread": lambda x, n: (_sum(_by_key(x)[:, -n:]) - _sum(_by_key(x)[:, :n])) / n,
}
#: Windows computed at once: their matrices stay in the processor's cache.
ROWS = 2048


def framed(roll: tuple) -> bool:
    """Whether it looks at all cells of a window, not at one."""
    return bool(roll) and roll[0] in FULL and roll[1] > 1


def _one(roll: tuple, values: list[np.ndarray], present: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values, and where there are any, of one function over rows that have their place in the instrument's (from 1, no more than known)."""
    name, w, *more = roll
    n = len(place)
    out, ok = np.zeros(n), np.zeros(n, bool)
    if name == "lag":
        if n > w:
            out[w:], ok[w:] = values[0][: n - w], present[0][: n - w] & (place[w:] > w)
        return out, ok
    if n < w:
        return out, ok
    counts = np.concatenate([[0], np.cumsum(present[0])])
    whole = counts[w:] - counts[:-w] == w
    reached = place[w - 1 :] >= w
    ok[w - 1 :] = reached if name == "corr" else reached & whole
    views = [sliding_window_view(v, w) for v in values]
    for k in range(0, n - w + 1, ROWS):
        at = np.nonzero((whole & reached)[k : k + ROWS])[0]
        if len(at):
            some = [v[k : k + ROWS] for v in views]
            out[w - 1 + k + at] = FULL[name]([s if len(at) == len(s) else s[at] for s in some], *more)
    return out, ok


def rolled(df: DataFrame, rolls: dict[str, tuple[tuple, list[str]]], placed: bool = False) -> DataFrame:
    """df with a column for each function: name -> ((function, rows, ..), its columns, doubles).

    placed: an instrument's rows are in one partition, in order, already; so they are afterwards.
    """
    rows = df if placed else df.repartition("instrument").sortWithinPartitions("instrument", "dt")
    back = max(roll[1] for roll, _ in rolls.values())
    used = sorted({c for _, args in rolls.values() for c in args})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            own = pa.Table.from_batches([batch]).select(["instrument", *used])
            cells = own if before is None else pa.concat_tables([before, own])
            halo, n = cells.num_rows - own.num_rows, cells.num_rows
            code = cells["instrument"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            first = np.concatenate([[True], code[1:] != code[:-1]])[:n]
            row = np.arange(n)
            place = row - np.maximum.accumulate(np.where(first, row, 0)) + 1
            present = {c: cells[c].combine_chunks().is_valid().to_numpy(zero_copy_only=False) for c in used}
            values = {c: cells[c].combine_chunks().to_numpy(zero_copy_only=False) for c in used}
            made = []
            with np.errstate(all="ignore"):
                for roll, args in rolls.values():
                    out, ok = _one(roll, [values[c] for c in args], [present[c] for c in args], place)
                    made.append(pa.array(out[halo:], pa.float64(), mask=~ok[halo:]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *rolls])
            before = cells.slice(max(0, n - back))

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *[StructField(name, DoubleType()) for name in rolls]]))


def _power(x: float | None, p: float | None) -> float | None:
    try:
        out = math.nan if x is None or p is None else math.pow(x, p)
    except (OverflowError, ValueError):
        return None
    return out if math.isfinite(out) else None


@F.arrow_udf(DoubleType())
def c_pow(x: pa.Array, p: pa.Array) -> pa.Array:
    """C's power, as DuckDB has it, where Java's strict one differs in the last digit; missing where it is not a finite number."""
    return pa.array(map(_power, x.to_pylist(), p.to_pylist()), pa.float64())
