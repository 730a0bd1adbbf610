"""From factor trees to staged projections.

Spark cannot nest a window in a window, so each window node becomes a column of a stage. Equal nodes are
one column. A stage takes every node that is ready and of the stage's kind (by instrument or by date), so
the number of shuffles is the number of changes between the two kinds, not that of the factors.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.expr import Expr, lit
from quantloom.operators.ranks import cs_ranked
from quantloom.plans.rolling import c_pow, framed, rolled
from quantloom.plans.scans import bounded, in_blocks, recursive_means, with_ordinal

#: A row-wise expression longer than this becomes a column of its own.
LONG = 240


class Program:
    """Steps for a set of named trees: ("project" | "ts" | "cs" | "rec", {column: text or node})."""

    def __init__(self, outputs: Mapping[str, Expr], text: Callable[[Expr], str], fields: set[str]):
        self.text, self.fields = text, fields
        self.names: dict[str, str] = {}
        self.steps: list[tuple[str, dict]] = []
        self.nodes: dict[str, Expr] = {}
        #: Columns that are ranks within the date, and what they rank.
        self.ranks: dict[str, str] = {}
        #: Columns that plans.rolling can compute: function and arguments.
        self.rolls: dict[str, tuple[tuple, list[str]]] = {}
        self._windows: dict[str, set[str]] = {}
        roots = {k: lit(v) for k, v in outputs.items()}
        order: list[Expr] = []
        for root in roots.values():
            self._collect(root, order)
        left = {n.key: n for n in order if n.kind in ("ts", "cs", "rec")}
        kind = "ts"
        while left:
            ready = {k: n for k, n in left.items() if all(w in self.names for a in n.args for w in self._windows[a.key])}
            kinds = {n.kind for n in ready.values()}
            kind = kind if kind in kinds else next(k for k in ("ts", "rec", "cs") if k in kinds)
            batch = {k: n for k, n in ready.items() if n.kind == kind}
            layers: list[dict] = []
            made: dict[str, tuple[Expr, list[str]]] = {}
            for k, n in batch.items():
                made[k] = (n, [self._column(a, layers) for a in n.args])
            self.steps += [("project", x) for x in layers]
            step: dict = {}
            for k, (n, args) in made.items():
                name = f"w{len(self.names)}"
                step[name] = (n, args) if kind == "rec" else self.text(n).format(*args)
                self.names[k] = name
                if n.rank:
                    self.ranks[name] = args[0]
                if n.roll:
                    self.rolls[name] = (n.roll, args)
                left.pop(k)
            self.steps.append((kind, step))
        layers = []
        final = {name: self._render(root, layers) for name, root in roots.items()}
        self.steps += [("project", x) for x in layers]
        self.final = final

    def _collect(self, n: Expr, order: list[Expr]) -> set[str]:
        if n.key not in self._windows:
            found: set[str] = set()
            for a in n.args:
                found |= self._collect(a, order)
            if n.kind in ("ts", "cs", "rec"):
                found = {n.key}
            self._windows[n.key] = found
            order.append(n)
        return self._windows[n.key]

    def _render(self, n: Expr, layers: list[dict]) -> str:
        if n.key in self.names:
            return self.names[n.key]
        if n.kind == "field":
            return n.spark
        args = [self._render(a, layers) for a in n.args]
        out = self.text(n).format(*args)
        if len(out) > LONG:
            made = {c: i for i, layer in enumerate(layers) for c in layer}
            at = 1 + max([-1, *(i for c, i in made.items() if c in out)])
            if at == len(layers):
                layers.append({})
            name = f"e{len(self.names)}"
            layers[at][name] = out
            self.names[n.key] = name
            return name
        return out

    def _column(self, n: Expr, layers: list[dict]) -> str:
        """An argument of a window: a field, a literal or a column."""
        out = self._render(n, layers)
        if n.kind == "elem" and n.args and n.key not in self.names:
            made = {c: i for i, layer in enumerate(layers) for c in layer}
            at = 1 + max([-1, *(i for c, i in made.items() if c in out)])
            if at == len(layers):
                layers.append({})
            name = f"e{len(self.names)}"
            layers[at][name] = out
            self.names[n.key] = name
            return name
        return out


def window_calls(texts: Mapping[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """Every distinct window call in the texts under a name of its own, and the texts with the names in place of the calls.

    Texts of different columns, and parts of one, often hold the same call (the number of cells, a deviation); Spark would
    compute each again.
    """
    calls: dict[str, str] = {}

    def closing(text: str, at: int, step: int) -> int:
        depth = 0
        while True:
            depth += {"(": 1, ")": -1}.get(text[at], 0)
            if depth == 0:
                return at
            at += step

    out = {}
    for name, text in texts.items():
        while (over := text.find(" OVER (")) >= 0:
            start = closing(text, over - 1, -1)
            while start > 0 and (text[start - 1].isalnum() or text[start - 1] == "_"):
                start -= 1
            end = closing(text, over + 6, 1) + 1
            text = text[:start] + calls.setdefault(text[start:end], f"_c{len(calls)}") + text[end:]
        out[name] = text
    return {n: call for call, n in calls.items()}, out


def compute(panel: DataFrame, outputs: Mapping[str, Expr], keep: tuple[str, ...] = ("dt", "instrument"), spread: int = 0) -> DataFrame:
    """keep and one column for each named tree, over a dense panel with dt and instrument.

    spread: by default a date's rows are ranked, and an instrument's windows computed, in one task. For panels with very
    many instruments or dates, spread is a number of dates: instruments are then worked on in blocks of about so many
    dates and ranks in ranges of values, with the same results.
    """
    program = Program(outputs, lambda n: n.spark, set(panel.columns))
    panel.sparkSession.udf.register("c_pow", c_pow)
    recursive = any(kind == "rec" for kind, _ in program.steps)
    df = with_ordinal(panel) if spread or recursive else panel
    most = (panel.select("dt").distinct().count() if recursive else 1) - 1
    placed = False
    for k, (kind, columns) in enumerate(program.steps):
        # only what is needed later goes on
        later = " ".join([*keep, "dt instrument _t", *program.final.values(), *(str(x[1]) if isinstance(x, tuple) else x for _, step in program.steps[k:] for x in step.values())])
        needed = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", later))
        df = df.select([c for c in df.columns if c in needed or not c.isidentifier()])
        if kind == "rec":
            rules = {name: (args[0], *map(float, n.spark.split(","))) for name, (n, args) in columns.items()}
            df, placed = recursive_means(df, rules, max(0, most), bool(spread)), False
            continue
        if kind == "ts" and not spread:
            types = dict(df.dtypes)
            rolls = {n: program.rolls[n] for n in columns if n in program.rolls and all(types.get(a) == "double" for a in program.rolls[n][1])}
            if any(framed(roll) for roll, _ in rolls.values()):
                df, placed = rolled(df, rolls, placed), True
                columns = {n: t for n, t in columns.items() if n not in rolls}
                if not columns:
                    continue
        placed = placed and kind == "project"
        if spread and kind == "ts":
            df = in_blocks(df, {n: t for n, t in columns.items() if bounded(t)}, spread)
            columns = {n: t for n, t in columns.items() if not bounded(t)}
        if spread and kind == "cs":
            ranks = {n: x for n, x in program.ranks.items() if n in columns}
            df = cs_ranked(df, {n: F.expr(x) for n, x in ranks.items()})
            columns = {n: t for n, t in columns.items() if n not in ranks}
        calls, texts = window_calls(columns)
        df = df.select("*", *[F.expr(text).alias(name) for name, text in calls.items()])
        df = df.select(*[c for c in df.columns if c not in calls], *[F.expr(text).alias(name) for name, text in texts.items()])
    return df.select(*[F.col(f"`{c}`") for c in keep], *[F.expr(text).alias(name) for name, text in program.final.items()])


def to_sql(source: str, outputs: Mapping[str, Expr], keep: tuple[str, ...] = ("dt", "instrument"), digits: int | None = 6) -> str:
    """The same as DuckDB SQL over a sub-query; doubles rounded as rounded() does."""
    program = Program(outputs, lambda n: n.duck, set())
    parts, at = [f"s0 AS ({source})"], "s0"
    for kind, columns in program.steps:
        texts = {name: (x[0].duck.format(*x[1]) if kind == "rec" else x) for name, x in columns.items()}
        nxt = f"s{len(parts)}"
        parts.append(f"{nxt} AS MATERIALIZED (SELECT *, {', '.join(f'{t} AS {name}' for name, t in texts.items())} FROM {at})")
        at = nxt
    parts.append(f"shown AS (SELECT {', '.join([*keep, *[f'{t} AS {name}' for name, t in program.final.items()]])} FROM {at})")
    shown = [f"{rounding(name, digits)} AS {name}" if digits is not None else name for name in program.final]
    return f"WITH {', '.join(parts)} SELECT {', '.join([*keep, *shown])} FROM shown"


def rounding(name: str, digits: int = 6, spark: bool = False) -> str:
    """SQL of a double rounded for comparison, without negative zero: to some eight significant digits where it is large.

    spark: the text for Spark, whose own round() goes by a double's shortest decimal form; DuckDB's goes by the double,
    multiplied by the power of ten, and near a half the two may differ. So Spark multiplies and divides in the open.
    """
    tiers = [(1e2, digits), (1e4, digits - 1), (1e6, digits - 2), (1e9, digits - 4)]

    def places(x: str, d: int) -> str:
        power = f"CAST({10.0 ** abs(d)!r} AS DOUBLE)"
        up, down = ("*", "/") if d >= 0 else ("/", "*")
        return f"round(({x}) {up} {power}) {down} {power}" if spark else f"round({x}, {d})"

    # an eighth of the last place is added first: values that end in an exact half then round alike everywhere
    cases = " ".join(f"WHEN abs({name}) < {top:.0e} THEN {places(f'{name} + {0.12345 * 10.0**-d!r}', d)}" for top, d in tiers)
    # beyond that by mantissa and exponent, joined as text: powers of ten aren't the same to the last bit everywhere
    place = f"floor(log10(abs({name})))"
    mantissa = places(f"{name} / pow(CAST(10 AS DOUBLE), {place})", digits)
    large = f"CAST(concat(CAST({mantissa} AS STRING), 'e', CAST(CAST({place} AS INT) AS STRING)) AS DOUBLE)"
    return f"CASE {cases} WHEN {name} IS NOT NULL THEN {large} END + 0.0"


def rounded(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ("dt", "instrument")) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*[F.col(c) if c in keep or t not in ("double", "float") else F.expr(rounding(c, digits, spark=True)).alias(c) for c, t in df.dtypes])


def batched(outputs: Mapping[str, Expr], size: int = 40) -> Iterator[dict[str, Expr]]:
    """The trees in batches, so that a select stays within code generation's limits."""
    names = list(outputs)
    for k in range(0, len(names), size):
        yield {n: outputs[n] for n in names[k : k + size]}
