"""Registry of factors: built-in catalogs and user factors, as data and as builders."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.catalog import bars158, formulaic101, lags360, methods191, seeds
from quantloom.functions.expr import Expr
from quantloom.operators.prep import required
from quantloom.plans.stages import compute

Builder = Callable[[DataFrame], Column]


def needed(x: Expr) -> set[str]:
    """Fields that a tree reads."""
    return {x.spark} if x.kind == "field" else set().union(*[needed(a) for a in x.args]) if x.args else set()


@dataclass
class Registry:
    """Factors by name: trees, or functions from a frame to a column."""

    trees: dict[str, Expr] = field(default_factory=dict)
    functions: dict[str, tuple[Builder, tuple[str, ...]]] = field(default_factory=dict)
    notes: dict[str, tuple[str, str]] = field(default_factory=dict)

    def register(self, name: str, factor: Expr | Builder, source: str = "user", required_fields: Sequence[str] = (), note: str = "") -> None:
        if name in self.trees or name in self.functions:
            raise ValueError(f"{name} is registered already")
        if isinstance(factor, Expr):
            self.trees[name] = factor
        else:
            self.functions[name] = (factor, tuple(required_fields))
        self.notes[name] = (source, note)

    def compute(self, grid: DataFrame, names: Sequence[str]) -> DataFrame:
        """dt, instrument and the named factors; a missing field is an error before anything runs."""
        for n in names:
            required(grid, sorted(needed(self.trees[n])) if n in self.trees else self.functions[n][1])
        made = {n: self.functions[n][0](grid) for n in names if n in self.functions}
        df = grid.withColumns(made) if made else grid
        return compute(df, {n: self.trees[n] for n in names if n in self.trees}, ("dt", "instrument", *made)).select("dt", "instrument", *[F.col(f"`{n}`") for n in names])

    def find(self, source: str = "", prefix: str = "") -> list[str]:
        return sorted(n for n, (s, _) in self.notes.items() if s.startswith(source) and n.startswith(prefix))

    def table(self, spark: SparkSession) -> DataFrame:
        """name, source, fields, note of each factor."""
        rows = []
        for n, (source, note) in sorted(self.notes.items()):
            fields = sorted(needed(self.trees[n])) if n in self.trees else list(self.functions[n][1])
            rows.append((n, source, fields, note))
        return spark.createDataFrame(rows, "name string, source string, fields array<string>, note string")

    def summary(self, spark: SparkSession) -> DataFrame:
        return self.table(spark).groupBy("source").agg(F.count("*").alias("n_factors"))


def built_in() -> Registry:
    out = Registry()
    for source, made in (("alpha101", formulaic101), ("alpha158", bars158), ("alpha191", methods191), ("alpha360", lags360), ("seed", seeds)):
        for name, tree in made.factors().items():
            out.register(f"{source}.{name}", tree, source)
    return out
