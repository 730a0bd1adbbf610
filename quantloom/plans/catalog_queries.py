"""Catalog queries: factors in batches on a dense panel, with their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.catalog import bars158, formulaic101, lags360, methods191, seeds
from quantloom.functions.expr import Expr
from quantloom.plans.stages import batched, compute, rounded, to_sql
from quantloom.sources.panel import grid, grid_sql

#: catalog -> (panel, factors a query)
CATALOGS: dict[str, tuple[str, int, Callable[[], dict[str, Expr]]]] = {
    "alpha101": ("week", 17, formulaic101.factors),
    "alpha191": ("week", 24, methods191.factors),
    "alpha158": ("month", 32, bars158.factors),
    "alpha360": ("month", 60, lags360.factors),
    "seed_baselines": ("month", 23, seeds.factors),
}


def batches() -> dict[str, tuple[str, dict[str, Expr]]]:
    return {f"{name}_{k + 1}": (kind, batch) for name, (kind, size, made) in CATALOGS.items() for k, batch in enumerate(batched(made(), size))}


def _query(kind: str, columns: dict[str, Expr]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(compute(grid(spark, sf_dir, kind), columns))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(*x) for name, x in batches().items()}


def oracle_sql() -> dict[str, str]:
    return {name: to_sql(grid_sql(kind), columns) for name, (kind, columns) in batches().items()}
