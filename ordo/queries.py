"""Registered queries: each runs an operator over the whole benchmark tables.

Every entry is ``(spark, sf_dir) -> DataFrame`` and, where the result can be
stated in SQL, carries an equivalent DuckDB query over the same parquet
tables (views named after the tables).  Computed columns are aliased to the
same names on both sides; doubles are rounded to 6 decimals on both sides so
the comparison is not thrown by summation order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.tables import table

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    headline: bool = False


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql.strip() if sql else None, headline)
        return fn

    return deco


# Doubles are snapped to a 1e-6 grid with an irrational offset on both sides:
# two engines that sum in a different order differ in the last bits, and a
# plain round() turns exact decimal ties (common for means of cents) into
# mismatches; an offset grid point is never hit by such "nice" values.
GRID = 1e6
OFFSET = 0.3819660112501051


def q6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (F.floor(c.cast("double") * F.lit(GRID) + F.lit(OFFSET)).cast("double") / F.lit(GRID))


def Q6(expr: str) -> str:
    """SQL twin of ``q6`` for the DuckDB oracle."""
    return f"(floor(CAST(({expr}) AS DOUBLE) * CAST({GRID} AS DOUBLE) + {OFFSET}) / CAST({GRID} AS DOUBLE))"


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def load_all() -> dict[str, Query]:
    """Import every query module so its decorators run."""
    import importlib
    import pkgutil

    from . import catalog

    for mod in pkgutil.iter_modules(catalog.__path__):
        importlib.import_module(f"{catalog.__name__}.{mod.name}")

    return REGISTRY
