"""Resampling of imbalanced rows: by class towards a wished distribution, and by rarity of a numeric target.

Rates come from running counts and moments that include the row itself, split
over tasks like all running statistics.  Draws are uniform numbers of a row's
own key, so a repeated or moved row gets the same draw and the result does not
hang on the layout.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.stats import Stat
from .windows import _as_list, running


def draw(key: str | Column, seed: int = 0) -> Column:
    """Uniform number in (0, 1) of an integer key, mixed so that neighbouring keys have nothing in common."""
    low = F.lit(0xFFFFFFFF)
    h = ((F.col(key) if isinstance(key, str) else key).cast("long") + F.lit(1_000_003 * (seed + 1))).bitwiseAND(low)
    for _ in range(2):
        h = (h.bitwiseXOR(F.shiftright(h, 16)) * F.lit(73_244_475)).bitwiseAND(low)
    return (h.bitwiseXOR(F.shiftright(h, 16)).cast("double") + 0.5) / 2.0**32


@F.pandas_udf(IntegerType())
def _least(rate: pd.Series, none: pd.Series, end: pd.Series, u: pd.Series) -> pd.Series:
    """The search of ``poisson`` for a whole batch; ``none`` is the chance of 0."""
    found = np.zeros(len(rate), np.int32)
    known = np.flatnonzero(rate.notna())
    r, p, last, v = (s.to_numpy(float)[known] for s in (rate, none, end, u))
    at, cdf, k = known, p, 0
    while len(at):
        k += 1
        on = (cdf < v) & (k <= last)
        at, r, p, cdf, last, v = at[on], r[on], p[on], cdf[on], last[on], v[on]
        found[at] = k
        p = p * r / k
        cdf = cdf + p
    return pd.Series(found, dtype="Int32").mask(rate.isna())


# so that neither the filter nor the explode after it computes the draws once more
_least = _least.asNondeterministic()


def poisson(rate: Column, u: Column) -> Column:
    """Poisson draw for a uniform number: the least k whose distribution function reaches it.

    The search ends 12 standard deviations above the mean, beyond any u that
    a double can tell from 1.
    """
    return _least(rate, F.exp(-rate), F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int"), u)


def class_rates(df: DataFrame, y: str, wished: Mapping, order: Sequence[str] | str) -> DataFrame:
    """``df`` with ``_ordo_ratio``: wished share over the count so far, for the row's class (own), and the least and greatest of all classes seen.

    Classes are those of ``wished``; rows of other classes and null ones get null.
    """
    order, labels = _as_list(order), sorted(wished)
    flags = {f"_ordo_g{i}": (F.col(y) == F.lit(v)).cast("double") for i, v in enumerate(labels)}
    rows = running(df.withColumns(flags), {f"{n}_s": Stat.of("sum", n) for n in flags}, by=None, order=order)
    ratios = [F.when(F.col(f"_ordo_g{i}_s") > 0, F.lit(float(wished[v])) / F.col(f"_ordo_g{i}_s")) for i, v in enumerate(labels)]
    mine, seen = F.lit(None).cast("double"), F.lit(0.0)
    for i, v in enumerate(labels):
        mine = F.when(F.col(y) == F.lit(v), ratios[i]).otherwise(mine)
        seen = seen + F.col(f"_ordo_g{i}_s")
    held = F.array_compact(F.array(*ratios))
    out = rows.withColumns({"_ordo_own": mine, "_ordo_low": F.array_min(held), "_ordo_high": F.array_max(held), "_ordo_seen": seen})
    return out.drop(*flags, *[f"{n}_s" for n in flags])


_RATES = ("_ordo_own", "_ordo_low", "_ordo_high", "_ordo_seen", "_ordo_n")


def undersample(df: DataFrame, y: str, wished: Mapping, key: str, order: Sequence[str] | str, seed: int = 0) -> DataFrame:
    """Rows of ``df``, each kept with the chance that brings its class down to ``wished``.

    The class most wanted by wished share over count is kept whole.  The
    published form settles which one that is only when a row of another class
    comes; here it is settled at every row.
    """
    rows = class_rates(df, y, wished, order)
    return rows.filter(draw(key, seed) < F.col("_ordo_own") / F.col("_ordo_high")).drop(*_RATES)


def oversample(df: DataFrame, y: str, wished: Mapping, key: str, order: Sequence[str] | str, seed: int = 0, copy: str = "copy") -> DataFrame:
    """Rows of ``df`` repeated so that every class comes up to ``wished``; ``copy`` numbers the repeats from 1.

    A row of the class least wanted comes once, others a Poisson number of times.
    """
    rows = class_rates(df, y, wished, order)
    rate = F.when(F.col("_ordo_own") > F.col("_ordo_low"), F.col("_ordo_own") / F.col("_ordo_low"))
    times = F.when(F.col("_ordo_own") <= F.col("_ordo_low"), 1).otherwise(poisson(rate, draw(key, seed)))
    return _repeated(rows.withColumn("_ordo_n", times), copy)


def resample(df: DataFrame, y: str, wished: Mapping, key: str, order: Sequence[str] | str, rate: float = 1.0, seed: int = 0, copy: str = "copy") -> DataFrame:
    """Rows of ``df`` repeated a Poisson number of times, ``rate`` times wished over actual share on average."""
    rows = class_rates(df, y, wished, order)
    times = poisson(F.lit(float(rate)) * F.col("_ordo_own") * F.col("_ordo_seen"), draw(key, seed))
    return _repeated(rows.withColumn("_ordo_n", times), copy)


def _repeated(rows: DataFrame, copy: str) -> DataFrame:
    return rows.filter("_ordo_n > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("_ordo_n")))).drop(*_RATES)


def chebyshev_oversample(df: DataFrame, y: str, order: Sequence[str] | str, by: Sequence[str] | str | None = None, copy: str = "copy") -> DataFrame:
    """Rows repeated by how many standard deviations they lie from the mean so far, rounded up; at the mean itself none.

    While there is no spread a row comes once; null targets do not come.
    """
    rows = _deviations(df, y, order, by)
    times = F.when(F.col("_ordo_sd") > 0, F.ceil(F.col("_ordo_t"))).otherwise(1).cast("int")
    return _repeated(rows.withColumn("_ordo_n", F.when(F.col(y).isNotNull(), times)), copy).drop("_ordo_sd", "_ordo_t")


def chebyshev_undersample(df: DataFrame, y: str, key: str, order: Sequence[str] | str, by: Sequence[str] | str | None = None, seed: int = 0) -> DataFrame:
    """Rows kept with chance 1 - 1 / t², t their distance from the mean so far in standard deviations; with no spread all.

    Frequent rows, which the published form lets in up to the number of rare
    ones, are left out.
    """
    rows = _deviations(df, y, order, by)
    rare = (F.col("_ordo_t") > 1) & (draw(key, seed) >= 1.0 / (F.col("_ordo_t") * F.col("_ordo_t")))
    return rows.filter(F.col(y).isNotNull() & (rare | (F.col("_ordo_sd") <= 0))).drop("_ordo_sd", "_ordo_t")


def _deviations(df: DataFrame, y: str, order: Sequence[str] | str, by) -> DataFrame:
    rows = running(df, {"_ordo_m": Stat.of("mean", y), "_ordo_sd": Stat.of("std", y)}, by=by, order=order)
    far = F.try_divide(F.abs(F.col(y) - F.col("_ordo_m")), F.col("_ordo_sd"))
    return rows.withColumn("_ordo_t", F.coalesce(far, F.lit(0.0))).drop("_ordo_m")
