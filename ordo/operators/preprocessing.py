"""Stateful transformers as running windows, plus row-wise scalers.

An unsupervised step learns from a row before transforming it, so every
running statistic here includes the current row.  Divisions follow the
"0 when the denominator is 0" rule and never raise under ANSI mode.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import Stat
from . import sequence
from .windows import _as_list, _window, running

_UNB = Window.unboundedPreceding


def safe_div(a: Column, b: Column) -> Column:
    return F.when(F.coalesce(b, F.lit(0.0)) != 0, a / b).otherwise(F.lit(0.0))


# ------------------------------------------------------------- imputation

def impute_previous(df: DataFrame, cols: Sequence[str], by, order) -> DataFrame:
    """Replace NULL by the last non-NULL value of the key so far (else NULL)."""
    w = _window(_as_list(by), _as_list(order)).rowsBetween(_UNB, 0)
    return df.withColumns({c: F.last(F.col(c), ignorenulls=True).over(w) for c in cols})


def impute_stat(df: DataFrame, cols: Sequence[str], by, order, how: str = "mean", value=None, **params) -> DataFrame:
    """Replace NULL by a running statistic of the non-NULL values seen so far,
    or by a constant ``value``.  Statistics skip NULLs, as only non-NULL
    values update the imputer."""
    if value is not None:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in cols})
    tmp = {f"_ordo_imp_{c}": Stat.of(how, c, **params) for c in cols}
    d = running(df, tmp, by=by, order=order)
    d = d.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_ordo_imp_{c}")) for c in cols})
    return d.drop(*tmp)


# ---------------------------------------------------------------- scalers

def standard_scale(df: DataFrame, cols: Sequence[str], by, order, with_std: bool = True) -> DataFrame:
    """(x - running mean) / running population std, 0 when std is 0."""
    tmp = {}
    for c in cols:
        tmp[f"_ordo_m_{c}"] = Stat.of("mean", c)
        tmp[f"_ordo_v_{c}"] = Stat.of("var", c, ddof=0)
    d = running(df, tmp, by=by, order=order)
    out = {}
    for c in cols:
        centred = F.col(c) - F.col(f"_ordo_m_{c}")
        out[c] = safe_div(centred, F.sqrt(F.col(f"_ordo_v_{c}"))) if with_std else centred
    return d.withColumns(out).drop(*tmp)


def minmax_scale(df: DataFrame, cols: Sequence[str], by, order) -> DataFrame:
    tmp = {}
    for c in cols:
        tmp[f"_ordo_lo_{c}"] = Stat.of("min", c)
        tmp[f"_ordo_hi_{c}"] = Stat.of("max", c)
    d = running(df, tmp, by=by, order=order)
    out = {c: safe_div(F.col(c) - F.col(f"_ordo_lo_{c}"), F.col(f"_ordo_hi_{c}") - F.col(f"_ordo_lo_{c}")) for c in cols}
    return d.withColumns(out).drop(*tmp)


def maxabs_scale(df: DataFrame, cols: Sequence[str], by, order) -> DataFrame:
    tmp = {f"_ordo_am_{c}": Stat.of("abs_max", c) for c in cols}
    d = running(df, tmp, by=by, order=order)
    return d.withColumns({c: safe_div(F.col(c), F.col(f"_ordo_am_{c}")) for c in cols}).drop(*tmp)


def robust_scale(df: DataFrame, cols: Sequence[str], by, order, with_centering: bool = True,
                 with_scaling: bool = True, q_inf: float = 0.25, q_sup: float = 0.75) -> DataFrame:
    """(x - running median) / running (q_sup - q_inf) with exact quantiles."""
    tmp = {}
    for c in cols:
        tmp[f"_ordo_med_{c}"] = Stat.of("quantile", c, q=0.5)
        tmp[f"_ordo_iqr_{c}"] = Stat.of("iqr", c, q_inf=q_inf, q_sup=q_sup)
    d = running(df, tmp, by=by, order=order)
    out = {}
    for c in cols:
        x = F.col(c).cast("double")
        if with_centering:
            x = x - F.col(f"_ordo_med_{c}")
        if with_scaling:
            x = safe_div(x, F.col(f"_ordo_iqr_{c}"))
        out[c] = x
    return d.withColumns(out).drop(*tmp)


def ew_standard_scale(df: DataFrame, cols: Sequence[str], by, order, alpha: float = 0.3) -> DataFrame:
    """(x - EW mean) / sqrt(EW variance), 0 when the variance is 0."""
    d = df
    for c in cols:
        d = sequence.ew_mean(d, c, by, order, alpha, name=f"_ordo_em_{c}")
        d = sequence.ew_var(d, c, by, order, alpha, name=f"_ordo_ev_{c}")
    out = {c: safe_div(F.col(c) - F.col(f"_ordo_em_{c}"), F.sqrt(F.greatest(F.col(f"_ordo_ev_{c}"), F.lit(0.0))))
           for c in cols}
    return d.withColumns(out).drop(*[f"_ordo_em_{c}" for c in cols], *[f"_ordo_ev_{c}" for c in cols])


def binarize(df: DataFrame, cols: Sequence[str], threshold: float = 0.0, dtype: str = "boolean") -> DataFrame:
    return df.withColumns({c: (F.col(c) > F.lit(threshold)).cast(dtype) for c in cols})


def normalize_row(df: DataFrame, cols: Sequence[str], order: float = 2) -> DataFrame:
    """Divide the row's features by their L-``order`` norm."""
    if order == math.inf:
        norm = F.greatest(*[F.abs(F.col(c)) for c in cols])
    elif order == 1:
        norm = sum((F.abs(F.col(c)) for c in cols), F.lit(0.0))
    elif order == 2:
        norm = F.sqrt(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0)))
    else:
        norm = F.pow(sum((F.pow(F.abs(F.col(c)), F.lit(float(order))) for c in cols), F.lit(0.0)), F.lit(1.0 / order))
    d = df.withColumn("_ordo_norm", norm)
    return d.withColumns({c: F.try_divide(F.col(c), F.col("_ordo_norm")) for c in cols}).drop("_ordo_norm")


def clip(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """Clamp predictions into [lo, hi]."""
    return df.withColumn(col, F.least(F.greatest(F.col(col), F.lit(lo)), F.lit(hi)))


def target_standardize(df: DataFrame, y: str, by, order, name: str | None = None, inverse: str | None = None) -> DataFrame:
    """Target scaled for training: mean and sample std include the current row.

    ``inverse`` names a column of scaled predictions; it is mapped back with
    the statistics of the rows before (what is known when predicting).
    """
    name = name or f"{y}_scaled"
    stats = {"_ordo_ym": Stat.of("mean", y), "_ordo_yv": Stat.of("var", y, ddof=1)}
    d = running(df, stats, by=by, order=order)
    d = d.withColumn(name, safe_div(F.col(y) - F.col("_ordo_ym"), F.sqrt(F.col("_ordo_yv")))).drop(*stats)
    if inverse:
        d = running(d, stats, by=by, order=order, lagged=True)
        back = F.col(inverse) * F.sqrt(F.coalesce("_ordo_yv", F.lit(0.0))) + F.coalesce("_ordo_ym", F.lit(0.0))
        d = d.withColumn(f"{inverse}_unscaled", back).drop(*stats)
    return d
