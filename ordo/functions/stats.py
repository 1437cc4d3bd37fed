"""Aggregate specifications: one statistic, every shape.

An ``AggSpec`` describes a statistic once.  ``native`` builds it from Spark
aggregate functions; the caller decides whether those aggregates run in a
``groupBy`` (``bind`` = identity) or over a window frame
(``bind`` = ``lambda a: a.over(w)``).  ``merged`` builds the same value from
merged partial states (count, sum, mean, M2, min, max, co-moment), which is
how hot keys are split into blocks and recombined.  ``empty`` is the value a
statistic reports before it has seen anything.

A ``Stat`` binds a spec to input column names and parameters, e.g.
``Stat.of("var", "value", ddof=0)``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Bind = Callable[[Column], Column]


def ident(c: Column) -> Column:
    return c


def safe_div(num: Column, den: Column) -> Column:
    """num/den, 0.0 when den is 0 or NULL (never raises under ANSI)."""
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


@dataclass(frozen=True)
class Moments:
    """Merged partial state of one column (Columns, NULL-free after merge)."""

    rows: Column
    n: Column
    s: Column
    mean: Column
    m2: Column
    mn: Column
    mx: Column


@dataclass(frozen=True)
class CoMoments:
    """Merged partial state of a column pair over rows where both are set."""

    n: Column
    mean_x: Column
    mean_y: Column
    m2x: Column
    m2y: Column
    c: Column


@dataclass(frozen=True)
class AggSpec:
    name: str
    arity: int
    native: Callable[..., Column]  # (cols, bind, **params) -> Column
    empty: Any = None
    merged: Callable[..., Column] | None = None  # (state, **params) -> Column


@dataclass(frozen=True)
class Stat:
    """A spec bound to input columns and parameters."""

    spec: AggSpec
    cols: tuple[str, ...]
    params: dict = field(default_factory=dict)

    @staticmethod
    def of(how: str, *cols: str, **params) -> Stat:
        spec = SPECS[how]
        if len(cols) != spec.arity:
            raise ValueError(f"{how} takes {spec.arity} input column(s)")
        return Stat(spec, tuple(cols), dict(params))

    @property
    def mergeable(self) -> bool:
        return self.spec.merged is not None

    def native(self, bind: Bind = ident) -> Column:
        col = self.spec.native([F.col(c) for c in self.cols], bind, **self.params)
        return self._fill(col)

    def from_state(self, state) -> Column:
        return self._fill(self.spec.merged(state, **self.params))

    def _fill(self, col: Column) -> Column:
        if self.spec.empty is None:
            return col
        return F.coalesce(col, F.lit(self.spec.empty))

    @property
    def how(self) -> str:
        return self.spec.name


# ---------------------------------------------------------------- helpers

def _var_native(x: Column, bind: Bind, ddof: int = 1) -> Column:
    n = bind(F.count(x))
    if ddof == 1:
        v = bind(F.var_samp(x))
    elif ddof == 0:
        v = bind(F.var_pop(x))
    else:
        v = bind(F.var_pop(x)) * n / (n - F.lit(ddof))
    return F.when(n > F.lit(ddof), v).otherwise(F.lit(0.0))


def _var_merged(st: Moments, ddof: int = 1) -> Column:
    return F.when(st.n > F.lit(ddof), st.m2 / (st.n - F.lit(ddof))).otherwise(F.lit(0.0))


def _skew_bias(g: Column, n: Column, bias: bool) -> Column:
    return g if bias else F.when(n > 2, F.sqrt((n - 1) * n) / (n - 2) * g).otherwise(g)


def _kurt_bias(raw: Column, n: Column, bias: bool) -> Column:
    if bias:
        return raw - 3
    corrected = ((n * n - 1) * raw - 3 * (n - 1) * (n - 1)) / ((n - 2) * (n - 3))
    return F.when(n > 3, corrected).otherwise(raw - 3)


def _skew_native(x: Column, bind: Bind, bias: bool = False) -> Column:
    n = bind(F.count(x)).cast("double")
    g = F.when(bind(F.var_pop(x)) == 0, F.lit(0.0)).otherwise(F.coalesce(bind(F.skewness(x)), F.lit(0.0)))
    return _skew_bias(g, n, bias)


def _kurt_native(x: Column, bind: Bind, bias: bool = False) -> Column:
    n = bind(F.count(x)).cast("double")
    # Spark's kurtosis is the biased excess form; raw = excess + 3
    raw = F.when(bind(F.var_pop(x)) == 0, F.lit(0.0)).otherwise(F.coalesce(bind(F.kurtosis(x)), F.lit(-3.0)) + 3)
    return _kurt_bias(raw, n, bias)


def shape_from_sums(stat: Stat, sums: list[Column], flat: Column) -> Column:
    """Skewness or kurtosis from sums of the powers 0 to 4 around any number near the mean; ``flat``: all values equal."""
    n, s1, s2, s3, s4 = sums
    m = F.try_divide(s1, n)
    m2 = s2 - n * m * m
    m3 = s3 - 3 * m * s2 + 2 * n * m * m * m
    m4 = s4 - 4 * m * s3 + 6 * m * m * s2 - 3 * n * m * m * m * m
    none = flat | (n == 0) | (m2 <= 0)
    bias = stat.params.get("bias", False)
    if stat.how == "skew":
        g = F.when(none, 0.0).otherwise(F.sqrt(n) * m3 / F.pow(m2, F.lit(1.5)))
        return F.coalesce(_skew_bias(g, n, bias), F.lit(0.0))
    raw = F.when(none, 0.0).otherwise(n * m4 / (m2 * m2))
    return F.coalesce(_kurt_bias(raw, n, bias), F.lit(-3.0))


def _cov_native(x: Column, y: Column, bind: Bind, ddof: int) -> Column:
    both = x.isNotNull() & y.isNotNull()
    n = bind(F.count(F.when(both, F.lit(1))))
    c = bind(F.covar_pop(x, y)) * n
    return F.coalesce(c / F.greatest(F.lit(1), n - F.lit(ddof)), F.lit(0.0))


def _cov_merged(st: CoMoments, ddof: int = 1) -> Column:
    return st.c / F.greatest(F.lit(1), st.n - F.lit(ddof))


def _corr_native(x: Column, y: Column, bind: Bind) -> Column:
    both = x.isNotNull() & y.isNotNull()
    xs = F.when(both, x)
    ys = F.when(both, y)
    vx = bind(F.var_pop(xs))
    vy = bind(F.var_pop(ys))
    c = bind(F.covar_pop(x, y))
    # 0 when either variance is 0 (native corr would raise under ANSI)
    return F.when((vx > 0) & (vy > 0), c / F.sqrt(vx * vy)).otherwise(F.lit(0.0))


def _corr_merged(st: CoMoments) -> Column:
    return F.when((st.m2x > 0) & (st.m2y > 0), st.c / F.sqrt(st.m2x * st.m2y)).otherwise(F.lit(0.0))


def _quantile_native(x: Column, bind: Bind, q: float = 0.5) -> Column:
    return bind(F.percentile(x, F.lit(float(q))))


def _iqr_native(x: Column, bind: Bind, q_inf: float = 0.25, q_sup: float = 0.75) -> Column:
    return bind(F.percentile(x, F.lit(float(q_sup)))) - bind(F.percentile(x, F.lit(float(q_inf))))


def _bayes_mean_native(x: Column, bind: Bind, prior: float, prior_weight: float) -> Column:
    n = bind(F.count(x))
    s = F.coalesce(bind(F.sum(x)), F.lit(0.0))
    return (s + F.lit(float(prior * prior_weight))) / (n + F.lit(float(prior_weight)))


def _bayes_mean_merged(st: Moments, prior: float, prior_weight: float) -> Column:
    return (st.s + F.lit(float(prior * prior_weight))) / (st.n + F.lit(float(prior_weight)))


INF = math.inf

# ---------------------------------------------------------------- registry

SPECS: dict[str, AggSpec] = {
    s.name: s
    for s in [
        AggSpec("count", 1, lambda c, b: b(F.count(F.lit(1))), 0, lambda st: st.rows),
        AggSpec("sum", 1, lambda c, b: b(F.sum(c[0])).cast("double"), 0.0, lambda st: st.s),
        AggSpec("mean", 1, lambda c, b: b(F.avg(c[0])), 0.0,
                lambda st: F.when(st.n > 0, st.mean)),
        AggSpec("bayes_mean", 1, lambda c, b, prior, prior_weight: _bayes_mean_native(c[0], b, prior, prior_weight),
                None, _bayes_mean_merged),
        AggSpec("var", 1, lambda c, b, ddof=1: _var_native(c[0], b, ddof), 0.0, _var_merged),
        AggSpec("std", 1, lambda c, b, ddof=1: F.sqrt(_var_native(c[0], b, ddof)), 0.0,
                lambda st, ddof=1: F.sqrt(_var_merged(st, ddof))),
        AggSpec("sem", 1, lambda c, b, ddof=1: F.sqrt(F.try_divide(_var_native(c[0], b, ddof), b(F.count(c[0])))),
                None, lambda st, ddof=1: F.sqrt(F.try_divide(_var_merged(st, ddof), st.n))),
        AggSpec("min", 1, lambda c, b: b(F.min(c[0])).cast("double"), INF, lambda st: st.mn),
        AggSpec("max", 1, lambda c, b: b(F.max(c[0])).cast("double"), -INF, lambda st: st.mx),
        AggSpec("abs_max", 1, lambda c, b: b(F.max(F.abs(c[0]))).cast("double"), 0.0,
                lambda st: F.greatest(F.abs(st.mn), F.abs(st.mx))),
        AggSpec("ptp", 1, lambda c, b: (b(F.max(c[0])) - b(F.min(c[0]))).cast("double"), -INF,
                lambda st: st.mx - st.mn),
        AggSpec("skew", 1, lambda c, b, bias=False: _skew_native(c[0], b, bias), 0.0),
        AggSpec("kurtosis", 1, lambda c, b, bias=False: _kurt_native(c[0], b, bias), -3.0),
        AggSpec("quantile", 1, lambda c, b, q=0.5: _quantile_native(c[0], b, q), None),
        AggSpec("iqr", 1, lambda c, b, q_inf=0.25, q_sup=0.75: _iqr_native(c[0], b, q_inf, q_sup), None),
        AggSpec("approx_quantile", 1,
                lambda c, b, q=0.5, accuracy=10000: b(F.percentile_approx(c[0], float(q), accuracy)).cast("double"),
                None),
        AggSpec("n_unique_approx", 1, lambda c, b, rsd=0.01: b(F.approx_count_distinct(c[0], rsd)), 0),
        AggSpec("cov", 2, lambda c, b, ddof=1: _cov_native(c[0], c[1], b, ddof), 0.0, _cov_merged),
        AggSpec("pearson", 2, lambda c, b: _corr_native(c[0], c[1], b), 0.0, _corr_merged),
    ]
}


def stat_names() -> list[str]:
    return sorted(SPECS)
