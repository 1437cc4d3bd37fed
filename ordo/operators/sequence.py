"""Order-dependent running statistics built from windows, joins and sums.

Each operator is rewritten so the per-key sequential state becomes either a
sum of per-row terms (mergeable, hence splittable across blocks of a hot key)
or a short bounded frame:

* ``running_n_unique`` – exact distinct count = running sum of first-seen flags.
* ``running_entropy``  – H = ln n − S/n with S the running sum of
  c·ln c − (c−1)·ln(c−1), c the value's count at that row.
* ``running_mode``     – max over (count so far, earliest first-seen) pairs.
* ``ew_mean`` / ``ew_var`` – the exponential recurrence unrolled into
  row-number blocks of K rows; a row needs its block and the decayed totals of
  earlier blocks, sent ahead as far as doubles can tell their weight from zero.
* ``shift``, ``link``, ``autocorr``, ``mad`` – lags and nested windows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import Stat
from .windows import _as_list, _window, framed, lagged, running

_UNB = Window.unboundedPreceding


def _order_struct(order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def row_number(df: DataFrame, by, order, name: str = "_rn") -> DataFrame:
    """1-based position within the key (running count; hot keys are split)."""
    one = "_ordo_one"
    out = running(df.withColumn(one, F.lit(1.0)), {name: Stat.of("count", one)}, by=by, order=order)
    return out.drop(one)


def first_seen(df: DataFrame, on: str, by, order) -> DataFrame:
    """Append ``_first`` = whether this row is the first of its value in the key.

    The earliest position per (key, value) comes from a partial+final
    aggregate, so a hot (key, value) pair does not land in one task.
    """
    by, order = _as_list(by), _as_list(order)
    pos = "_ordo_pos"
    d = df.withColumn(pos, _order_struct(order))
    firsts = d.groupBy(*by, on).agg(F.min(pos).alias("_ordo_fpos"))
    d = d.join(firsts, [*by, on], "left")
    return d.withColumn("_first", (F.col(pos) == F.col("_ordo_fpos"))).drop(pos)


def running_n_unique(df: DataFrame, on: str, by, order, name: str | None = None) -> DataFrame:
    by = _as_list(by)
    name = name or f"{on}_n_unique"
    d = first_seen(df, on, by, order).withColumn("_ordo_flag", F.col("_first").cast("double"))
    out = running(d, {name: Stat.of("sum", "_ordo_flag")}, by=by, order=order)
    return out.withColumn(name, F.col(name).cast("long")).drop("_ordo_flag", "_first", "_ordo_fpos")


def running_entropy(df: DataFrame, on: str, by, order, name: str | None = None) -> DataFrame:
    """Natural-log entropy of the categories seen so far (alpha = 1)."""
    by, order = _as_list(by), _as_list(order)
    name = name or f"{on}_entropy"
    d = row_number(df, [*by, on], order, "_ordo_c")
    c = F.col("_ordo_c")
    term = c * F.log(c) - F.when(c > 1, (c - 1) * F.log(c - 1)).otherwise(F.lit(0.0))
    d = d.withColumn("_ordo_t", term).withColumn("_ordo_one", F.lit(1.0))
    d = running(d, {"_ordo_s": Stat.of("sum", "_ordo_t"), "_ordo_n": Stat.of("count", "_ordo_one")},
                by=by, order=order)
    n = F.col("_ordo_n").cast("double")
    h = F.log(n) - F.col("_ordo_s") / n
    return d.withColumn(name, F.greatest(h, F.lit(0.0))).drop("_ordo_c", "_ordo_t", "_ordo_one", "_ordo_s", "_ordo_n")


def running_mode(df: DataFrame, on: str, by, order, k: int = -1, name: str | None = None) -> DataFrame:
    """Most frequent value so far; ties go to the value seen first.

    All values count; ``k`` restricts that to the first ``k`` distinct ones.
    """
    by, order = _as_list(by), _as_list(order)
    name = name or f"{on}_mode"
    pos = "_ordo_pos"
    d = df.withColumn(pos, _order_struct(order))
    firsts = d.groupBy(*by, on).agg(F.min(pos).alias("_ordo_fpos"))
    if k != -1:
        wk = Window.partitionBy(*by).orderBy("_ordo_fpos") if by else Window.orderBy("_ordo_fpos")
        firsts = firsts.withColumn("_ordo_rank", F.row_number().over(wk))
    else:
        firsts = firsts.withColumn("_ordo_rank", F.lit(1))
    d = d.join(firsts, [*by, on], "left")
    d = row_number(d, [*by, on], order, "_ordo_c")
    eligible = F.col("_ordo_rank") <= F.lit(k) if k != -1 else F.lit(True)
    # larger count wins; on equal counts the earlier first-seen position wins: among the rows that
    # reach the largest count so far, the value with the least first position
    w = _window(by, order).rowsBetween(_UNB, 0)
    d = d.withColumn("_ordo_top", F.max(F.when(eligible, F.col("_ordo_c"))).over(w))
    reached = F.when(eligible & (F.col("_ordo_c") == F.col("_ordo_top")), F.struct(F.col("_ordo_fpos"), F.col(on).alias("v")))
    # a row's count is the top of its time exactly while its value leads; a new top starts a new race
    race = _window([*by, "_ordo_top"], order).rowsBetween(_UNB, 0)
    d = d.withColumn(name, F.min(reached).over(race)["v"]).drop("_ordo_top")
    return d.drop(pos, "_ordo_fpos", "_ordo_rank", "_ordo_c")


def rolling_mode(df: DataFrame, on: str, window: int, by, order, name: str | None = None) -> DataFrame:
    """Most frequent value among the last ``window`` rows; ties go to the value
    that occurs first inside the window.  Evaluated on the bounded frame's
    array with higher-order functions (JVM side, O(window^2) per row)."""
    by, order = _as_list(by), _as_list(order)
    name = name or f"{on}_rmode"
    rows, w, finish = framed(df, by, order, window)
    arr = F.collect_list(F.col(on)).over(w.rowsBetween(-(window - 1), 0))
    d = finish(rows.withColumn("_ordo_arr", arr))
    distinct = F.array_distinct(F.col("_ordo_arr"))  # keeps first-occurrence order
    counts = F.transform(distinct, lambda v: F.size(F.filter(F.col("_ordo_arr"), lambda a: a == v)))
    d = d.withColumn("_ordo_d", distinct).withColumn("_ordo_n", counts)
    pick = F.element_at(F.col("_ordo_d"), F.array_position(F.col("_ordo_n"), F.array_max(F.col("_ordo_n"))).cast("int"))
    return d.withColumn(name, pick).drop("_ordo_arr", "_ordo_d", "_ordo_n")


def shift(df: DataFrame, on: str, by, order, amount: int = 1, fill=None, name: str | None = None) -> DataFrame:
    by, order = _as_list(by), _as_list(order)
    name = name or f"{on}_shift_{amount}"
    return lagged(df, {name: (F.col(on), amount, fill)}, by, order)


def link(df: DataFrame, on: str, by, order, left: str, right: str, amount: int = 1, name: str | None = None,
         **params) -> DataFrame:
    """Compose statistics: ``right`` over the output of ``left``.

    ``left`` is ``"shift"`` (lag by ``amount``) or any running statistic;
    missing left values are skipped by the right statistic, as aggregates
    skip NULL.
    """
    by, order = _as_list(by), _as_list(order)
    name = name or f"{on}_{left}_{right}"
    tmp = "_ordo_left"
    if left == "shift":
        d = lagged(df, {tmp: (F.col(on), amount, None)}, by, order)
    else:
        d = running(df, {tmp: Stat.of(left, on)}, by=by, order=order)
    d = running(d, {name: Stat.of(right, tmp, **params)}, by=by, order=order)
    return d.drop(tmp)


def autocorr(df: DataFrame, on: str, by, order, lag: int = 1, name: str | None = None) -> DataFrame:
    """Running Pearson correlation between x_t and x_(t-lag)."""
    by, order = _as_list(by), _as_list(order)
    name = name or f"{on}_autocorr_{lag}"
    tmp = "_ordo_lagged"
    d = lagged(df, {tmp: (F.col(on), lag, None)}, by, order)
    d = running(d, {name: Stat.of("pearson", on, tmp)}, by=by, order=order)
    return d.drop(tmp)


def _ew_block_size(alpha: float) -> int:
    """Rows of a block: weights fall to about 2^-60 within it."""
    r = 1.0 - alpha
    if r <= 0.0:
        return 1
    return max(2, int(math.ceil(60 * math.log(2) / -math.log(r))) + 1)


def _ew_reach(alpha: float, block: int) -> int:
    """Blocks after which a weight times any double is zero in doubles (2^1024 * 2^-2100)."""
    r = 1.0 - alpha
    return 1 if r <= 0.0 else int(math.ceil(2100 * math.log(2) / (-math.log(r) * block))) + 1


def _ew_columns(df: DataFrame, cols: dict[str, Column], by, order, alpha: float, restart_at_zero: bool = True) -> DataFrame:
    """Append the exponentially weighted mean of each expression in ``cols``.

    ``restart_at_zero``: leading zeros do not start the mean, the first other
    value does with full weight.
    """
    by, order = _as_list(by), _as_list(order)
    r = 1.0 - alpha
    K = _ew_block_size(alpha)
    d = row_number(df, by, order, "_ordo_rn")
    rn = F.col("_ordo_rn")
    starts = {f"_ordo_f{i}": F.lit(1) for i in range(len(cols))}
    if restart_at_zero:
        first = d.groupBy(*by).agg(*[F.min(F.when(e != 0, rn)).alias(f) for f, e in zip(starts, cols.values(), strict=True)])
        d = d.join(first, by, "left") if by else d.crossJoin(F.broadcast(first))  # keyless: one row
        starts = {f: F.coalesce(F.col(f), F.lit(1)) for f in starts}
    d = d.withColumn("_ordo_b", F.floor((rn - 1) / K).cast("long"))
    d = d.withColumn("_ordo_off", rn - 1 - F.col("_ordo_b") * K)  # 0..K-1 inside the block
    # weights as of the block's last row: at most 1, so that no value overflows
    last = F.lit(K - 1)
    yk = {
        f"_ordo_y{i}": F.when(rn == start, F.lit(1.0)).otherwise(F.lit(alpha)) * expr * F.pow(F.lit(r), last - F.col("_ordo_off"))
        for i, (expr, start) in enumerate(zip(cols.values(), starts.values(), strict=True))
    }
    d = d.withColumns(yk)
    keys = [*by, "_ordo_b"]
    # a block's total, decayed, for each later block that can tell it from zero
    tot = d.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in yk])
    ahead = F.explode(F.sequence(F.lit(1), F.lit(_ew_reach(alpha, K)))).alias("_ordo_j")
    tot = tot.select(*keys, *yk, ahead)
    decay = F.pow(F.lit(r), (F.col("_ordo_j") - 1) * F.lit(K))
    tot = tot.groupBy(*by, (F.col("_ordo_b") + F.col("_ordo_j")).alias("_ordo_b")).agg(
        *[F.sum(F.col(c) * decay).alias(f"{c}_tot") for c in yk])
    d = d.join(tot, keys, "left")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(_UNB, 0)
    outs = {}
    for i, out in enumerate(cols):
        y = f"_ordo_y{i}"
        cur = F.sum(y).over(w) * F.pow(F.lit(r), F.col("_ordo_off") - last)
        prev = F.coalesce(F.col(f"{y}_tot"), F.lit(0.0)) * F.pow(F.lit(r), F.col("_ordo_off") + 1)
        outs[out] = cur + prev
    d = d.withColumns(outs)
    drop = ["_ordo_rn", "_ordo_b", "_ordo_off", *yk, *[f"{c}_tot" for c in yk], *[f"_ordo_f{i}" for i in range(len(cols))]]
    return d.drop(*drop)


def ew_mean(df: DataFrame, on: str, by, order, alpha: float = 0.5, name: str | None = None) -> DataFrame:
    """m = alpha*x + (1-alpha)*m, initialised with the first value."""
    name = name or f"{on}_ewm_{alpha}"
    return _ew_columns(df, {name: F.col(on).cast("double")}, by, order, alpha)


def ew_var(df: DataFrame, on: str, by, order, alpha: float = 0.5, name: str | None = None) -> DataFrame:
    """EW mean of x^2 minus the square of the EW mean of x."""
    name = name or f"{on}_ewv_{alpha}"
    x = F.col(on).cast("double")
    d = _ew_columns(df, {"_ordo_m1": x, "_ordo_m2": x * x}, by, order, alpha)
    return d.withColumn(name, F.col("_ordo_m2") - F.col("_ordo_m1") ** 2).drop("_ordo_m1", "_ordo_m2")


def mad(df: DataFrame, on: str, by, order, name: str | None = None) -> DataFrame:
    """Running median of |x - running median (including x)|; exact medians."""
    by, order = _as_list(by), _as_list(order)
    name = name or f"{on}_mad"
    w = _window(by, order).rowsBetween(_UNB, 0)
    d = df.withColumn("_ordo_med", F.percentile(F.col(on), F.lit(0.5)).over(w))
    d = d.withColumn("_ordo_dev", F.abs(F.col(on) - F.col("_ordo_med")))
    d = d.withColumn(name, F.percentile(F.col("_ordo_dev"), F.lit(0.5)).over(w))
    return d.drop("_ordo_med", "_ordo_dev")


def running_stat(df: DataFrame, on: str, how: str, by, order, name: str | None = None, lagged: bool = False,
                 **params) -> DataFrame:
    """Convenience: any registered statistic as a running column."""
    name = name or f"{on}_{how}"
    return running(df, {name: Stat.of(how, on, **params)}, by=by, order=order, lagged=lagged)


__all__: Sequence[str] = [
    "row_number", "first_seen", "rolling_mode", "running_n_unique", "running_entropy", "running_mode", "shift", "link",
    "autocorr", "ew_mean", "ew_var", "mad", "running_stat",
]
