"""Shapes of a statistic over an ordered, optionally keyed table.

* ``grouped``      – one row per key (``groupBy().agg``), partial+final agg.
* ``running``      – value as of every row, current row included
                     (``lagged=True`` excludes it: supervised/target use).
* ``rolling``      – last ``window`` rows per key (ROWS frame).
* ``time_rolling`` – rows with ``t - period < t_row <= t`` (exclusive lower
                     bound, RANGE frame on a microsecond image of the time).

Running shapes split hot keys (and the key-less case) into order-range
blocks when every requested statistic is mergeable: in-block windows run in
parallel, block partials get a tiny per-key prefix, and the two are merged
with Chan's formulas.  Skewness and kurtosis are sums of powers around the
mean of a hot key's rows.  Nothing is sent to the driver but quantile cut
points.

Rolling shapes and lags cut hot keys (and the key-less case) into blocks of a
fixed number of rows, each with the rows before it that its own look back to.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.stats import CoMoments, Moments, Stat, shape_from_sums
from ..plans import rows as R
from ..plans.blocks import BLOCK, HOT, ROWS_PER_TASK, assign_blocks, hot_keys, order_number
from ..plans.session import CONF_BROADCAST_ROWS, CONF_HOT_ROWS, conf_int

Outputs = Mapping[str, Stat]
_UNB = Window.unboundedPreceding


def _as_list(v) -> list[str]:
    if v is None:
        return []
    if isinstance(v, str):
        return [v]
    return list(v)


def grouped(df: DataFrame, outputs: Outputs, by: Sequence[str] | str | None = None) -> DataFrame:
    """One row per group (or one row overall when ``by`` is empty)."""
    by = _as_list(by)
    exprs = [stat.native().alias(name) for name, stat in outputs.items()]
    return df.groupBy(*by).agg(*exprs) if by else df.agg(*exprs)


def _window(by: list[str], order: list[str]):
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return w.orderBy(*order)


def running(
    df: DataFrame,
    outputs: Outputs,
    by: Sequence[str] | str | None = None,
    order: Sequence[str] | str = (),
    lagged: bool = False,
    blocks: int | None = None,
    split_hot: bool = True,
) -> DataFrame:
    """Append each statistic as of every row (``lagged``: rows strictly before)."""
    by, order = _as_list(by), _as_list(order)
    if not order:
        raise ValueError("running statistics need an order column")
    end = -1 if lagged else 0
    mergeable = all(s.mergeable for s in outputs.values())
    if split_hot and not mergeable and all(s.mergeable or s.how in ("skew", "kurtosis") for s in outputs.values()):
        if not by or hot_keys(df, by) is not None:
            return _running_shape(df, outputs, by, order, lagged, blocks)
    if split_hot and mergeable:
        tagged, pairs = assign_blocks(df, by, order[0], blocks)
        if pairs:
            return _blocked_running(tagged, outputs, by, order, end, pairs)
    if not by and not mergeable:
        raise ValueError(
            "key-less running statistic that is not mergeable would run in one task; "
            "supply a key or use a mergeable statistic"
        )
    w = _window(by, order).rowsBetween(_UNB, end)
    return df.withColumns({name: stat.native(lambda a: a.over(w)) for name, stat in outputs.items()})


def _running_shape(df: DataFrame, outputs: Outputs, by: list[str], order: list[str], lagged: bool, blocks: int | None) -> DataFrame:
    """Running statistics with skewness or kurtosis among them, from running sums of powers around one number.

    That number is the mean of all hot rows, so the sums lose little to
    cancellation unless the means of hot keys are far apart for their spread.
    """
    shapes = {name: stat for name, stat in outputs.items() if not stat.mergeable}
    hot = hot_keys(df, by) if by else None
    rows = df.join(hot[0], by, "left_semi") if hot else df
    columns = sorted({stat.cols[0] for stat in shapes.values()})
    centres = rows.agg(*[F.avg(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    sums: dict[str, Stat] = {name: stat for name, stat in outputs.items() if stat.mergeable}
    powers = {}
    for i, c in enumerate(columns):
        x = F.col(c).cast("double") - F.lit(float(centres[i] or 0.0))
        for k in range(1, 5):
            powers[f"_ordo_x{i}_{k}"] = F.pow(x, F.lit(float(k)))
            sums[f"_ordo_s{i}_{k}"] = Stat.of("sum", f"_ordo_x{i}_{k}")
        powers[f"_ordo_x{i}_0"] = F.when(x.isNotNull(), 1.0)
        sums[f"_ordo_s{i}_0"] = Stat.of("sum", f"_ordo_x{i}_0")
        sums[f"_ordo_s{i}_lo"], sums[f"_ordo_s{i}_hi"] = Stat.of("min", c), Stat.of("max", c)
    out = running(df.withColumns(powers), sums, by, order, lagged, blocks)
    final = {}
    for name, stat in shapes.items():
        tag = f"_ordo_s{columns.index(stat.cols[0])}"
        flat = F.col(f"{tag}_lo") >= F.col(f"{tag}_hi")
        final[name] = shape_from_sums(stat, [F.col(f"{tag}_{k}") for k in range(5)], flat)
    keep = [c for c in df.columns if c not in outputs]
    return out.withColumns(final).select(*keep, *outputs)


def framed(df: DataFrame, by: Sequence[str], order: Sequence[str], before: int) -> tuple[DataFrame, WindowSpec, Callable[[DataFrame], DataFrame]]:
    """(rows, window, finish) for frames that look back at most ``before`` rows of a key.

    ``window`` orders the rows of a key; where a key is hot, or there is none,
    it orders those of a block of it, which holds the rows that its own look
    back to, and ``finish`` drops these again.
    """
    if by and hot_keys(df, by) is None:
        return df, Window.partitionBy(*by).orderBy(*order), lambda d: d
    size = max(conf_int(df.sparkSession, CONF_HOT_ROWS, ROWS_PER_TASK), before, 1)
    cut = R.overlapping(R.placed(df, by, order), size, before)
    return cut, Window.partitionBy(*by, R.BLOCK).orderBy(R.PLACE), lambda d: R.own(d, size).drop(R.BLOCK, R.PLACE)


def lagged(df: DataFrame, lags: Mapping[str, tuple[Column, int, object]], by: Sequence[str] | str | None, order: Sequence[str] | str) -> DataFrame:
    """Append columns of earlier rows of the key: name -> (expression, rows back, value where there is no such row)."""
    by, order = _as_list(by), _as_list(order)
    rows, w, finish = framed(df, by, order, max((n for _, n, _ in lags.values()), default=0))
    return finish(rows.withColumns({name: F.lag(c, n, fill).over(w) for name, (c, n, fill) in lags.items()}))


def rolling(
    df: DataFrame,
    outputs: Outputs,
    window: int,
    by: Sequence[str] | str | None = None,
    order: Sequence[str] | str = (),
    lagged: bool = False,
) -> DataFrame:
    """Statistic over the last ``window`` rows of each key (ROWS frame)."""
    by, order = _as_list(by), _as_list(order)
    rows, w, finish = framed(df, by, order, window)
    w = w.rowsBetween(-window, -1) if lagged else w.rowsBetween(-(window - 1), 0)
    return finish(rows.withColumns({name: stat.native(lambda a: a.over(w)) for name, stat in outputs.items()}))


def time_image(df: DataFrame, time_col: str) -> Column:
    """Microseconds since the epoch without any time-zone shift."""
    return order_number(df, time_col)


def time_rolling(
    df: DataFrame,
    outputs: Outputs,
    period_us: int,
    time_col: str,
    by: Sequence[str] | str | None = None,
) -> DataFrame:
    """Statistic over ``(t - period, t]`` per key.

    RANGE frames are inclusive on both ends, so the lower bound is moved in by
    one microsecond on an integer time image.  Rows sharing a timestamp are
    peers and see each other (documented difference from arrival order).
    """
    by = _as_list(by)
    tcol = "_ordo_t_us"
    d = df.withColumn(tcol, time_image(df, time_col))
    if by and hot_keys(df, by) is None:
        w = _window(by, [tcol]).rangeBetween(-(period_us - 1), 0)
        return d.withColumns({name: stat.native(lambda a: a.over(w)) for name, stat in outputs.items()}).drop(tcol)
    size = conf_int(df.sparkSession, CONF_HOT_ROWS, ROWS_PER_TASK)
    cut = R.overlapping_time(R.placed(d, by, [tcol]), by, tcol, size, period_us)
    w = Window.partitionBy(*by, R.BLOCK).orderBy(tcol).rangeBetween(-(period_us - 1), 0)
    cut = cut.withColumns({name: stat.native(lambda a: a.over(w)) for name, stat in outputs.items()})
    return cut.filter(R.OWN).drop(R.BLOCK, R.PLACE, R.OWN, tcol)


# ------------------------------------------------------------ blocked path

def _moment_inputs(outputs: Outputs) -> tuple[list[str], list[tuple[str, str]]]:
    singles: list[str] = []
    pairs: list[tuple[str, str]] = []
    for stat in outputs.values():
        if stat.spec.arity == 1:
            if stat.cols[0] not in singles:
                singles.append(stat.cols[0])
        else:
            pair = (stat.cols[0], stat.cols[1])
            if pair not in pairs:
                pairs.append(pair)
    return singles, pairs


def _single_aggs(x: str, tag: str) -> dict[str, Column]:
    c = F.col(x).cast("double")
    n = F.count(c)
    return {
        f"{tag}_r": F.count(F.lit(1)),
        f"{tag}_n": n,
        f"{tag}_s": F.coalesce(F.sum(c), F.lit(0.0)),
        f"{tag}_m": F.avg(c),
        f"{tag}_q": F.coalesce(F.var_pop(c) * n, F.lit(0.0)),
        f"{tag}_lo": F.min(c),
        f"{tag}_hi": F.max(c),
    }


def _pair_aggs(x: str, y: str, tag: str) -> dict[str, Column]:
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    both = cx.isNotNull() & cy.isNotNull()
    xs, ys = F.when(both, cx), F.when(both, cy)
    n = F.count(F.when(both, F.lit(1)))
    return {
        f"{tag}_n": n,
        f"{tag}_mx": F.avg(xs),
        f"{tag}_my": F.avg(ys),
        f"{tag}_qx": F.coalesce(F.var_pop(xs) * n, F.lit(0.0)),
        f"{tag}_qy": F.coalesce(F.var_pop(ys) * n, F.lit(0.0)),
        f"{tag}_c": F.coalesce(F.covar_pop(xs, ys) * n, F.lit(0.0)),
    }


def _merge_mean(n_a, m_a, n_b, m_b):
    n = n_a + n_b
    return F.when(n_b == 0, m_a).when(n_a == 0, m_b).otherwise(m_a + (m_b - m_a) * n_b / n)


def _blocked_running(d: DataFrame, outputs: Outputs, by: list[str], order: list[str], end: int,
                     max_rows: int) -> DataFrame:
    spark = d.sparkSession
    keys = by + [BLOCK]
    singles, pairs = _moment_inputs(outputs)
    stags = {x: f"_s{i}" for i, x in enumerate(singles)}
    ptags = {p: f"_p{i}" for i, p in enumerate(pairs)}

    # 1. partial state per (key, block) for hot rows only
    aggs: dict[str, Column] = {}
    for x, t in stags.items():
        aggs.update(_single_aggs(x, t))
    for (x, y), t in ptags.items():
        aggs.update(_pair_aggs(x, y, t))
    part = d.filter(F.col(HOT)).groupBy(*keys).agg(*[v.alias(k) for k, v in aggs.items()])

    # 2. prefix over earlier blocks of the same key (tiny table)
    wk = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(BLOCK)
    wp = wk.rowsBetween(_UNB, -1)
    wall = wk.rowsBetween(_UNB, Window.unboundedFollowing)
    pre: dict[str, Column] = {}
    for t in stags.values():
        shift = F.first(F.col(f"{t}_m"), ignorenulls=True).over(wall)
        n_p = F.coalesce(F.sum(f"{t}_n").over(wp), F.lit(0))
        s_p = F.coalesce(F.sum(f"{t}_s").over(wp), F.lit(0.0))
        mean_p = F.try_divide(s_p, n_p)
        dev = F.coalesce(F.col(f"{t}_m") - shift, F.lit(0.0))
        q_p = (
            F.coalesce(F.sum(f"{t}_q").over(wp), F.lit(0.0))
            + F.coalesce(F.sum(F.col(f"{t}_n") * dev * dev).over(wp), F.lit(0.0))
            - F.coalesce(n_p * (mean_p - shift) * (mean_p - shift), F.lit(0.0))
        )
        pre.update({
            f"{t}_Pr": F.coalesce(F.sum(f"{t}_r").over(wp), F.lit(0)),
            f"{t}_Pn": n_p,
            f"{t}_Ps": s_p,
            f"{t}_Pm": mean_p,
            f"{t}_Pq": F.greatest(q_p, F.lit(0.0)),
            f"{t}_Plo": F.min(f"{t}_lo").over(wp),
            f"{t}_Phi": F.max(f"{t}_hi").over(wp),
        })
    for t in ptags.values():
        sx = F.first(F.col(f"{t}_mx"), ignorenulls=True).over(wall)
        sy = F.first(F.col(f"{t}_my"), ignorenulls=True).over(wall)
        n_p = F.coalesce(F.sum(f"{t}_n").over(wp), F.lit(0))
        mx_p = F.try_divide(F.sum(F.col(f"{t}_n") * F.col(f"{t}_mx")).over(wp), n_p)
        my_p = F.try_divide(F.sum(F.col(f"{t}_n") * F.col(f"{t}_my")).over(wp), n_p)
        dx = F.coalesce(F.col(f"{t}_mx") - sx, F.lit(0.0))
        dy = F.coalesce(F.col(f"{t}_my") - sy, F.lit(0.0))

        def comoment(qcol, da, db, ma, mb, sa, sb):
            return (
                F.coalesce(F.sum(qcol).over(wp), F.lit(0.0))
                + F.coalesce(F.sum(F.col(f"{t}_n") * da * db).over(wp), F.lit(0.0))
                - F.coalesce(n_p * (ma - sa) * (mb - sb), F.lit(0.0))
            )

        pre.update({
            f"{t}_Pn": n_p,
            f"{t}_Pmx": mx_p,
            f"{t}_Pmy": my_p,
            f"{t}_Pqx": F.greatest(comoment(f"{t}_qx", dx, dx, mx_p, mx_p, sx, sx), F.lit(0.0)),
            f"{t}_Pqy": F.greatest(comoment(f"{t}_qy", dy, dy, my_p, my_p, sy, sy), F.lit(0.0)),
            f"{t}_Pc": comoment(f"{t}_c", dx, dy, mx_p, my_p, sx, sy),
        })
    prefix = part.select(*keys, *[v.alias(k) for k, v in pre.items()])

    # the prefix table has at most (hot keys x blocks) rows, counted when the
    # blocks were planned; broadcast it only below the configured limit
    bound = conf_int(spark, CONF_BROADCAST_ROWS, 2_000_000)
    joined = d.join(F.broadcast(prefix) if max_rows <= bound else prefix, keys, "left")

    # 3. in-block running window, merged with the prefix
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(_UNB, end)
    cols: dict[str, Column] = {}
    states: dict[str, Moments] = {}
    for x, t in stags.items():
        c = F.col(x).cast("double")
        n_b = F.count(c).over(w)
        m_b = F.avg(c).over(w)
        q_b = F.coalesce(F.var_pop(c).over(w) * n_b, F.lit(0.0))
        n_p = F.coalesce(F.col(f"{t}_Pn"), F.lit(0))
        m_p = F.col(f"{t}_Pm")
        q_p = F.coalesce(F.col(f"{t}_Pq"), F.lit(0.0))
        cols[f"{t}_N"] = n_p + n_b
        cols[f"{t}_R"] = F.coalesce(F.col(f"{t}_Pr"), F.lit(0)) + F.count(F.lit(1)).over(w)
        cols[f"{t}_S"] = F.coalesce(F.col(f"{t}_Ps"), F.lit(0.0)) + F.coalesce(F.sum(c).over(w), F.lit(0.0))
        cols[f"{t}_M"] = _merge_mean(n_p, m_p, n_b, m_b)
        delta = F.coalesce(m_b - m_p, F.lit(0.0))
        cols[f"{t}_Q"] = q_p + q_b + F.coalesce(F.try_divide(delta * delta * n_p * n_b, n_p + n_b), F.lit(0.0))
        cols[f"{t}_LO"] = F.least(F.col(f"{t}_Plo"), F.min(c).over(w))
        cols[f"{t}_HI"] = F.greatest(F.col(f"{t}_Phi"), F.max(c).over(w))
        states[x] = Moments(
            rows=F.col(f"{t}_R"), n=F.col(f"{t}_N"), s=F.col(f"{t}_S"), mean=F.col(f"{t}_M"),
            m2=F.col(f"{t}_Q"), mn=F.col(f"{t}_LO"), mx=F.col(f"{t}_HI"),
        )
    pstates: dict[tuple[str, str], CoMoments] = {}
    for (x, y), t in ptags.items():
        cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
        both = cx.isNotNull() & cy.isNotNull()
        xs, ys = F.when(both, cx), F.when(both, cy)
        n_b = F.count(F.when(both, F.lit(1))).over(w)
        mx_b, my_b = F.avg(xs).over(w), F.avg(ys).over(w)
        n_p = F.coalesce(F.col(f"{t}_Pn"), F.lit(0))
        mx_p, my_p = F.col(f"{t}_Pmx"), F.col(f"{t}_Pmy")
        dx = F.coalesce(mx_b - mx_p, F.lit(0.0))
        dy = F.coalesce(my_b - my_p, F.lit(0.0))
        frac = F.coalesce(F.try_divide(n_p * n_b, n_p + n_b), F.lit(0.0))
        cols[f"{t}_N"] = n_p + n_b
        cols[f"{t}_MX"] = _merge_mean(n_p, mx_p, n_b, mx_b)
        cols[f"{t}_MY"] = _merge_mean(n_p, my_p, n_b, my_b)
        cols[f"{t}_QX"] = F.coalesce(F.col(f"{t}_Pqx"), F.lit(0.0)) + F.coalesce(F.var_pop(xs).over(w) * n_b, F.lit(0.0)) + dx * dx * frac
        cols[f"{t}_QY"] = F.coalesce(F.col(f"{t}_Pqy"), F.lit(0.0)) + F.coalesce(F.var_pop(ys).over(w) * n_b, F.lit(0.0)) + dy * dy * frac
        cols[f"{t}_C"] = F.coalesce(F.col(f"{t}_Pc"), F.lit(0.0)) + F.coalesce(F.covar_pop(xs, ys).over(w) * n_b, F.lit(0.0)) + dx * dy * frac
        pstates[(x, y)] = CoMoments(
            n=F.col(f"{t}_N"), mean_x=F.col(f"{t}_MX"), mean_y=F.col(f"{t}_MY"),
            m2x=F.col(f"{t}_QX"), m2y=F.col(f"{t}_QY"), c=F.col(f"{t}_C"),
        )
    out = joined.withColumns(cols)
    finals = {}
    for name, stat in outputs.items():
        st = states[stat.cols[0]] if stat.spec.arity == 1 else pstates[(stat.cols[0], stat.cols[1])]
        finals[name] = stat.from_state(st)
    out = out.withColumns(finals)
    base = [c for c in d.columns if c not in (BLOCK, HOT) and c not in finals]
    return out.select(*base, *finals)


def cov_matrix(df: DataFrame, cols: Sequence[str], by: Sequence[str] | str | None = None, ddof: int = 1) -> DataFrame:
    """Long-form covariance matrix: one aggregate pass computes every pair
    (sorted names, i <= j, variance on the diagonal), then ``stack``."""
    from ..functions.stats import Stat as _Stat

    by = _as_list(by)
    names = sorted(cols)
    outs = {}
    pairs = []
    for i, a in enumerate(names):
        for b in names[i:]:
            key = f"_cov_{len(pairs)}"
            outs[key] = _Stat.of("cov", a, b, ddof=ddof)
            pairs.append((a, b, key))
    g = grouped(df, outs, by)
    stack = "stack({}, {}) as (a, b, cov)".format(
        len(pairs), ", ".join(f"'{a}', '{b}', `{k}`" for a, b, k in pairs))
    return g.selectExpr(*[f"`{c}`" for c in by], stack)
