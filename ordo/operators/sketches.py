"""Mergeable histograms and the sliding discrete Fourier transform.

A histogram is a list of bins (left, right, n) in ascending order.  Up to
``max_bins`` distinct values are bins of their own; beyond that the two
neighbours whose right edges lie closest become one.  Tasks sketch what they
read, and few sketches at a time are merged, in rounds, so no task takes more
than a fixed number of bins, however many rows or tasks a key has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.rows import BLOCK, PLACE, ROWS_PER_TASK, overlapping, own, placed, written
from .windows import _as_list

FAN_IN = 64  # sketches that one task merges
FINER = 4  # sketches on the way have this many times the bins, so that merging moves less
BINS = "array<struct<left:double,right:double,n:double>>"


def shrink(left: np.ndarray, right: np.ndarray, n: np.ndarray, max_bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring bins whose right edges lie closest become one until ``max_bins`` are left."""
    over = len(n) - max_bins
    if over <= 0:
        return left, right, n
    gaps = np.diff(right)
    joins = np.zeros(len(n), bool)  # a bin that goes into the one before it
    joins[1 + np.argsort(gaps, kind="stable")[:over]] = True
    first = np.flatnonzero(~joins)
    last = np.append(first[1:], len(n)) - 1
    return left[first], right[last], np.add.reduceat(n, first)


def merge(sketches: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], max_bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One sketch of several: all edges cut the line, and each piece takes from a bin the share of it that it covers."""
    edges = np.unique(np.concatenate([e for left, right, _ in sketches for e in (left, right)]))
    at = np.zeros(len(edges))  # counts of single values
    between = np.zeros(len(edges))  # counts from an edge to the next
    for left, right, n in sketches:
        point = left == right
        np.add.at(at, np.searchsorted(edges, left[point]), n[point])
        wide = ~point
        a, z = np.searchsorted(edges, left[wide]), np.searchsorted(edges, right[wide])
        density = n[wide] / (right[wide] - left[wide])
        slope = np.zeros(len(edges) + 1)
        np.add.at(slope, a, density)
        np.add.at(slope, z, -density)
        covered = np.zeros(len(edges) + 1, np.int64)
        np.add.at(covered, a, 1)
        np.add.at(covered, z, -1)
        inside = np.cumsum(covered)[: len(edges) - 1] > 0
        between[:-1] += np.where(inside, np.cumsum(slope)[: len(edges) - 1] * np.diff(edges), 0.0)
    lefts = np.concatenate([edges, edges])
    rights = np.concatenate([edges, np.append(edges[1:], edges[-1:])])
    counts = np.concatenate([at, between])
    order = np.lexsort((rights, lefts))
    order = order[counts[order] > 0]
    return shrink(lefts[order], rights[order], counts[order], max_bins)


def histogram(df: DataFrame, x: str, by: Sequence[str] | str | None = None, max_bins: int = 256) -> DataFrame:
    """(by..., n, bins, slack): an adaptive histogram of ``x`` for each key.

    ``slack`` bounds what merging moved: the true number of values up to an
    edge differs from the sum of the bins up to it by at most that.  It is 0
    where a key has at most ``max_bins`` distinct values.  Null and NaN count
    nowhere; a key with no value has no row.
    """
    by = _as_list(by)
    keys = [f"_ordo_k{i}" for i in range(len(by))]
    value = F.col(x).cast("double")
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], value.alias("_ordo_x"))
    rows = rows.filter(F.col("_ordo_x").isNotNull() & ~F.isnan("_ordo_x"))
    key_fields = [f for f in rows.schema.fields if f.name in keys]
    schema = T.StructType([*key_fields, T.StructField("n", T.LongType()), *T._parse_datatype_string(f"bins {BINS}, slack double").fields])

    def packed(n: int, sketch, slack: float) -> list:
        return [n, [{"left": a, "right": z, "n": c} for a, z, c in zip(*(v.tolist() for v in sketch), strict=True)], slack]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            groups = frame.groupby(keys, sort=False, dropna=False) if keys else [((), frame)]
            for key, part in groups:
                v, n = np.unique(part["_ordo_x"].to_numpy() + 0.0, return_counts=True)
                out.append([*key, *packed(len(part), shrink(v, v, n.astype(float), FINER * max_bins), 0.0)])
            yield pd.DataFrame(out, columns=schema.names)

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        head = [frame[k].iloc[0] for k in keys]
        if len(frame) == 1:
            return frame[schema.names]
        parts = [tuple(np.array([b[f] for b in bins], float) for f in ("left", "right", "n")) for bins in frame["bins"]]
        slack = 0.0
        for (left, right, n), s in zip(parts, frame["slack"], strict=True):
            slack += s + float(n[left < right].max(initial=0.0))
        return pd.DataFrame([[*head, *packed(int(frame["n"].sum()), merge(parts, FINER * max_bins), slack)]], columns=schema.names)

    # one sketch for each batch of a task, then few at a time
    found = written(rows.mapInPandas(partial, schema), "histogram")
    while True:
        most = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
        if most <= 1:
            break
        salt = (F.rand(7) * F.lit(-(-most // FAN_IN))).cast("int") if most > FAN_IN else F.lit(0)
        found = written(found.withColumn("_ordo_salt", salt).groupBy(*keys, "_ordo_salt").applyInPandas(merged, schema), "histogram")

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            parts = [tuple(np.array([b[f] for b in bins], float) for f in ("left", "right", "n")) for bins in frame["bins"]]
            frame["bins"] = [packed(0, shrink(*part, max_bins), 0.0)[1] for part in parts]
            yield frame

    found = found.select(*schema.names).mapInPandas(final, schema)
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "n", "bins", "slack")


def cdf(bins: Column, n: Column, x: Column) -> Column:
    """Share of a histogram's values up to ``x``, interpolated within bins."""

    def upto(total: Column, b: Column) -> Column:
        part = (x - b["left"]) / (b["right"] - b["left"])
        return total + F.when(x >= b["right"], b["n"]).when(x > b["left"], b["n"] * part).otherwise(0.0)

    return F.aggregate(bins, F.lit(0.0), upto) / n


def quantile(bins: Column, n: Column, q: float) -> Column:
    """Value up to which a share ``q`` of a histogram's values lies, interpolated within bins; the inverse of ``cdf``."""

    def step(state: Column, b: Column) -> Column:
        total = state["total"] + b["n"]
        inside = b["left"] + (b["right"] - b["left"]) * (n * q - state["total"]) / b["n"]
        at = F.when(state["at"].isNull() & (total >= n * q), inside).otherwise(state["at"])
        return F.struct(total.alias("total"), at.alias("at"))

    start = F.struct(F.lit(0.0).alias("total"), F.lit(None).cast("double").alias("at"))
    return F.aggregate(bins, start, step, lambda state: state["at"])


def equi_width(df: DataFrame, x: str, bins: int, by: Sequence[str] | str | None = None) -> DataFrame:
    """(by..., bin, left, right, n): exact counts in ``bins`` ranges of equal width between a key's least and greatest value.

    Empty ranges have no row; the greatest value counts in the last range, a
    constant column in the first.  Null and NaN count nowhere.
    """
    by = _as_list(by)
    keys = [f"_ordo_k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(x).cast("double").alias("_ordo_x"))
    rows = rows.filter(F.col("_ordo_x").isNotNull() & ~F.isnan("_ordo_x"))
    ends = rows.groupBy(*keys).agg(F.min("_ordo_x").alias("lo"), F.max("_ordo_x").alias("hi"))
    if keys:
        ends = ends.toDF(*[f"{k}e" for k in keys], "lo", "hi")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}e"))
        rows = rows.join(ends, same)
    else:
        rows = rows.crossJoin(F.broadcast(ends))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.floor((F.col("_ordo_x") - F.col("lo")) / width), F.lit(bins - 1))
    rows = rows.withColumn("bin", F.when(width > 0, place).otherwise(0).cast("int"))
    out = rows.groupBy(*keys, "bin", "lo", width.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    left, right = F.col("lo") + F.col("bin") * F.col("w"), F.col("lo") + (F.col("bin") + 1) * F.col("w")
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "bin", left.alias("left"), right.alias("right"), "n")


def sliding_dft(
    df: DataFrame,
    x: str,
    window_size: int,
    by: Sequence[str] | str | None = None,
    order: Sequence[str] | str = (),
    frequencies: Sequence[int] | None = None,
    rows: int = ROWS_PER_TASK,
) -> DataFrame:
    """``df`` with ``re_k`` and ``im_k``: coefficients of the Fourier transform of each key's last ``window_size`` values.

    A value turned by its place is summed up from the start of a block, and the
    sums ``window_size`` rows apart differ by the window; nothing but two sums
    per frequency is kept.  Null until a key has that many rows; a null value
    counts as 0.  ``frequencies``: which coefficients, all by default.
    """
    by, order = _as_list(by), _as_list(order)
    rows = max(rows, window_size)
    found = overlapping(placed(df, by, order), rows, window_size)
    upto = Window.partitionBy(*by, BLOCK).orderBy(PLACE)
    value = F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    out = {}
    for k in range(window_size) if frequencies is None else frequencies:

        def angle(place: Column, k: int = k) -> Column:
            return F.lit(2 * math.pi) * ((place % window_size) * k % window_size) / window_size

        sums = []
        for turn in (F.cos, F.sin):
            total = F.sum(value * turn(angle(F.col(PLACE)))).over(upto.rowsBetween(Window.unboundedPreceding, 0))
            sums.append(total)
        out[f"_ordo_c{k}"], out[f"_ordo_s{k}"] = sums
    found = found.withColumns(out)
    found = found.withColumns({n: F.col(n) - F.coalesce(F.lag(n, window_size).over(upto), F.lit(0.0)) for n in out})
    final = {}
    for k in range(window_size) if frequencies is None else frequencies:
        phase = F.lit(2 * math.pi) * (((F.col(PLACE) + 1) % window_size) * k % window_size) / window_size
        c, s = F.col(f"_ordo_c{k}"), F.col(f"_ordo_s{k}")
        full = F.col(PLACE) >= window_size - 1
        final[f"re_{k}"] = F.when(full, c * F.cos(phase) + s * F.sin(phase))
        final[f"im_{k}"] = F.when(full, c * F.sin(phase) - s * F.cos(phase))
    return own(found, rows).withColumns(final).drop(*out, PLACE, BLOCK)
