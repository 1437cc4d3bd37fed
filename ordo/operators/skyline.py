"""Skyline: the rows that no other row dominates.

A row dominates another of the same key if it is at least as good in every
criterion and better in one.  Equal rows do not dominate each other.

The table is scanned once, without a shuffle: a few rows of the best scores
prune most others, and each task keeps a front of what it has seen.  Distinct
survivors are then confirmed in blocks of ascending score.  The score never
falls where a row gets worse, and ties are ordered by the criteria themselves,
so a row can only be dominated by one before it: the front of the first block
is final, prunes the rest, and the next block follows.  A block is what the
driver and each task hold of the front at a time; a front of any size is found
in as many rounds as it has blocks.

With keys, rows of different keys never meet: each task sorts what it reads by
key and score and thins it out, survivors are dealt by key, and a task finds
the front of one key after the other.  Only keys with more survivors than a
block holds go through the rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.rows import written
from .windows import _as_list

KEY, SCORE = "_ordo_key", "_ordo_score"
CELLS = 1 << 21  # comparisons held at a time
FIRST = 1024  # rows of the best scores that prune the whole table
LOCAL = 4096  # rows of the front that a task keeps to prune what it reads
STEP = 256  # rows, sorted by key, that are compared with each other at a time


def image(df: DataFrame, name: str, falling: bool = False) -> Column:
    """A number that orders the values of a column exactly (the other way if ``falling``), null for null and NaN."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value), (-value if falling else value) + F.lit(0.0))
    if isinstance(kind, T.TimestampNTZType):
        value = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(name))
    elif isinstance(kind, T.TimestampType):
        value = F.unix_micros(name)
    elif isinstance(kind, T.DateType):
        value = F.unix_date(name).cast("long")
    elif isinstance(kind, T.BooleanType | T.IntegralType):
        value = F.col(name).cast("long")
    elif isinstance(kind, T.DecimalType) and kind.precision <= 18:
        value = (F.col(name) * F.lit(10**kind.scale)).cast("long")
    else:
        raise TypeError(f"{name}: {kind.simpleString()} is not a criterion")
    return F.bitwise_not(value) if falling else value


def dominated(points: list[np.ndarray], keys: np.ndarray, front: list[np.ndarray], front_keys: np.ndarray, equal: bool = False) -> np.ndarray:
    """Which points some row of the front dominates (or, if ``equal``, is); all criteria are minimised."""
    out = np.zeros(len(keys), bool)
    if not len(front_keys):
        return out
    step = max(1, CELLS // len(front_keys))
    for at in range(0, len(keys), step):
        part = slice(at, at + step)
        no_worse = front_keys[None, :] == keys[part, None]
        better = np.full_like(no_worse, equal)
        for f, p in zip(front, points, strict=True):
            no_worse &= f[None, :] <= p[part, None]
            better |= f[None, :] < p[part, None]
        out[part] = (no_worse & better).any(axis=1)
    return out


def front_of(points: list[np.ndarray], keys: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Positions of the undominated points, by score; repeats of a point stay."""
    order = np.lexsort([*reversed(points), score])
    kept = np.zeros(0, np.int64)
    for at in range(0, len(order), 1024):
        part = order[at : at + 1024]
        part = part[~dominated([p[part] for p in points], keys[part], [p[kept] for p in points], keys[kept])]
        part = part[~dominated([p[part] for p in points], keys[part], [p[part] for p in points], keys[part])]
        kept = np.concatenate([kept, part])
    return kept


def fronts_of_keys(batches: Iterator[pa.RecordBatch], names: Sequence[str], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Undominated rows of every key; the rows come by key, score and criteria.

    Of the last key's front up to ``most`` rows are kept for those that follow.
    """
    front, front_keys = None, np.zeros(0, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            data, keys = [part.column(n).to_numpy() for n in names], part.column(KEY).to_numpy()
            live = np.arange(len(keys))
            if len(front_keys) and front_keys[0] == keys[0]:
                met = int(np.searchsorted(keys, keys[0], "right"))
                gone = dominated([d[:met] for d in data], keys[:met], front, front_keys)
                live = np.concatenate([np.flatnonzero(~gone), np.arange(met, len(keys))])
            live = live[~dominated([d[live] for d in data], keys[live], [d[live] for d in data], keys[live])]
            last = live[keys[live] == keys[-1]]
            if len(front_keys) and front_keys[0] == keys[-1]:
                front = [np.concatenate([f, d[last]])[:most] for f, d in zip(front, data, strict=True)]
                front_keys = np.concatenate([front_keys, keys[last]])[:most]
            else:
                front, front_keys = [d[last][:most] for d in data], keys[last][:most]
            yield part.take(pa.array(live))


def skyline(
    df: DataFrame,
    minimize: Sequence[str] | str | None = None,
    maximize: Sequence[str] | str | None = None,
    by: Sequence[str] | str | None = None,
    block_rows: int = 20_000,
) -> DataFrame:
    """Rows of ``df`` that no row of their key dominates, repeats included.

    Criteria are numbers, dates, timestamps or booleans.  A row with a null or
    NaN criterion takes no part; null keys are a key of their own; keys are
    told apart by a 64-bit hash.  An empty table gives no rows.
    """
    minimize, maximize, by = _as_list(minimize), _as_list(maximize), _as_list(by)
    if not minimize and not maximize:
        raise ValueError("name at least one column to minimize or maximize")
    values = [image(df, c) for c in minimize] + [image(df, c, True) for c in maximize]
    names = [f"_ordo_v{i}" for i in range(len(values))]
    kept = [f"_ordo_b{i}" for i in range(len(by))]
    key = F.xxhash64(*[x for c in by for x in (F.col(c), F.col(c).isNull())]) if by else F.lit(0).cast("long")
    points = df.select(*[F.col(c).alias(k) for c, k in zip(by, kept, strict=True)], key.alias(KEY), *[v.alias(n) for v, n in zip(values, names, strict=True)])
    points = points.filter(" AND ".join(f"{n} IS NOT NULL" for n in names))
    front = _front(points, names, kept, block_rows)
    same = F.lit(True)
    for v, n in zip(values, names, strict=True):
        same = same & (v == F.col(n))
    for c, k in zip(by, kept, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    return df.join(front.select(*kept, *names), same, "left_semi")


def _front(points: DataFrame, names: list[str], kept: list[str], block_rows: int) -> DataFrame:
    spark = points.sparkSession
    bounds = points.agg(*[f(n).cast("double").alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)]).first()
    if bounds[0] is None:
        return points.limit(0)
    score = F.lit(0.0)
    for i, n in enumerate(names):
        low, high = bounds[2 * i], bounds[2 * i + 1]
        span = high - low
        if span and math.isfinite(span):  # else the order of the criteria alone decides
            score = score + (F.col(n).cast("double") - low) / span
    points = points.withColumn(SCORE, score)
    order = [SCORE, *names]

    def columns(rows: pa.Table | pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
        return [rows.column(n).to_numpy() for n in names], rows.column(KEY).to_numpy()

    def block(rows: DataFrame, size: int) -> pa.Table:
        """The front of the first rows by score; as those come first, no other row dominates it."""
        found = rows.orderBy(*order, *kept).limit(size).toArrow()
        return found.take(front_of(*columns(found), found.column(SCORE).to_numpy())) if len(found) else found

    def pruned(rows: DataFrame, confirmed: pa.Table, local: bool) -> DataFrame:
        """Rows that ``confirmed`` does not dominate.

        ``local``: nor rows that the task has seen, of which it keeps a bounded
        front; otherwise confirmed rows themselves go, too.
        """
        shared = spark.sparkContext.broadcast(columns(confirmed))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            front, front_keys = shared.value
            own, own_keys = [f[:0] for f in front], front_keys[:0]
            for batch in batches:
                data, keys = columns(batch)
                live = np.flatnonzero(~dominated(data, keys, front, front_keys, not local))
                if local:
                    live = live[~dominated([d[live] for d in data], keys[live], own, own_keys)]
                    live = live[front_of([d[live] for d in data], keys[live], batch.column(SCORE).to_numpy()[live])]
                    if len(own_keys) < LOCAL:
                        own = [np.concatenate([o, d[live]])[:LOCAL] for o, d in zip(own, data, strict=True)]
                        own_keys = np.concatenate([own_keys, keys[live]])[:LOCAL]
                yield batch.take(pa.array(np.sort(live)))

        return rows.mapInArrow(run, rows.schema)

    def by_key(rows: DataFrame, most: int | None) -> DataFrame:
        return rows.sortWithinPartitions(KEY, *order).mapInArrow(lambda batches: fronts_of_keys(batches, names, most), rows.schema)

    found = []
    if kept:
        left = written(by_key(points, LOCAL).distinct(), "front")
        large = left.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_rows).select(KEY)
        if large.isEmpty():
            return by_key(left.repartition(KEY), None)
        found.append(by_key(left.join(large, KEY, "left_anti").repartition(KEY), None))
        left = written(left.join(large, KEY, "left_semi"), "front")
    else:
        # the best few scores prune most rows before anything is shuffled
        left = written(pruned(points, block(points, FIRST), True).distinct(), "front")
    while True:
        best = block(left, block_rows)
        found.append(written(spark.createDataFrame(best, left.schema), "front"))
        if left.count() <= block_rows:
            return reduce(DataFrame.unionByName, found)
        left = written(pruned(left, best, False), "front")
