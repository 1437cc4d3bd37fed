"""Physical helpers for ordered work that must not collapse into one task.

A running aggregate is a window ``partitionBy(key).orderBy(ord)``.  Spark
places a whole key in one task, so a key holding a third of the rows (or a
window with no key at all) becomes a single straggler.  These helpers split
such *hot* keys into order-range blocks:

1. ``hot_keys`` finds keys above a fixed number of rows, whatever the table's
   size.  The hot table is broadcast below ``maxHotKeys`` keys and joined by a
   shuffle above.
2. ``order_bounds`` takes approximate quantiles of the primary order column
   (a distributed sketch; only ``blocks - 1`` numbers reach the driver).  There
   are as many blocks as the largest key has multiples of that number of rows.
3. ``assign_blocks`` tags hot rows with their range block, cold rows with 0.

Per (key, block) partial states are then small, get a prefix over blocks and
are merged into the in-block window (see ``ordo.operators.windows``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import CONF_HOT_ROWS, CONF_MAX_HOT_KEYS, conf_int, default_blocks

BLOCK = "_ordo_blk"
HOT = "_ordo_hot"
#: Rows of one key that one task takes in order, unless ``ordo.hotKeyRows`` says otherwise.
ROWS_PER_TASK = 2_000_000


def _epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def order_number(df: DataFrame, name: str) -> Column:
    """Numeric, time-zone free image of an order column (µs for timestamps)."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", _epoch_ntz(), c)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        # the first six bytes as a number: never falls where the string rises
        data = c if isinstance(dtype, T.BinaryType) else F.encode(c, "UTF-8")
        return F.conv(F.rpad(F.hex(F.substring(data, 1, 6)), 12, "0"), 16, 10).cast("double")
    return c.cast("double")


def order_bounds(df: DataFrame, order_col: str, blocks: int, rel_err: float = 0.001) -> list[float]:
    """``blocks - 1`` approximate quantile cut points of the order column."""
    if blocks <= 1:
        return []
    probs = [i / blocks for i in range(1, blocks)]
    tmp = df.select(order_number(df, order_col).cast("double").alias("_o"))
    cuts = tmp.approxQuantile("_o", probs, rel_err)
    return sorted(set(c for c in cuts if c is not None))


def bucket_of(value: Column, bounds: Sequence[float]) -> Column:
    """Index of the range ``value`` falls in: number of cut points below it.

    A binary search over a constant array, in expressions; null falls in 0.
    """
    if not bounds:
        return F.lit(0)
    cuts = F.split(F.lit(",".join(repr(float(b)) for b in bounds)), ",").cast("array<double>")
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    v = value.cast("double")
    return F.aggregate(
        F.array(*[F.lit(k) for k in steps]),
        F.lit(0),
        lambda at, k: F.when((at + k <= len(bounds)) & (F.get(cuts, at + k - 1) < v), at + k).otherwise(at),
    )


def hot_keys(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, int, int] | None:
    """Keys with more rows than one task should take, how many they are, and the rows of the largest.

    One small job counts the hot keys from the per-key counts (a partial and
    final aggregate); without any it returns ``None`` and callers keep the
    plain plan.
    """
    spark = df.sparkSession
    bound = conf_int(spark, CONF_HOT_ROWS, ROWS_PER_TASK)
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bound)
    keys, largest = counts.agg(F.count(F.lit(1)), F.max("_n")).first()
    if not keys:
        return None
    hot = counts.select(*by)
    return (F.broadcast(hot) if keys <= conf_int(spark, CONF_MAX_HOT_KEYS, 1000) else hot), keys, largest


def assign_blocks(
    df: DataFrame, by: Sequence[str], order_col: str, blocks: int | None = None
) -> tuple[DataFrame, int]:
    """Add ``BLOCK`` (0 for cold keys) and ``HOT`` columns.

    Returns the tagged frame and a bound on its (hot key, block) pairs, 0 if
    nothing was split.  With no key the whole frame is one hot group and is
    always split.
    """
    spark = df.sparkSession
    n_blocks = blocks if blocks is not None else default_blocks(spark)
    if by:
        found = hot_keys(df, by)
        if found is None or n_blocks <= 1:
            return df.withColumn(BLOCK, F.lit(0)).withColumn(HOT, F.lit(False)), 0
        hot, keys, largest = found
        tagged = df.join(hot.withColumn(HOT, F.lit(True)), list(by), "left")
        tagged = tagged.withColumn(HOT, F.coalesce(F.col(HOT), F.lit(False)))
    else:
        tagged = df.withColumn(HOT, F.lit(True))
        keys, largest = 1, df.count() if blocks is None else 0
    if blocks is None:
        n_blocks = max(n_blocks, -(-largest // conf_int(spark, CONF_HOT_ROWS, ROWS_PER_TASK)))
    bounds = order_bounds(df, order_col, n_blocks, min(0.001, 1 / (4 * n_blocks)))
    blk = F.when(F.col(HOT), bucket_of(order_number(df, order_col), bounds)).otherwise(F.lit(0))
    return tagged.withColumn(BLOCK, blk), keys * n_blocks
