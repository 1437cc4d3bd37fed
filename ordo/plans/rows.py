"""Rows numbered in order and cut into blocks that overlap, for work that looks back a fixed number of rows.

``placed`` numbers the rows of every key by many tasks: rows are dealt by
ranges of (key, order), written once to the shared folder, and the few counts
per range give each its offset.  ``overlapping`` cuts a key into blocks of a
fixed number of rows; each block also gets the rows before it that its own
rows look back to (the halo).  A block is what one task holds, whatever the
size of its key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import ensure_checkpoint_dir

PLACE = "_ordo_place"
BLOCK = "_ordo_block"
OWN = "_ordo_is_own"
ROWS_PER_TASK = 500_000


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ordo-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``PLACE``: the row's number from 0 within its key, by ``order``.

    Null keys are a key of their own.  Rows that ``order`` does not tell apart
    are numbered in some order, the same for all later reads.
    """
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))
    dealt = df.repartitionByRange(tasks, *by, *order).sortWithinPartitions(*by, *order)
    rows = written(dealt.withColumn("_ordo_u", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_ordo_u", 33)
    keys = [F.col(c).alias(f"_ordo_k{i}") for i, c in enumerate(by)]
    counts = rows.groupBy(*keys, part.alias("_ordo_part")).agg(F.min("_ordo_u").alias("_ordo_first"), F.count(F.lit(1)).alias("_ordo_n"))
    names = [f"_ordo_k{i}" for i in range(len(by))]
    earlier = Window.partitionBy(*names).orderBy("_ordo_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_ordo_n").over(earlier), F.lit(0)) - F.col("_ordo_first")
    counts = counts.select(*names, "_ordo_part", offset.alias("_ordo_offset"))
    same = part == F.col("_ordo_part")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_ordo_k{i}"))
    out = rows.join(counts, same).withColumn(PLACE, F.col("_ordo_u") + F.col("_ordo_offset"))
    return out.drop("_ordo_u", "_ordo_part", "_ordo_offset", *names)


def overlapping(df: DataFrame, rows: int, before: int) -> DataFrame:
    """``df`` (placed) with ``BLOCK``; rows that later blocks look back to come again in those.

    A row is a block's own where ``PLACE div rows`` is its number.
    """
    blocks = F.sequence(F.expr(f"{PLACE} div {rows}"), F.expr(f"({PLACE} + {before}) div {rows}"))
    return df.select("*", F.explode(blocks).alias(BLOCK))


def overlapping_time(df: DataFrame, by: Sequence[str], time: str, rows: int, period: int) -> DataFrame:
    """``df`` (placed by ``time``, a number) with ``BLOCK`` and ``OWN``.

    A block's halo are all rows less than ``period`` before its first, however
    many; rows of the block's last time that fell in the next block come along,
    as peers.
    """
    block = F.expr(f"{PLACE} div {rows}")
    names = [f"_ordo_k{i}" for i in range(len(by))]
    ends = df.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], block.alias("b")).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    # one entry a block of the key
    ends = ends.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("b", "lo", "hi"))).alias("_ordo_ends"))
    same = F.lit(True)
    for c, n in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    joined = df.join(ends, same).drop(*names) if by else df.crossJoin(F.broadcast(ends))  # one row without a key
    met = F.filter("_ordo_ends", lambda e: (e["b"] == block) | ((F.col(time) > e["lo"] - period) & (F.col(time) <= e["hi"])))
    out = joined.withColumn(BLOCK, F.explode(F.transform(met, lambda e: e["b"]))).drop("_ordo_ends")
    return out.withColumn(OWN, F.col(BLOCK) == block)


def own(df: DataFrame, rows: int) -> DataFrame:
    """The rows of blocks that are not there to be looked back to."""
    return df.filter(F.col(BLOCK) == F.expr(f"{PLACE} div {rows}"))


def blockwise(df: DataFrame, by: Sequence[str], rows: int, before: int, fn: Callable[[pd.DataFrame, int], pd.DataFrame], schema: T.StructType) -> DataFrame:
    """``fn(frame, own)`` on every block of a placed table, its rows in order.

    ``own`` is the position of the first row that is the block's own; ``fn``
    returns rows for those only.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(PLACE, ignore_index=True)
        own = int(frame[PLACE].searchsorted(int(frame[BLOCK].iloc[0]) * rows))
        # past the last row there may be a block of rows to look back to only
        return fn(frame, own) if own < len(frame) else pd.DataFrame(columns=schema.names)

    if before > rows:
        raise ValueError("blocks must have at least as many rows as they look back")
    return overlapping(df, rows, before).groupBy(*by, BLOCK).applyInPandas(run, schema)


def plus(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    """Schema of a placed table without its place, with further fields."""
    return T.StructType([f for f in df.schema.fields if f.name != PLACE] + [T.StructField(n, t) for n, t in fields])
