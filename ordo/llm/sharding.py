"""Balanced shards by histogram sort.

Rows are ordered by a 62-bit key: CRC-32 of the text, then a hash of the id
(and a tie spread, so that even repeated rows can be parted).  Equal texts are
neighbours in that order, yet a group of any size can be cut between rows.
Rounds of one counting job each compare the exact bytes below candidate key
boundaries with the wanted quantiles and put new probes into the intervals
that still miss the tolerance.  When all splitters are good, the rows are
exchanged once: by range, each range sorted in its own task.

Work per round is one scan of a narrow table (key and size, no text) with
map-side sums; the driver holds probes and their counts, whose number follows
the number of ranges (rows / ``rows_per_task``), never the rows.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import long_array, materialize

KEY_BITS = 62
SPREAD_BITS = 10
ID_BITS = 20


def sort_key(crc: Column, doc_id: Column, spread: Column) -> Column:
    """crc (32 bits), hash of the id (20 bits), tie spread (10 bits)."""
    high = F.shiftleft(crc, ID_BITS + SPREAD_BITS)
    mid = F.shiftleft(F.pmod(F.xxhash64(doc_id), F.lit(1 << ID_BITS)), SPREAD_BITS)
    low = F.pmod(F.xxhash64(spread), F.lit(1 << SPREAD_BITS))
    return high + mid + low


def bucket_of(key: Column, splitters: list[int]) -> Column:
    """Number of splitters not above ``key``: a binary search in one expression."""
    steps = max(1, len(splitters).bit_length())
    padded = splitters + [(1 << 63) - 1] * ((1 << steps) - 1 - len(splitters))
    table = long_array(padded)
    halves = F.array(*[F.lit(1 << s) for s in reversed(range(steps))])
    return F.aggregate(
        halves, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= key, at + step).otherwise(at)
    )


def histogram_splitters(
    rows: DataFrame, n_ranges: int, exact_every: int, tolerance: float, loose: float = 0.25, weight: str = "size"
) -> list[int]:
    """Keys that cut ``rows`` (key, weight) into ``n_ranges`` ranges of near equal weight.

    Every ``exact_every``-th boundary is refined until it is within
    ``tolerance`` of a range group's weight or no key lies between its
    neighbours; the others until within ``loose`` of a range's weight.
    """
    top = 1 << KEY_BITS
    whole = rows.agg(F.sum(weight)).first()[0] or 0
    known = {0: 0, top: whole}
    wanted = {i: whole * i / n_ranges for i in range(1, n_ranges)}
    slack = {
        i: tolerance * whole * exact_every / n_ranges if i % exact_every == 0 else loose * whole / n_ranges
        for i in wanted
    }
    n_first = max(256, 4 * n_ranges)
    probes = [top * j // n_first for j in range(1, n_first)]
    while True:
        counts = {
            r["b"]: r["w"]
            for r in rows.groupBy(bucket_of(F.col("key"), probes).alias("b")).agg(F.sum(weight).alias("w")).collect()
        }
        below = 0
        for b, probe in enumerate(probes):
            below += counts.get(b, 0)
            known[probe] = below
        keys = sorted(known)
        sums = [known[k] for k in keys]
        chosen, fresh = [], set()
        for i, goal in wanted.items():
            hi = min(bisect_left(sums, goal), len(keys) - 1)
            lo = max(hi - 1, 0)
            best = min((lo, hi), key=lambda j: abs(sums[j] - goal))
            chosen.append(keys[best])
            if abs(sums[best] - goal) > slack[i] and keys[hi] - keys[lo] > 1:
                parts = 256 if i % exact_every == 0 else 16
                span = keys[hi] - keys[lo]
                fresh.update(keys[lo] + span * j // parts for j in range(1, parts))
        probes = sorted(fresh - known.keys())
        if not probes:
            return sorted(chosen)


def shard_documents(
    docs: DataFrame,
    n_shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    tolerance: float = 1e-4,
    rows_per_task: int = 200_000,
) -> DataFrame:
    """Put every row into one of ``n_shards`` shards of near equal bytes.

    Law ``bytes``: a row's size is the UTF-8 bytes of its text plus 1 (null
    text: 1); shard sums differ by the tolerance and at most one row.  ``slot``
    numbers the rows of a shard without gaps from 0 in key order.
    ``grown_shard`` is null, as this law promises nothing about growth.

    Null text: size 1 and CRC-32 0.  Null ids, equal texts and repeated rows
    each keep their own row and slot (rows that agree in everything get their
    slots in any order).  Empty table: no rows.  Columns other than the two
    named are ignored, whatever their names.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    rows = source.select(
        "doc_id",
        (F.coalesce(F.octet_length("_text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("_text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_row"),
    ).select(
        "doc_id", "size", "text_crc32", sort_key(F.col("text_crc32"), F.col("doc_id"), F.col("_row")).alias("key")
    )
    rows = materialize(rows, "shard-rows")
    n_rows = rows.count()
    per_shard = max(4, -(-n_rows // (n_shards * rows_per_task)))
    n_ranges = n_shards * per_shard
    splitters = histogram_splitters(rows, n_ranges, per_shard, tolerance)

    ranged = rows.withColumn("_range", bucket_of(F.col("key"), splitters))
    counts = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    offsets, before = [], 0
    for i in range(n_ranges):
        before = 0 if i % per_shard == 0 else before
        offsets.append(before)
        before += counts.get(i, 0)
    place = F.row_number().over(Window.partitionBy("_range").orderBy("key", "doc_id", "size"))
    return ranged.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.floor(F.col("_range") / F.lit(per_shard)).cast("int").alias("shard"),
        (place - 1 + F.get(long_array(offsets), F.col("_range"))).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


