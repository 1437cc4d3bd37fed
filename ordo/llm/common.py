"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import ensure_checkpoint_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors; the folder comes
    from ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ordo-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda variable is evaluated once, where a plain reference may be
    inlined into every use (and into every step of a higher-order function).
    """
    return F.transform(F.array(value), body)[0]


def total(values: Column, kind: str = "bigint") -> Column:
    """Sum of an array column."""
    return F.aggregate(values, F.lit(0).cast(kind), lambda acc, x: acc + x)


def long_array(values: list[int]) -> Column:
    """A constant array of longs as one foldable literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _running(values: Column) -> Column:
    """Sums of all values before each place; quadratic, for short arrays."""
    return F.aggregate(
        values,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )


def prefix_sums(values: Column, chunk: int = 256) -> Column:
    """Sums of all values before each place of an array, chunk by chunk."""

    def chunked(v: Column) -> Column:
        parts = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / F.lit(chunk)).cast("int")),
            lambda j: F.slice(v, j * chunk + 1, chunk),
        )
        return let(
            parts,
            lambda p: F.flatten(
                F.zip_with(p, _running(F.transform(p, lambda c: total(c))), lambda c, off: F.transform(_running(c), lambda x: x + off))
            ),
        )

    empty = F.array().cast("array<bigint>")
    return let(values, lambda v: F.when(F.size(v) == 0, empty).when(F.size(v) <= chunk, _running(v)).otherwise(chunked(v)))


def match_spans(text: Column, pattern: Column) -> Column:
    """Places (a, z) of a pattern's leftmost non-overlapping matches, in code points, end exclusive.

    Patterns must not match the empty string.
    """
    nothing = F.array().cast("array<struct<a:bigint,z:bigint>>")

    def placed(hits: Column) -> Column:
        sizes = F.zip_with(
            F.split(text, pattern),
            hits,
            lambda gap, hit: F.struct(
                F.char_length(gap).cast("bigint").alias("g"), F.coalesce(F.char_length(hit), F.lit(0)).cast("bigint").alias("h")
            ),
        )
        return let(
            sizes,
            lambda s: F.slice(
                F.zip_with(
                    s,
                    prefix_sums(F.transform(s, lambda x: x["g"] + x["h"])),
                    lambda x, at: F.struct((at + x["g"]).alias("a"), (at + x["g"] + x["h"]).alias("z")),
                ),
                F.lit(1),
                F.size(hits),
            ),
        )

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return let(found, lambda h: F.when(F.size(h) > 0, placed(h)).otherwise(nothing))
