"""Readers and writers: each is one distributed Spark read/write plus casts.

Nothing is iterated on the driver; the only driver-side parse is an ARFF
header (a handful of ``@attribute`` lines), after which the body is a plain
distributed CSV scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, target: str | Sequence[str] | None = None,
             converters: Mapping[str, str] | None = None, parse_dates: Mapping[str, str] | None = None,
             drop: Sequence[str] = (), drop_nones: bool = False, fraction: float = 1.0, seed: int | None = None,
             sep: str = ",", header: bool = True) -> DataFrame:
    """CSV rows with casts (``converters``: column -> Spark type), date parsing
    (column -> format), dropped columns and Bernoulli sampling at scan."""
    reader = spark.read.option("header", header).option("sep", sep)
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    if drop:
        df = df.drop(*drop)
    if converters:
        df = df.withColumns({c: F.col(c).cast(t) for c, t in converters.items()})
    if parse_dates:
        df = df.withColumns({c: F.to_timestamp(F.col(c), fmt) for c, fmt in parse_dates.items()})
    if drop_nones and schema is None:
        # an empty field is absent from its row; the fixed columns carry that as NULL, rows stay
        df = df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c, kind in df.dtypes if kind == "string"})
    if fraction < 1.0:
        df = df.sample(withReplacement=False, fraction=fraction, seed=seed)
    if isinstance(target, (list, tuple)):
        df = df.withColumn("y", F.struct(*target)).drop(*target)
    elif target:
        df = df.withColumnRenamed(target, "y")
    return df


def read_libsvm(spark: SparkSession, path: str, target_type: str = "double") -> DataFrame:
    """``label name:value ...`` lines -> (y, x map<string,double>); ``#`` starts a comment."""
    lines = spark.read.text(path)
    body = F.trim(F.split(F.col("value"), "#").getItem(0))
    d = lines.select(body.alias("l")).filter(F.length("l") > 0)
    parts = F.split(F.col("l"), r"\s+")
    pairs = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.split(p, ":"))
    x = F.map_from_entries(F.transform(pairs, lambda kv: F.struct(kv.getItem(0).alias("k"),
                                                                   kv.getItem(1).cast("double").alias("v"))))
    return d.select(parts.getItem(0).cast(target_type).alias("y"), x.alias("x"))


def read_arff(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """ARFF: numeric attributes become doubles, others strings."""
    lines = spark.read.text(path)
    header = [r.value for r in lines.filter(F.lower(F.trim("value")).startswith("@attribute")).collect()]
    fields = []
    for h in header:
        parts = h.strip().split(None, 2)
        name = parts[1].strip("'\"")
        kind = parts[2].strip().lower() if len(parts) > 2 else "string"
        dtype = T.DoubleType() if kind in ("numeric", "real", "integer") else T.StringType()
        fields.append(T.StructField(name, dtype))
    schema = T.StructType(fields)
    body = lines.filter(~F.trim("value").startswith("@") & ~F.trim("value").startswith("%") & (F.length(F.trim("value")) > 0))
    cols = F.split(F.col("value"), ",")
    df = body.select(*[(cols.getItem(i) if isinstance(f.dataType, T.StringType) else F.trim(cols.getItem(i)).cast("double"))
                       .alias(f.name) for i, f in enumerate(schema.fields)])
    return df.withColumnRenamed(target, "y") if target else df


def read_sql(spark: SparkSession, query: str, target_name: str | None = None) -> DataFrame:
    """Any SQL over registered tables/views (filters and joins included)."""
    df = spark.sql(query)
    return df.withColumnRenamed(target_name, "y") if target_name else df


def from_pandas(spark: SparkSession, X: pd.DataFrame, y: pd.Series | None = None) -> DataFrame:
    pdf = X.copy()
    if y is not None:
        pdf["y"] = y.values
    return spark.createDataFrame(pdf)


def shuffle(df: DataFrame, buffer_size: int, order, seed: int = 0) -> DataFrame:
    """Bounded-buffer shuffle: rows are permuted within consecutive blocks of
    ``buffer_size`` rows (a close, parallel stand-in for the buffer's
    slot sampling).  Adds ``shuffled_pos``."""
    from ..operators.sequence import row_number

    d = row_number(df, None, order, "_pos")
    d = d.withColumn("_blk", F.floor((F.col("_pos") - 1) / buffer_size))
    w = Window.partitionBy("_blk").orderBy(F.rand(seed), "_pos")
    d = d.withColumn("shuffled_pos", (F.col("_blk") * buffer_size + F.row_number().over(w)).cast("long"))
    return d.drop("_pos", "_blk")


def take(df: DataFrame, k: int, order) -> DataFrame:
    """First ``k`` rows in stream order (a top-k: the limit is the feature)."""
    order = [order] if isinstance(order, str) else list(order)
    return df.orderBy(*order).limit(k)


def cache_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """Keep a stream for replay: persisted in memory/disk, or written as
    parquet to a shared path and read back."""
    if path is None:
        return df.persist()
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_results(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).option("header", True).save(path)
