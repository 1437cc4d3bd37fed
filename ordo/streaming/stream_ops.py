"""Structured Streaming forms of the keyed operators.

* ``keyed_stats_stream``   – per-key statistics in update mode (the state
  store keeps partial aggregates; same specs as the batch ``grouped``).
* ``windowed_stats_stream`` – sliding/tumbling event-time windows with a
  watermark for late rows.
* ``label_join_stream``    – questions joined to labels that arrive within
  ``delay`` (stream-stream join with watermarks and a time-range condition).
* ``run_available_now``    – drive a streaming plan over the data present now
  into a sink, with the checkpoint under the shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import Stat
from ..plans.session import ensure_checkpoint_dir


BATCH = "_ordo_batch"


def read_stream(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """Parquet stream of a folder, or of one file, which is read as its folder with just that name."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getFileStatus(folder).isFile():
        return reader.option("pathGlobFilter", folder.getName()).parquet(folder.getParent().toString())
    return reader.parquet(path)


def keyed_stats_stream(sdf: DataFrame, by: Sequence[str], outputs: Mapping[str, Stat]) -> DataFrame:
    return sdf.groupBy(*by).agg(*[s.native().alias(n) for n, s in outputs.items()])


def windowed_stats_stream(sdf: DataFrame, time_col: str, window: str, slide: str | None, watermark: str,
                          by: Sequence[str], outputs: Mapping[str, Stat]) -> DataFrame:
    t = "_ordo_event_time"
    d = sdf.withColumn(t, F.col(time_col).cast("timestamp")).withWatermark(t, watermark)
    win = F.window(t, window, slide) if slide else F.window(t, window)
    out = d.groupBy(win.alias("w"), *by).agg(*[s.native().alias(n) for n, s in outputs.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *outputs)


def label_join_stream(questions: DataFrame, labels: DataFrame, id_col: str, q_time: str, l_time: str, delay: str,
                      watermark: str) -> DataFrame:
    """Questions paired with their label if it arrives within ``delay``."""
    q = questions.withColumn("_qt", F.col(q_time).cast("timestamp")).withWatermark("_qt", watermark).alias("q")
    lab = labels.withColumn("_lt", F.col(l_time).cast("timestamp")).withWatermark("_lt", watermark).alias("l")
    cond = (F.col(f"q.{id_col}") == F.col(f"l.{id_col}")) & (F.col("l._lt") >= F.col("q._qt")) & (
        F.col("l._lt") <= F.col("q._qt") + F.expr(f"INTERVAL {delay}"))
    return q.join(lab, cond, "inner")


def run_available_now(sdf: DataFrame, keys: Sequence[str], name: str | None = None) -> DataFrame:
    """Run the streaming plan in update mode over all data present now; the last row of each key.

    Every trigger's changed rows are written to the shared folder under its
    number, once more if the trigger is repeated, and none pass through the
    driver.
    """
    spark = sdf.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/streams/{name or uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/{BATCH}={number}")

    q = (sdf.writeStream.outputMode("update").foreachBatch(keep)
         .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.lastProgress is None:
        return spark.createDataFrame([], sdf.schema)
    found = spark.read.schema(T.StructType([*sdf.schema.fields, T.StructField(BATCH, T.LongType())])).option("basePath", f"{root}/out").parquet(f"{root}/out/*")
    rest = [c for c in sdf.columns if c not in keys]
    last = found.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("_last"))
    return last.select(*keys, "_last.*").select(*sdf.columns)


def run_to_parquet(sdf: DataFrame, path: str, mode: str = "append") -> None:
    """Exactly-once file sink with its checkpoint beside the output."""
    q = (sdf.writeStream.outputMode(mode).format("parquet").option("path", path)
         .option("checkpointLocation", path.rstrip("/") + "_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
