"""Feature selection over a melted (feature, value) table.

Features become rows, so per-feature statistics are one grouped aggregate
whatever the number of features; the kept features are a small table used
for a left-semi join (a whitelist) on the long form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def melt(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keep, F.explode(arr).alias("_f")).select(*keep, "_f.feature", "_f.value")


def variance_threshold(df: DataFrame, features: Sequence[str], threshold: float = 0.0,
                       min_samples: int = 2) -> DataFrame:
    """Features kept: fewer than ``min_samples`` values, or sample variance
    above ``threshold``."""
    long = melt(df, features)
    stats = long.groupBy("feature").agg(F.count("value").alias("n"), F.var_samp("value").alias("var"))
    keep = (F.col("n") < min_samples) | (F.coalesce(F.col("var"), F.lit(0.0)) > threshold)
    return stats.filter(keep).select("feature", "n", "var")


def select_k_best(df: DataFrame, features: Sequence[str], y: str, k: int = 10) -> DataFrame:
    """The k features with the largest (signed) Pearson correlation with y."""
    long = melt(df, features, keep=[y])
    stats = long.groupBy("feature").agg(
        F.var_pop("value").alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop("value", y).alias("c"))
    corr = F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("c") / F.sqrt(F.col("vx") * F.col("vy"))).otherwise(
        F.lit(0.0))
    stats = stats.withColumn("score", corr)
    # one row per feature: ranking the (small) feature table
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "feature")
    return stats.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("feature", "score", "rank")


def keep_selected(long: DataFrame, selected: DataFrame) -> DataFrame:
    return long.join(selected.select("feature"), "feature", "left_semi")
