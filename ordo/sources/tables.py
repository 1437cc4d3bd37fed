"""Access to the benchmark tables by name."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` under ``sf_dir`` (scan with pushdown/pruning)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
