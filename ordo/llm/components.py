"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label is the component's smallest node.

    Each round is grouped minima (summed on the map side) and joins, which
    AQE splits where one node has very many edges; nothing is collected but
    one row that says whether the round changed anything.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    pairs = materialize(pairs, "edges")
    state = None
    while True:
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialize(small.union(least.select("u", "m")).filter("u != v").distinct(), "edges")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    labels = pairs.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    return labels.union(labels.select("label", "label").distinct())
