"""Streaming forms: the same operators run under Structured Streaming."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions.stats import Stat
from ..queries import Q6, T, q6, query
from ..streaming import stream_ops as S


def _event_stream(spark, sf):
    schema = T(spark, sf, "events").schema
    return S.read_stream(spark, os.path.join(sf, "events.parquet"), schema)


@query(
    "stream_keyed_stats",
    sql=f"""
SELECT user_id, count(*) AS n, {Q6("sum(value)")} AS value_sum, {Q6("avg(value)")} AS value_mean,
  max(value) AS value_max FROM events GROUP BY user_id
""",
)
def stream_keyed_stats(spark, sf):
    """Per-user statistics maintained by a streaming aggregation (update mode);
    the final state equals the batch aggregate."""
    s = _event_stream(spark, sf)
    agg = S.keyed_stats_stream(s, ["user_id"], {"n": Stat.of("count", "value"), "value_sum": Stat.of("sum", "value"),
                                                "value_mean": Stat.of("mean", "value"),
                                                "value_max": Stat.of("max", "value")})
    out = S.run_available_now(agg, ["user_id"])
    return out.select("user_id", "n", q6("value_sum").alias("value_sum"), q6("value_mean").alias("value_mean"),
                      "value_max")


@query(
    "stream_hourly_windows",
    sql=f"""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, {Q6("sum(value)")} AS value_sum
FROM events GROUP BY 1, 2
""",
)
def stream_hourly_windows(spark, sf):
    """Tumbling one-hour windows per event type.  Update mode reports every
    window of the replay (append mode would hold back the windows still
    inside the 2-hour watermark when the replay ends)."""
    s = _event_stream(spark, sf)
    agg = S.windowed_stats_stream(s, "ts", "1 hour", None, "2 hours", ["event_type"],
                                  {"n": Stat.of("count", "value"), "value_sum": Stat.of("sum", "value")})
    out = S.run_available_now(agg, ["window_start", "window_end", "event_type"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n",
                      q6("value_sum").alias("value_sum"))
