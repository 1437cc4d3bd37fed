"""Delayed labels, prequential evaluation and stream plumbing."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..plans.session import ensure_checkpoint_dir
from ..queries import Q6, T, q6, query
from ..sources import readers as R

_DAY_US = 86_400_000_000
_DELAY = 30 * _DAY_US


@query(
    "delayed_label_events",
    sql=f"""
SELECT o_orderkey AS id, epoch_us(o_orderdate) AS event_us, 'question' AS kind, CAST(NULL AS DOUBLE) AS y, 1 AS kind_rank
FROM orders
UNION ALL
SELECT o_orderkey AS id, epoch_us(o_orderdate) + {_DELAY} AS event_us, 'answer' AS kind, o_totalprice AS y, 0 AS kind_rank
FROM orders
""",
)
def delayed_label_events(spark, sf):
    """Each order is a question at its date and an answer 30 days later."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return E.delayed_events(o, "o_orderkey", "o_orderdate", "o_totalprice", _DELAY)


_DW = (f"PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate) "
       f"RANGE BETWEEN UNBOUNDED PRECEDING AND {_DELAY} PRECEDING")


@query(
    "delayed_target_mean",
    headline=True,
    sql=f"""
SELECT o_orderkey, o_custkey, {Q6(f"coalesce(avg(o_totalprice / 1000.0) OVER ({_DW}), 0.0)")} AS y_mean_delayed
FROM orders
""",
)
def delayed_target_mean(spark, sf):
    """Per-customer mean of targets already released (label delay 30 days)."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_totalprice") / 1000.0).alias("y"))
    out = E.delayed_target_agg(o, "y", "mean", "o_custkey", "o_orderdate", _DELAY, name="y_mean_delayed")
    return out.select("o_orderkey", "o_custkey", q6("y_mean_delayed").alias("y_mean_delayed"))


@query(
    "prequential_mae_delayed",
    sql=f"""
WITH p AS (SELECT o_orderkey, o_orderdate, o_totalprice / 1000.0 AS y,
             coalesce(avg(o_totalprice / 1000.0) OVER ({_DW}), 0.0) AS yhat FROM orders),
r AS (SELECT *, epoch_us(o_orderdate) + {_DELAY} AS rel FROM p)
SELECT o_orderkey,
  count(*) OVER (ORDER BY rel, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS answer_no,
  {Q6("avg(abs(y - yhat)) OVER (ORDER BY rel, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")} AS mae
FROM r
""",
)
def prequential_mae_delayed(spark, sf):
    """Progressive MAE of the delayed-label forecaster, in answer-release order."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_totalprice") / 1000.0).alias("y"))
    o = E.delayed_target_agg(o, "y", "mean", "o_custkey", "o_orderdate", _DELAY, name="yhat")
    o = o.withColumn("yhat", F.coalesce("yhat", F.lit(0.0)))
    out = E.progressive_metric(o, "y", "yhat", "o_orderdate", "o_orderkey", _DELAY, metric="mae")
    return out.select("o_orderkey", "answer_no", q6("mae").alias("mae"))


@query("take_first", sql="SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 100")
def take_first(spark, sf):
    """First 100 events of the stream (top-k by stream order)."""
    return R.take(T(spark, sf, "events").select("event_id", "user_id", "value"), 100, "event_id")


@query("shuffle_buffer")
def shuffle_buffer(spark, sf):
    """Seeded buffered shuffle of the event stream (blocks of 1,000 rows)."""
    e = T(spark, sf, "events").select("event_id", "user_id", "value")
    return R.shuffle(e, 1000, "event_id", seed=7)


@query(
    "csv_roundtrip",
    sql="SELECT event_id, user_id, event_type, value, ts FROM events",
)
def csv_roundtrip(spark, sf):
    """Events written as CSV to the shared folder and read back with casts
    and timestamp parsing."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, f"csv-{uuid.uuid4().hex}")
    e = T(spark, sf, "events").select("event_id", "user_id", "event_type", "value",
                                      F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))
    R.write_results(e, path, fmt="csv")
    back = R.read_csv(spark, path, converters={"event_id": "long", "user_id": "long", "value": "double"},
                      parse_dates={"ts": "yyyy-MM-dd HH:mm:ss.SSSSSS"})
    return back.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_PREV = "SELECT event_id, user_id, event_type, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS prev, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_type FROM events"
_DAY = "PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECOND PRECEDING AND CURRENT ROW"


def _previous(spark, sf):
    from ..operators import windows as W

    e = T(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", "value")
    return W.lagged(e, {"prev": (F.col("value"), 1, None), "prev_type": (F.col("event_type"), 1, None)}, "user_id", "event_id")


@query(
    "time_rolling_metric",
    sql=f"""
WITH p AS ({_PREV})
SELECT event_id, {Q6("coalesce(avg(abs(value - prev)) OVER d, 0)")} AS mae, {Q6("coalesce(sqrt(avg(pow(value - prev, 2)) OVER d), 0)")} AS rmse,
  {Q6("coalesce(avg(CASE WHEN prev_type IS NOT NULL THEN CAST(event_type = prev_type AS DOUBLE) END) OVER d, 0)")} AS accuracy
FROM p WINDOW d AS ({_DAY})
""",
)
def time_rolling_metric(spark, sf):
    """Errors of the no-change forecast over each user's last day, as of every event."""
    from ..operators import metrics as M

    rows = _previous(spark, sf)
    for name in ("mae", "rmse"):
        rows = M.time_rolling_metric(rows, name, "value", "prev", "ts", 86_400_000_000, "user_id")
    rows = M.time_rolling_metric(rows, "accuracy", "event_type", "prev_type", "ts", 86_400_000_000, "user_id")
    return rows.select("event_id", q6("mae").alias("mae"), q6("rmse").alias("rmse"), q6("accuracy").alias("accuracy"))


@query(
    "rolling_binary_metrics",
    sql=f"""
WITH p AS ({_PREV}), c AS (SELECT event_id, event_type, CAST(event_type = 'click' AND prev_type = 'click' AS INT) AS tp, CAST(event_type <> 'click' AND prev_type = 'click' AS INT) AS fp,
  CAST(event_type = 'click' AND prev_type <> 'click' AS INT) AS fn FROM p),
s AS (SELECT event_id, coalesce(sum(tp) OVER w, 0) AS tp, coalesce(sum(fp) OVER w, 0) AS fp, coalesce(sum(fn) OVER w, 0) AS fn FROM c
  WINDOW w AS (ORDER BY event_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW))
SELECT event_id, {Q6("coalesce(tp / nullif(tp + fp, 0), 0)")} AS precision, {Q6("coalesce(tp / nullif(tp + fn, 0), 0)")} AS recall,
  {Q6("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)")} AS f1 FROM s
""",
)
def rolling_binary_metrics(spark, sf):
    """Precision, recall and F1 of repeating the user's last event type, for clicks, over the last 500 events of all users."""
    from ..operators import metrics as M

    rows = _previous(spark, sf)
    for name in ("precision", "recall", "f1"):
        rows = M.rolling_metric(rows, name, "event_type", "prev_type", "event_id", 500, positive="click")
    return rows.select("event_id", *[q6(n).alias(n) for n in ("precision", "recall", "f1")])


@query(
    "time_rolling_distribution",
    sql=f"""
SELECT event_id, {Q6(f"CAST(count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECOND PRECEDING AND CURRENT ROW) AS DOUBLE) / count(*) OVER ({_DAY})")} AS share,
  {Q6(f"avg(value) OVER ({_DAY})")} AS mu, {Q6(f"coalesce(var_samp(value) OVER ({_DAY}), 0)")} AS sigma2
FROM events
""",
)
def time_rolling_distribution(spark, sf):
    """Share of each event's type, and the mean and variance of the values, among its user's events of the last day."""
    from ..functions.stats import Stat
    from ..operators import distributions as D, windows as W

    e = T(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", "value")
    rows = D.time_rolling_share(e, "event_type", 86_400_000_000, "ts", "user_id")
    rows = W.time_rolling(rows, {"mu": Stat.of("mean", "value"), "sigma2": Stat.of("var", "value")}, 86_400_000_000, "ts", "user_id")
    return rows.select("event_id", q6("share").alias("share"), q6("mu").alias("mu"), q6("sigma2").alias("sigma2"))
