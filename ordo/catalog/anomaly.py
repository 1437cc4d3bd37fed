"""Anomaly scoring under test-then-train, evaluated with exact score curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly as A, metrics as M
from ..queries import Q6, T, q6, query

_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax"]


def _scored(spark, sf, n_trees=25, height=15, window=250):
    li = T(spark, sf, "lineitem").select(*_ORDER, "l_returnflag")
    li = li.withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    scaled = A.minmax_unkeyed(li, _FEATS, _ORDER)
    return A.half_space_trees(scaled, _FEATS, _ORDER, n_trees=n_trees, height=height, window_size=window, seed=42)


@query("hst_test_then_train", headline=True)
def hst_test_then_train(spark, sf):
    """Min-max scaling -> half-space trees (25 trees, height 15, window 250) ->
    PR-AUC / ROC-AUC / max F1 over every lineitem row."""
    return M.curve_metrics(_scored(spark, sf), "label", "hst_score", checkpoint=True)


@query("hst_scores")
def hst_scores(spark, sf):
    """Per-row half-space-tree scores (10 trees, height 8) with a constant threshold."""
    s = _scored(spark, sf, n_trees=10, height=8)
    s = A.threshold_constant(s, "hst_score", 0.8)
    return s.select("_rn", "hst_score", "is_anomaly")


@query(
    "threshold_quantile",
    sql=f"""
SELECT event_id, user_id,
  CASE WHEN value > quantile_cont(value, 0.9) OVER (PARTITION BY user_id ORDER BY event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) THEN 1 ELSE 0 END AS is_anomaly
FROM events
""",
)
def threshold_quantile(spark, sf):
    """Flag values above the running 90% quantile of the user's values so far."""
    e = T(spark, sf, "events").select("event_id", "user_id", "value")
    return A.threshold_quantile(e, "value", 0.9, "user_id", "event_id").select("event_id", "user_id", "is_anomaly")


_NUMBERED = """e AS (SELECT event_id, user_id, value AS x, CAST(event_type = 'error' AS DOUBLE) AS miss, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)"""


@query(
    "drift_page_hinkley",
    sql=f"""
WITH RECURSIVE {_NUMBERED},
s(user_id, r, event_id, n, total, level, drift, estimate) AS (
  SELECT user_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, false, 0.0::DOUBLE FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, r, event_id, CASE WHEN hit THEN 0 ELSE n END, CASE WHEN hit THEN 0.0 ELSE total END, CASE WHEN hit THEN 0.0 ELSE level END, hit, total / n
  FROM (SELECT *, n + 1 >= 30 AND level >= 200 AS hit FROM (
    SELECT e.user_id, e.r, e.event_id, s.n + 1 AS n, s.total + e.x AS total,
      greatest(0.9999 * s.level + e.x - (s.total + e.x) / (s.n + 1) - 0.005, 0.0) AS level FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1)))
SELECT event_id, user_id, drift, false AS warning, {Q6("estimate")} AS estimate FROM s WHERE r > 0
""",
)
def drift_page_hinkley(spark, sf):
    """Page-Hinkley drift flags on each user's event values."""
    from ..operators import drift as D

    e = T(spark, sf, "events").select("event_id", "user_id", "value")
    found = D.detect_drift(e, "value", "user_id", "event_id", detector="page_hinkley", threshold=200.0)
    return found.select("event_id", "user_id", "drift", "warning", q6("estimate").alias("estimate"))


@query(
    "drift_ddm",
    sql=f"""
WITH RECURSIVE {_NUMBERED},
s(user_id, r, event_id, n, total, low, low_rate, low_dev, drift, warning, estimate) AS (
  SELECT user_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, 'inf'::DOUBLE, 'inf'::DOUBLE, 'inf'::DOUBLE, false, false, 0.0::DOUBLE FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, r, event_id, CASE WHEN hit THEN 0 ELSE n END, CASE WHEN hit THEN 0.0 ELSE total END, CASE WHEN hit THEN 'inf'::DOUBLE ELSE low END,
    CASE WHEN hit THEN 'inf'::DOUBLE ELSE low_rate END, CASE WHEN hit THEN 'inf'::DOUBLE ELSE low_dev END, hit, NOT hit AND n >= 30 AND rate + dev > low_rate + 2 * low_dev, rate
  FROM (SELECT *, n >= 30 AND rate + dev > low_rate + 3 * low_dev AS hit FROM (
    SELECT user_id, r, event_id, n, total, rate, dev, CASE WHEN new THEN rate + dev ELSE low END AS low, CASE WHEN new THEN rate ELSE low_rate END AS low_rate, CASE WHEN new THEN dev ELSE low_dev END AS low_dev
    FROM (SELECT *, n >= 30 AND rate + dev <= low AS new FROM (SELECT *, sqrt(greatest(rate * (1 - rate), 0) / n) AS dev FROM (
      SELECT e.user_id, e.r, e.event_id, s.n + 1 AS n, s.total + e.miss AS total, (s.total + e.miss) / (s.n + 1) AS rate, s.low, s.low_rate, s.low_dev
      FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1))))))
SELECT event_id, user_id, drift, warning, {Q6("estimate")} AS estimate FROM s WHERE r > 0
""",
)
def drift_ddm(spark, sf):
    """DDM on each user's error stream (an 'error' event counts as a miss)."""
    return _user_drift(spark, sf, "ddm", "miss").select("event_id", "user_id", "drift", "warning", q6("estimate").alias("estimate"))


def _user_drift(spark, sf, detector, on="value", **params):
    from ..operators import drift as D

    e = T(spark, sf, "events").select(
        "event_id", "user_id", "value", (F.col("event_type") == "error").cast("double").alias("miss"))
    return D.detect_drift(e, on, "user_id", "event_id", detector=detector, **params)


@query("drift_eddm")
def drift_eddm(spark, sf):
    """Distances of errors on each user's error stream."""
    return _user_drift(spark, sf, "eddm", "miss")


@query("drift_hddm_a")
def drift_hddm_a(spark, sf):
    """Two-sided Hoeffding test of means on each user's error stream."""
    return _user_drift(spark, sf, "hddm_a", "miss", two_sided_test=True)


@query("drift_hddm_w")
def drift_hddm_w(spark, sf):
    """Hoeffding test of weighted means on each user's error stream."""
    return _user_drift(spark, sf, "hddm_w", "miss")


@query("drift_adwin")
def drift_adwin(spark, sf):
    """Adaptive windows over each user's event values."""
    return _user_drift(spark, sf, "adwin")


@query("drift_kswin")
def drift_kswin(spark, sf):
    """Kolmogorov-Smirnov windows over each user's event values."""
    return _user_drift(spark, sf, "kswin", window_size=40, stat_size=15)
