"""Local outlier factor and nearest neighbours, in windows and in whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbors as N
from ..queries import Q6, T, q6, query

_W, _K = 20, 3


@query(
    "local_outlier_factor",
    sql=f"""
WITH e AS (SELECT event_id, event_type, value, CAST(hour(ts) AS DOUBLE) AS h, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events),
w AS (SELECT e.event_type, e.r AS w, o.r, o.value, o.h FROM e JOIN e o ON o.event_type = e.event_type AND o.r BETWEEN e.r - {_W - 1} AND e.r WHERE e.r > {_K}),
d AS (SELECT a.event_type, a.w, a.r AS a, b.r AS b, sqrt((a.value - b.value) * (a.value - b.value) + (a.h - b.h) * (a.h - b.h)) AS d
      FROM w a JOIN w b ON a.event_type = b.event_type AND a.w = b.w AND a.r <> b.r),
n AS (SELECT *, row_number() OVER (PARTITION BY event_type, w, a ORDER BY d, b) AS k FROM d QUALIFY k <= {_K}),
kd AS (SELECT event_type, w, a, max(d) AS kd FROM n GROUP BY 1, 2, 3),
lrd AS (SELECT n.event_type, n.w, n.a, coalesce({_K} / nullif(sum(greatest(n.d, kd.kd)), 0), 1e6) AS lrd
        FROM n JOIN kd ON kd.event_type = n.event_type AND kd.w = n.w AND kd.a = n.b GROUP BY 1, 2, 3),
f AS (SELECT n.event_type, n.w, sum(lrd.lrd) AS s FROM n JOIN lrd ON lrd.event_type = n.event_type AND lrd.w = n.w AND lrd.a = n.b WHERE n.a = n.w GROUP BY 1, 2)
SELECT e.event_id, {Q6(f"coalesce(f.s / ({_K} * lrd.lrd), 1.0)")} AS lof
FROM e LEFT JOIN f ON f.event_type = e.event_type AND f.w = e.r LEFT JOIN lrd ON lrd.event_type = e.event_type AND lrd.w = e.r AND lrd.a = e.r
""",
)
def local_outlier_factor(spark, sf):
    """Outlier factor (k 3) of every event among the last 20 of its type, by value and hour."""
    e = T(spark, sf, "events").select("event_id", "event_type", "value", F.hour("ts").cast("double").alias("h"))
    return N.local_outlier_factor(e, ["value", "h"], "event_type", "event_id", k=_K, window_size=_W).select("event_id", q6("lof").alias("lof"))


@query("local_outlier_factor_stream")
def local_outlier_factor_stream(spark, sf):
    """Outlier factor (k 10) of every event among the last 250 of the whole stream."""
    e = T(spark, sf, "events").select("event_id", "value", F.hour("ts").cast("double").alias("h"))
    return N.local_outlier_factor(e, ["value", "h"], None, "event_id").select("event_id", q6("lof").alias("lof"))


_NEAR = """
WITH e AS (SELECT event_id, event_type, user_id, value, CAST(hour(ts) AS DOUBLE) AS h, row_number() OVER (ORDER BY event_id) AS r FROM events),
d AS (SELECT a.event_id, b.event_type AS y, b.value AS v, sqrt((a.value - b.value) * (a.value - b.value) + (a.h - b.h) * (a.h - b.h)) AS d, b.r
      FROM e a JOIN e b ON b.r BETWEEN a.r - 100 AND a.r - 1),
n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, r) AS k FROM d QUALIFY k <= 5)"""


@query(
    "knn_classifier_window",
    sql=f"""
{_NEAR},
z AS (SELECT event_id, bool_or(d = 0 AND k = 1) AS hit, min(CASE WHEN d = 0 AND k = 1 THEN y END) AS first_y FROM n GROUP BY 1),
v AS (SELECT event_id, y, CASE WHEN any_value(hit) THEN CAST(y = any_value(first_y) AS DOUBLE) ELSE sum(1 / nullif(d, 0)) END AS vote FROM n JOIN z USING (event_id) GROUP BY 1, 2),
t AS (SELECT event_id, max(vote) AS top FROM v GROUP BY 1),
s AS (SELECT event_id, sum(exp(vote - top)) AS s FROM v JOIN t USING (event_id) GROUP BY 1),
b AS (SELECT event_id, min(y) AS y_pred FROM v JOIN t USING (event_id) WHERE vote = top GROUP BY 1)
SELECT e.event_id, b.y_pred, {Q6("CASE WHEN hit THEN 1.0 ELSE 1 / s END")} AS proba
FROM e LEFT JOIN b USING (event_id) LEFT JOIN s USING (event_id) LEFT JOIN z USING (event_id)
""",
)
def knn_classifier_window(spark, sf):
    """Type of every event from the 5 nearest of the 100 events before it, votes weighted by distance."""
    e = T(spark, sf, "events").select("event_id", "event_type", "value", F.hour("ts").cast("double").alias("h"))
    near = N.window_neighbors(e, ["value", "h"], "event_type", None, "event_id", k=5, window_size=100)
    out = N.knn_classify(near)
    return out.select("event_id", "y_pred", q6(F.col("y_proba")[F.col("y_pred")]).alias("proba"))


@query(
    "knn_regressor_window",
    sql=f"""
WITH e AS (SELECT event_id, user_id, CAST(hour(ts) AS DOUBLE) AS h, CAST(event_id % 97 AS DOUBLE) AS g, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r, event_type FROM events),
d AS (SELECT a.event_id, b.value AS v, abs(a.h - b.h) + abs(a.g - b.g) AS d, b.r
      FROM e a JOIN e b ON a.event_type = b.event_type AND b.r BETWEEN a.r - 100 AND a.r - 1),
n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, r) AS k FROM d QUALIFY k <= 5),
a AS (SELECT event_id, max(CASE WHEN k = 1 AND d = 0 THEN v END) AS hit, avg(v) AS mean, median(v) AS median, sum(v / nullif(d, 0)) / sum(1 / nullif(d, 0)) AS weighted FROM n GROUP BY 1)
SELECT event_id, {Q6("coalesce(hit, mean, 0)")} AS mean, {Q6("coalesce(hit, median, 0)")} AS median, {Q6("coalesce(hit, weighted, 0)")} AS weighted
FROM e LEFT JOIN a USING (event_id)
""",
)
def knn_regressor_window(spark, sf):
    """Value of every event from the 5 nearest (Manhattan) of the 100 before it of its type: mean, median, weighted mean."""
    e = T(spark, sf, "events").select("event_id", "event_type", "value", F.hour("ts").cast("double").alias("h"), (F.col("event_id") % 97).cast("double").alias("g"))
    near = N.window_neighbors(e, ["h", "g"], "value", "event_type", "event_id", k=5, window_size=100, p=1)
    for how in ("mean", "median", "weighted_mean"):
        near = N.knn_regress(near, how=how, name=how)
    return near.select("event_id", q6("mean").alias("mean"), q6("median").alias("median"), q6("weighted_mean").alias("weighted"))


@query(
    "knn_join",
    sql=f"""
WITH t AS (SELECT o_orderkey, o_orderpriority, o_totalprice / 1000 AS a, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS b, CAST(o_custkey AS DOUBLE) AS c FROM orders),
d AS (SELECT q.o_orderkey, t.o_orderkey AS id, t.o_orderpriority AS y, sqrt((q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b) + (q.c - t.c) * (q.c - t.c)) AS d
      FROM t q JOIN t ON t.o_orderkey <> q.o_orderkey WHERE q.o_orderkey % 20 = 0)
SELECT o_orderkey, id, y, {Q6("d")} AS d, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY d, id) AS INTEGER) AS rank FROM d) WHERE rank <= 5
""",
)
def knn_join(spark, sf):
    """The 5 orders most like each order whose key is divisible by 20, in price, day and customer number."""
    day = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("double")
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_totalprice") / 1000).alias("a"), day.alias("b"), F.col("o_custkey").cast("double").alias("c"))
    near = N.knn_join(o.filter("o_orderkey % 20 = 0"), o, ["a", "b", "c"], "o_orderkey", "o_orderkey", "o_orderpriority")
    rows = near.select("o_orderkey", F.posexplode("neighbors").alias("at", "n"))
    return rows.select("o_orderkey", F.col("n.id").alias("id"), F.col("n.y").alias("y"), q6("n.d").alias("d"), (F.col("at") + 1).alias("rank"))
