"""Forecasts of every user's daily total, and their errors by horizon."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as FC
from ..operators.evaluate import horizon_eval
from ..queries import Q6, T, q6, query

_DAYS, _M, _A, _B, _G, _H = 30, 7, 0.3, 0.1, 0.4, 3

_GRID = f"""d AS (SELECT user_id, date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS t, sum(value) AS y FROM events GROUP BY 1, 2),
g AS (SELECT u.user_id, t.t, coalesce(d.y, 0) AS y FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(range({_DAYS})) AS t) t
      LEFT JOIN d ON d.user_id = u.user_id AND d.t = t.t)"""
_SMOOTHED = f"""WITH RECURSIVE {_GRID},
i AS (SELECT user_id, avg(y) AS level, (max_by(y, t) - min_by(y, t)) / {_M - 1} AS trend FROM g WHERE t < {_M} GROUP BY 1),
hw(user_id, t, level, trend, season) AS (
  SELECT user_id, {_M - 1}::BIGINT, any_value(level), any_value(trend), list(CASE WHEN level = 0 THEN 0 ELSE y / level END ORDER BY t) FROM g JOIN i USING (user_id) WHERE t < {_M} GROUP BY 1
  UNION ALL
  SELECT user_id, t, l, {_B} * (l - level) + (1 - {_B}) * trend, list_append(season[2:], {_G} * (y - (level + trend)) + (1 - {_G}) * season[1])
  FROM (SELECT h.user_id, h.t + 1 AS t, h.level, h.trend, h.season, g.y, {_A} * (g.y - h.season[1]) + (1 - {_A}) * (h.level + h.trend) AS l
        FROM hw h JOIN g ON g.user_id = h.user_id AND g.t = h.t + 1)),
f AS (SELECT user_id, t + 1 AS t, h, level + h * trend + season[1 + (h - 1) % {_M}] AS yhat FROM hw, (SELECT unnest(range(1, {_H + 1})) AS h) WHERE t < {_DAYS - 1})"""


def _daily(spark, sf):
    e = T(spark, sf, "events").select("user_id", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("t"), "value")
    sums = e.groupBy("user_id", "t").agg(F.sum("value").alias("y"))
    days = e.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_DAYS - 1).cast("long"))).alias("t"))
    return days.join(sums, ["user_id", "t"], "left").fillna({"y": 0.0})


def _forecasts(daily):
    made = FC.forecast(daily, lambda: FC.HoltWinters(_A, _B, _G, _M), "y", "user_id", "t", _H)
    return FC.long_form(made)


@query("holt_winters", sql=f"{_SMOOTHED} SELECT user_id, t, CAST(h AS INTEGER) AS h, {Q6('yhat')} AS yhat FROM f")
def holt_winters(spark, sf):
    """Forecasts three days ahead of every user's daily total, made before each day: smoothed level, trend and weekly season."""
    return _forecasts(_daily(spark, sf)).select("user_id", "t", "h", q6("yhat").alias("yhat"))


@query(
    "horizon_eval",
    sql=f"""{_SMOOTHED}
SELECT CAST(h AS INTEGER) AS h, {Q6('avg(abs(g.y - yhat))')} AS mae, count(*) AS n FROM f JOIN g ON g.user_id = f.user_id AND g.t = f.t + f.h
WHERE f.t >= {_M + 2} GROUP BY 1""",
)
def horizon(spark, sf):
    """Mean absolute error of these forecasts by horizon, from the tenth day on."""
    daily = _daily(spark, sf)
    return horizon_eval(daily, "user_id", "t", "y", _forecasts(daily), grace_period=_M + 2).select("h", q6("mae").alias("mae"), "n")


@query("snarimax")
def snarimax(spark, sf):
    """One-day forecasts of every user's daily total by seasonal autoregression on first differences."""
    made = FC.forecast(_daily(spark, sf), lambda: FC.Snarimax(3, 1, 1, _M, 1, 0, 1, lr=0.01), "y", "user_id", "t", 1)
    return FC.long_form(made).select("user_id", "t", "h", q6("yhat").alias("yhat"))
