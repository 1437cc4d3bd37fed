"""Combinations of simple forecasts of every event's value and type."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import Stat
from ..operators import ensemble as EN, windows as W
from ..queries import Q6, T, q6, query

_U = "PARTITION BY user_id ORDER BY event_id"
_BEFORE = f"{_U} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_P = f"""p AS (SELECT event_id, user_id, value, lag(value) OVER ({_U}) AS last, coalesce(avg(value) OVER ({_BEFORE}), 0) AS mean, 100.0::DOUBLE AS fixed FROM events)"""


def _models(spark, sf):
    e = T(spark, sf, "events").select("event_id", "user_id", "value")
    e = W.lagged(e, {"last": (F.col("value"), 1, None)}, "user_id", "event_id")
    e = W.running(e, {"mean": Stat.of("mean", "value")}, by="user_id", order="event_id", lagged=True)
    return e.withColumn("fixed", F.lit(100.0))


def _weights(rate: float) -> str:
    names = ("last", "mean", "fixed")
    sums = ", ".join(f"coalesce(sum(pow(value - {n}, 2)) OVER ({_BEFORE}), 0) AS s_{n}" for n in names)
    have = ", ".join(f"CASE WHEN {n} IS NOT NULL THEN s_{n} END" for n in names)
    w = {n: f"coalesce(exp(-{rate} * (CASE WHEN {n} IS NOT NULL THEN s_{n} END - least({have}))), 0)" for n in names}
    over = " + ".join(f"{w[n]} * coalesce({n}, 0)" for n in names)
    return f"WITH {_P}, s AS (SELECT *, {sums} FROM p) SELECT event_id, {Q6(f'({over}) / ({" + ".join(w.values())})')} AS y_pred FROM s"


@query("expert_weighting", sql=_weights(0.0001))
def expert_weighting(spark, sf):
    """Value of every event from its user's last value, mean and a constant, weighted by their squared errors so far."""
    out = EN.expert_weighting(_models(spark, sf), ["last", "mean", "fixed"], "value", "event_id", "user_id", learning_rate=0.0001)
    return out.select("event_id", q6("y_pred").alias("y_pred"))


_ERR = ", ".join(f"coalesce(sum(abs(value - {n})) OVER ({_BEFORE}) / nullif(count({n}) OVER ({_BEFORE}), 0), 'inf'::DOUBLE) AS e_{n}" for n in ("last", "mean", "fixed"))


@query(
    "greedy_selection",
    sql=f"""
WITH {_P}, s AS (SELECT *, {_ERR} FROM p),
b AS (SELECT *, CASE WHEN e_last <= e_mean AND e_last <= e_fixed THEN 'last' WHEN e_mean <= e_fixed THEN 'mean' ELSE 'fixed' END AS model FROM s)
SELECT event_id, model, {Q6("CASE model WHEN 'last' THEN last WHEN 'mean' THEN mean ELSE fixed END")} AS y_pred FROM b
""",
)
def greedy_selection(spark, sf):
    """Value of every event from whichever of the three has the least mean absolute error for the user so far."""
    out = EN.greedy_selection(_models(spark, sf), ["last", "mean", "fixed"], "value", "event_id", "user_id")
    return out.select("event_id", "model", q6("y_pred").alias("y_pred"))


@query(
    "voting",
    sql=f"""
WITH p AS (SELECT event_id, unnest([lag(event_type, 1) OVER ({_U}), lag(event_type, 2) OVER ({_U}), lag(event_type, 3) OVER ({_U})]) AS v FROM events),
c AS (SELECT event_id, v, count(v) AS n FROM p GROUP BY 1, 2),
r AS (SELECT event_id, v, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, v) AS k FROM c WHERE v IS NOT NULL)
SELECT e.event_id, r.v AS y_pred FROM events e LEFT JOIN r ON r.event_id = e.event_id AND r.k = 1
""",
)
def voting(spark, sf):
    """Type of every event by the vote of the user's last three."""
    e = T(spark, sf, "events").select("event_id", "user_id", "event_type")
    e = W.lagged(e, {f"v{i}": (F.col("event_type"), i, None) for i in (1, 2, 3)}, "user_id", "event_id")
    return EN.voting(e, ["v1", "v2", "v3"]).select("event_id", "y_pred")


@query(
    "rank_items",
    sql="""
WITH s AS (SELECT o_custkey, l_partkey, sum(l_quantity) AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT * FROM (SELECT o_custkey, l_partkey, score, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, l_partkey) AS INTEGER) AS rank FROM s) WHERE rank <= 5
""",
)
def rank_items(spark, sf):
    """The five parts that each customer ordered most of."""
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = T(spark, sf, "orders").select("o_orderkey", "o_custkey")
    s = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_custkey", "l_partkey").agg(F.sum("l_quantity").alias("score"))
    return EN.rank_items(s, "o_custkey", "l_partkey", "score", 5)
