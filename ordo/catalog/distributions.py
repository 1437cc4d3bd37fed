"""Distributions, Gaussian naive Bayes, differencing, label combinations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distributions as D
from ..queries import Q6, T, q6, query

_NB = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def _pdf(x: str, mu: str, s2: str) -> str:
    return f"CASE WHEN {s2} > 0 THEN exp(-({x} - {mu}) * ({x} - {mu}) / (2 * {s2})) / sqrt(2 * pi() * {s2}) ELSE 0.0 END"


@query(
    "gaussian_density",
    sql=f"""
WITH f AS (SELECT user_id, avg(value) AS mu, coalesce(var_samp(value), 0.0) AS s2 FROM events GROUP BY user_id)
SELECT event_id, user_id, {Q6(_pdf("value", "mu", "s2"))} AS pdf FROM events JOIN f USING (user_id)
""",
)
def gaussian_density(spark, sf):
    """Density of each event's value among its user's values."""
    e = T(spark, sf, "events").select("event_id", "user_id", "value")
    return D.gaussian_density(e, "value", "user_id").select("event_id", "user_id", q6("pdf").alias("pdf"))


@query(
    "multinomial_pmf",
    sql=f"""
SELECT user_id, event_type, n, {Q6("n / sum(n) OVER (PARTITION BY user_id)")} AS pmf
FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2)
""",
)
def multinomial_pmf(spark, sf):
    """Share of each event type among a user's events."""
    out = D.multinomial_pmf(T(spark, sf, "events").select("user_id", "event_type"), "event_type", "user_id")
    return out.select("user_id", "event_type", "n", q6("pmf").alias("pmf"))


_TERMS = " + ".join(f"ln(1e-9 + {_pdf('l.' + f, 'c.mu_' + f, 'c.s2_' + f)})" for f in _NB)


@query(
    "naive_bayes_gaussian",
    sql="WITH f AS (SELECT unnest(range(3)) AS fold), c AS (SELECT fold, l_returnflag AS label, count(*) AS n, "
    + ", ".join(f"avg({f}) AS mu_{f}, coalesce(var_samp({f}), 0.0) AS s2_{f}" for f in _NB)
    + " FROM lineitem JOIN f ON fold <> l_orderkey % 3 GROUP BY 1, 2), l AS (SELECT row_number() OVER () AS rid, * FROM lineitem), "
    f"s AS (SELECT rid, l_orderkey, l_linenumber, label, ln(n / (SELECT sum(n) FROM c o WHERE o.fold = c.fold)) + {_TERMS} AS score FROM l JOIN c ON fold = l_orderkey % 3) "
    f"SELECT any_value(l_orderkey) AS l_orderkey, any_value(l_linenumber) AS l_linenumber, arg_max(label, score) AS y_pred, "
    f"{Q6('max(score)')} AS score FROM s GROUP BY rid",
)
def naive_bayes_gaussian(spark, sf):
    """Return flag of each line by Gaussian naive Bayes over four measures, fitted on the orders of the other two thirds."""
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *_NB, (F.col("l_orderkey") % 3).alias("fold"))
    out = D.gaussian_nb_predict(li, D.gaussian_nb_fit(li, _NB, "l_returnflag", "fold"), _NB, "l_returnflag", "fold")
    return out.select("l_orderkey", "l_linenumber", "y_pred", q6("score").alias("score"))


_W = "OVER (PARTITION BY user_id ORDER BY event_id)"


@query(
    "difference",
    sql=f"""
SELECT event_id, user_id,
  {Q6(f"value - coalesce(lag(value, 1) {_W}, 0.0)")} AS d1,
  {Q6(f"value - 2 * coalesce(lag(value, 1) {_W}, 0.0) + coalesce(lag(value, 2) {_W}, 0.0)")} AS d2,
  {Q6(f"value - coalesce(lag(value, 1) {_W}, 0.0) - coalesce(lag(value, 7) {_W}, 0.0) + coalesce(lag(value, 8) {_W}, 0.0)")} AS d1_season7
FROM events
""",
)
def difference(spark, sf):
    """First, second, and first seasonal differences of each user's values."""
    out = T(spark, sf, "events").select("event_id", "user_id", "value")
    for name, steps in (("d1", ((1, 1),)), ("d2", ((2, 1),)), ("d1_season7", ((1, 1), (1, 7)))):
        out = D.difference(out, "value", "user_id", "event_id", steps, name)
    return out.select("event_id", "user_id", *[q6(c).alias(c) for c in ("d1", "d2", "d1_season7")])


@query(
    "label_powerset",
    sql="SELECT doc_id, quality, toxic, CAST(dense_rank() OVER (ORDER BY quality NULLS FIRST, toxic NULLS FIRST) - 1 AS INT) "
    "AS combination FROM labels",
)
def label_powerset(spark, sf):
    """Class number of each document's (quality, toxic) combination."""
    coded, _ = D.label_powerset(T(spark, sf, "labels").select("doc_id", "quality", "toxic"), ["quality", "toxic"])
    return coded.select("doc_id", "quality", "toxic", "combination")
