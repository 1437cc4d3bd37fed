"""Running (as-of-every-row) univariate and bivariate statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import Stat
from ..operators import features, windows
from ..queries import Q6, T, q6, query

# events: key user_id, order event_id (unique, increasing with ts), x = value
_EV_W = "PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_LI_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
             "l_extendedprice", "l_discount", "l_tax"]


@query(
    "target_agg_mean",
    headline=True,
    sql=f"""
SELECT o_orderkey, o_custkey,
  {Q6("coalesce(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey "
      "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)")} AS o_totalprice_mean_by_o_custkey
FROM orders
""",
)
def target_agg_mean(spark, sf):
    """Mean previous order value per customer before each order (no leakage)."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    out = features.target_agg(o, "o_totalprice", "mean", by="o_custkey", order=["o_orderdate", "o_orderkey"])
    name = "o_totalprice_mean_by_o_custkey"
    return out.select("o_orderkey", "o_custkey", q6(name).alias(name))


_MOMENTS = {
    "value_sum": ("sum", {}, "sum(value) OVER w"),
    "value_mean": ("mean", {}, "avg(value) OVER w"),
    "value_var": ("var", {}, "CASE WHEN count(value) OVER w > 1 THEN var_samp(value) OVER w ELSE 0.0 END"),
    "value_std": ("std", {}, "CASE WHEN count(value) OVER w > 1 THEN sqrt(var_samp(value) OVER w) ELSE 0.0 END"),
    "value_sem": ("sem", {}, "sqrt(CASE WHEN count(value) OVER w > 1 THEN var_samp(value) OVER w ELSE 0.0 END "
                             "/ count(value) OVER w)"),
    "value_var_pop": ("var", {"ddof": 0}, "var_pop(value) OVER w"),
    "value_bayes_mean": ("bayes_mean", {"prior": 100.0, "prior_weight": 5.0},
                         "(sum(value) OVER w + 500.0) / (count(value) OVER w + 5.0)"),
}


@query(
    "agg_running_moments",
    headline=True,
    sql="SELECT event_id, user_id, count(*) OVER w AS value_count, "
    + ", ".join(f"{Q6(sql)} AS {name}" for name, (_, _, sql) in _MOMENTS.items())
    + f" FROM events WINDOW w AS ({_EV_W})",
)
def agg_running_moments(spark, sf):
    """count/sum/mean/var/std/sem/bayes-mean of value per user as of each event."""
    e = T(spark, sf, "events").select("event_id", "user_id", "value")
    outs = {"value_count": Stat.of("count", "value")}
    outs.update({name: Stat.of(how, "value", **p) for name, (how, p, _) in _MOMENTS.items()})
    out = windows.running(e, outs, by="user_id", order="event_id")
    return out.select("event_id", "user_id", "value_count", *[q6(c).alias(c) for c in _MOMENTS])


@query(
    "agg_running_extrema",
    sql=f"""
SELECT event_id, user_id,
  min(value) OVER w AS value_min, max(value) OVER w AS value_max,
  max(abs(value)) OVER w AS value_abs_max,
  {Q6("max(value) OVER w - min(value) OVER w")} AS value_ptp
FROM events WINDOW w AS ({_EV_W})
""",
)
def agg_running_extrema(spark, sf):
    e = T(spark, sf, "events").select("event_id", "user_id", "value")
    outs = {
        "value_min": Stat.of("min", "value"),
        "value_max": Stat.of("max", "value"),
        "value_abs_max": Stat.of("abs_max", "value"),
        "value_ptp": Stat.of("ptp", "value"),
    }
    out = windows.running(e, outs, by="user_id", order="event_id")
    return out.select("event_id", "user_id", "value_min", "value_max", "value_abs_max", q6("value_ptp").alias("value_ptp"))


_GW = "ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@query(
    "global_running_mean",
    headline=True,
    sql=f"""
SELECT event_id,
  {Q6(f"avg(value) OVER ({_GW})")} AS value_mean,
  {Q6(f"CASE WHEN count(*) OVER ({_GW}) > 1 THEN var_samp(value) OVER ({_GW}) ELSE 0.0 END")} AS value_var,
  max(value) OVER ({_GW}) AS value_max
FROM events
""",
)
def global_running_mean(spark, sf):
    """Key-less running statistics: split into order-range blocks, never one task."""
    e = T(spark, sf, "events").select("event_id", "value")
    outs = {
        "value_mean": Stat.of("mean", "value"),
        "value_var": Stat.of("var", "value"),
        "value_max": Stat.of("max", "value"),
    }
    out = windows.running(e, outs, by=None, order="event_id")
    return out.select("event_id", q6("value_mean").alias("value_mean"), q6("value_var").alias("value_var"), "value_max")


@query(
    "target_agg_var_by_status",
    sql=f"""
SELECT o_orderkey,
  {Q6("CASE WHEN count(o_totalprice) OVER w > 1 THEN var_samp(o_totalprice / 1000.0) OVER w ELSE 0.0 END")}
    AS price_k_var_by_o_orderstatus,
  count(*) OVER w AS price_k_count_by_o_orderstatus
FROM orders
WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""",
)
def target_agg_var_by_status(spark, sf):
    """Lagged target statistics over a low-cardinality (hot) key."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate",
                                      (F.col("o_totalprice") / 1000.0).alias("price_k"))
    outs = {
        "price_k_var_by_o_orderstatus": Stat.of("var", "price_k"),
        "price_k_count_by_o_orderstatus": Stat.of("count", "price_k"),
    }
    out = windows.running(o, outs, by="o_orderstatus", order=["o_orderdate", "o_orderkey"], lagged=True)
    return out.select("o_orderkey", q6("price_k_var_by_o_orderstatus").alias("price_k_var_by_o_orderstatus"),
                      "price_k_count_by_o_orderstatus")


@query(
    "agg_running_cov_pearson",
    sql=f"""
SELECT {", ".join(_LI_ORDER)},
  {Q6("CASE WHEN count(*) OVER w > 1 THEN covar_samp(l_quantity, l_discount) OVER w ELSE 0.0 END")} AS qd_cov,
  {Q6("CASE WHEN var_pop(l_quantity) OVER w > 0 AND var_pop(l_discount) OVER w > 0 "
      "THEN covar_pop(l_quantity, l_discount) OVER w / sqrt(var_pop(l_quantity) OVER w * var_pop(l_discount) OVER w) "
      "ELSE 0.0 END")} AS qd_pearson
FROM lineitem
WINDOW w AS (PARTITION BY l_returnflag ORDER BY {", ".join(_LI_ORDER)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""",
)
def agg_running_cov_pearson(spark, sf):
    """Running covariance / Pearson per return flag (three very hot keys)."""
    li = T(spark, sf, "lineitem").select("l_returnflag", *_LI_ORDER)
    outs = {"qd_cov": Stat.of("cov", "l_quantity", "l_discount"),
            "qd_pearson": Stat.of("pearson", "l_quantity", "l_discount")}
    out = windows.running(li, outs, by="l_returnflag", order=_LI_ORDER)
    return out.select(*_LI_ORDER, q6("qd_cov").alias("qd_cov"), q6("qd_pearson").alias("qd_pearson"))


@query(
    "agg_state_grouped",
    sql=f"""
SELECT l_returnflag, l_linestatus, count(*) AS l_quantity_count,
  {Q6("avg(l_quantity)")} AS l_quantity_mean,
  {Q6("var_samp(l_quantity)")} AS l_quantity_var,
  min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max,
  {Q6("skewness(l_quantity)")} AS l_quantity_skew,
  {Q6("kurtosis(l_quantity)")} AS l_quantity_kurtosis,
  {Q6("quantile_cont(l_quantity, 0.5)")} AS l_quantity_median,
  {Q6("quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25)")} AS l_quantity_iqr
FROM lineitem GROUP BY l_returnflag, l_linestatus
""",
)
def agg_state_grouped(spark, sf):
    """Final per-group statistics: partial + final hash aggregate, no window."""
    li = T(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    outs = {
        "l_quantity_count": Stat.of("count", "l_quantity"),
        "l_quantity_mean": Stat.of("mean", "l_quantity"),
        "l_quantity_var": Stat.of("var", "l_quantity"),
        "l_quantity_min": Stat.of("min", "l_quantity"),
        "l_quantity_max": Stat.of("max", "l_quantity"),
        "l_quantity_skew": Stat.of("skew", "l_quantity"),
        "l_quantity_kurtosis": Stat.of("kurtosis", "l_quantity"),
        "l_quantity_median": Stat.of("quantile", "l_quantity", q=0.5),
        "l_quantity_iqr": Stat.of("iqr", "l_quantity"),
    }
    out = windows.grouped(li, outs, by=["l_returnflag", "l_linestatus"])
    exact = {"l_returnflag", "l_linestatus", "l_quantity_count", "l_quantity_min", "l_quantity_max"}
    return out.select(*[F.col(c) if c in exact else q6(c).alias(c) for c in out.columns])


_COV_COLS = ["l_discount", "l_quantity", "l_tax"]


@query(
    "cov_matrix",
    sql="SELECT l_returnflag, a, b, " + Q6("cov") + " AS cov FROM ("
    + " UNION ALL ".join(
        f"SELECT l_returnflag, '{a}' AS a, '{b}' AS b, covar_samp({a}, {b}) AS cov FROM lineitem GROUP BY 1"
        for i, a in enumerate(_COV_COLS) for b in _COV_COLS[i:])
    + ")",
)
def cov_matrix(spark, sf):
    """Covariance matrix of three lineitem columns per return flag (long form)."""
    li = T(spark, sf, "lineitem").select("l_returnflag", *_COV_COLS)
    out = windows.cov_matrix(li, _COV_COLS, by="l_returnflag")
    return out.select("l_returnflag", "a", "b", q6("cov").alias("cov"))


@query(
    "projection_ops",
    sql="SELECT o_orderkey AS ev_o_orderkey, o_totalprice AS ev_price, o_orderstatus AS ev_o_orderstatus FROM orders",
)
def projection_ops(spark, sf):
    """Select, discard, rename and prefix on the orders table."""
    from ..operators import compose as C

    o = T(spark, sf, "orders")
    o = C.select(o, "o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey")
    o = C.discard(o, "o_custkey")
    o = C.rename(o, {"o_totalprice": "price", "missing_col": "ignored"})
    return C.prefix(o, "ev_")
