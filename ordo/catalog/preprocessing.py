"""Imputers, scalers, row transforms, encoders and random features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compose, preprocessing as P
from ..queries import Q6, T, q6, query

_EV = "PARTITION BY user_id ORDER BY event_id"
_RUN = f"{_EV} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _events_with_gaps(spark, sf):
    # values of 'error' events are treated as missing
    e = T(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return e.withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))


_GAPS = "(SELECT event_id, user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"


@query(
    "impute_previous_and_mean",
    sql=f"""
SELECT event_id, user_id,
  last_value(value IGNORE NULLS) OVER ({_RUN}) AS value_prev,
  {Q6(f"coalesce(value, coalesce(avg(value) OVER ({_RUN}), 0.0))")} AS value_mean_imputed
FROM {_GAPS} g
""",
)
def impute_previous_and_mean(spark, sf):
    e = _events_with_gaps(spark, sf)
    a = P.impute_previous(e.withColumn("value_prev", F.col("value")), ["value_prev"], "user_id", "event_id")
    b = P.impute_stat(a.withColumn("value_mean_imputed", F.col("value")), ["value_mean_imputed"], "user_id",
                      "event_id", how="mean")
    return b.select("event_id", "user_id", "value_prev", q6("value_mean_imputed").alias("value_mean_imputed"))


@query(
    "scalers_running",
    headline=True,
    sql=f"""
SELECT event_id, user_id,
  {Q6("CASE WHEN var_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / sqrt(var_pop(value) OVER w) ELSE 0.0 END")}
    AS value_std,
  {Q6("CASE WHEN max(value) OVER w - min(value) OVER w <> 0 THEN (value - min(value) OVER w) / "
      "(max(value) OVER w - min(value) OVER w) ELSE 0.0 END")} AS value_minmax,
  {Q6("CASE WHEN max(abs(value)) OVER w <> 0 THEN value / max(abs(value)) OVER w ELSE 0.0 END")} AS value_maxabs,
  {Q6("CASE WHEN quantile_cont(value, 0.75) OVER w - quantile_cont(value, 0.25) OVER w <> 0 THEN "
      "(value - quantile_cont(value, 0.5) OVER w) / (quantile_cont(value, 0.75) OVER w - quantile_cont(value, 0.25) OVER w) "
      "ELSE 0.0 END")} AS value_robust
FROM events WINDOW w AS ({_RUN})
""",
)
def scalers_running(spark, sf):
    """Standard, min-max, max-abs and robust scaling with running statistics."""
    e = T(spark, sf, "events").select("event_id", "user_id", "value")
    e = e.withColumns({"value_std": F.col("value"), "value_minmax": F.col("value"), "value_maxabs": F.col("value"),
                       "value_robust": F.col("value")})
    e = P.standard_scale(e, ["value_std"], "user_id", "event_id")
    e = P.minmax_scale(e, ["value_minmax"], "user_id", "event_id")
    e = P.maxabs_scale(e, ["value_maxabs"], "user_id", "event_id")
    e = P.robust_scale(e, ["value_robust"], "user_id", "event_id")
    cols = ["value_std", "value_minmax", "value_maxabs", "value_robust"]
    return e.select("event_id", "user_id", *[q6(c).alias(c) for c in cols])


@query(
    "ew_standard_scale",
    sql=f"""
WITH a AS (SELECT event_id, user_id, value, row_number() OVER ({_EV}) AS rn FROM events),
b AS (SELECT event_id, user_id, value,
        pow(0.7, rn - 1) * sum(CASE WHEN rn = 1 THEN 1.0 ELSE 0.3 END * value * pow(0.7, 1 - rn)) OVER ({_RUN}) AS m1,
        pow(0.7, rn - 1) * sum(CASE WHEN rn = 1 THEN 1.0 ELSE 0.3 END * value * value * pow(0.7, 1 - rn)) OVER ({_RUN}) AS m2
      FROM a)
SELECT event_id, user_id,
  {Q6("CASE WHEN m2 - m1 * m1 > 1e-9 THEN (value - m1) / sqrt(m2 - m1 * m1) ELSE 0.0 END")} AS value_ews
FROM b
""",
)
def ew_standard_scale(spark, sf):
    e = T(spark, sf, "events").select("event_id", "user_id", "value").withColumn("value_ews", F.col("value"))
    e = P.ew_standard_scale(e, ["value_ews"], "user_id", "event_id", alpha=0.3)
    return e.select("event_id", "user_id", q6("value_ews").alias("value_ews"))


_LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax"]


@query(
    "row_transforms",
    sql=f"""
SELECT {", ".join(_LI_KEY)},
  l_quantity > 25.0 AS q_bin,
  {Q6("l_discount / nullif(sqrt(l_discount * l_discount + l_tax * l_tax), 0)")} AS d_norm,
  {Q6("l_tax / nullif(sqrt(l_discount * l_discount + l_tax * l_tax), 0)")} AS t_norm,
  {Q6("l_discount * l_discount")} AS "l_discount*l_discount",
  {Q6("l_discount * l_tax")} AS "l_discount*l_tax",
  {Q6("l_tax * l_tax")} AS "l_tax*l_tax",
  {Q6("l_quantity * l_discount")} AS "l_quantity*l_discount",
  least(greatest(l_extendedprice / 1000.0, 5.0), 50.0) AS price_clipped
FROM lineitem
""",
)
def row_transforms(spark, sf):
    """Binarizer, L2 row normaliser, degree-2 polynomial, product features, clipping."""
    li = T(spark, sf, "lineitem").select(*_LI_KEY)
    li = li.withColumn("q_bin", F.col("l_quantity")).withColumns({"d_norm": F.col("l_discount"), "t_norm": F.col("l_tax")})
    li = P.binarize(li, ["q_bin"], threshold=25.0)
    li = P.normalize_row(li, ["d_norm", "t_norm"], order=2)
    li = compose.polynomial(li, ["l_tax", "l_discount"], degree=2)
    li = compose.product_features(li, ["l_quantity"], ["l_discount"])
    li = li.withColumn("price_clipped", F.col("l_extendedprice") / 1000.0)
    li = P.clip(li, "price_clipped", 5.0, 50.0)
    poly = ["l_discount*l_discount", "l_discount*l_tax", "l_tax*l_tax", "l_quantity*l_discount"]
    return li.select(*_LI_KEY, "q_bin", q6("d_norm").alias("d_norm"), q6("t_norm").alias("t_norm"),
                     *[q6(F.col(f"`{c}`")).alias(c) for c in poly], "price_clipped")


@query(
    "one_hot_running",
    sql="""
WITH f AS (SELECT event_type AS category, min(event_id) AS first FROM events WHERE event_type IS NOT NULL GROUP BY 1)
SELECT event_id, category, CAST(event_type = category AS INTEGER) AS value FROM events JOIN f ON event_id >= first
""",
)
def one_hot_running(spark, sf):
    """Dense one-hot of all types: 1 for the row's type, 0 for types seen before, one row each."""
    e = T(spark, sf, "events").select("event_id", "event_type")
    out = compose.one_hot_dense(e, "event_type", order=["event_id"])
    cells = [F.struct(F.lit(c.removeprefix("event_type_")).alias("category"), F.col(c).alias("value")) for c in out.columns[2:]]
    return out.select("event_id", F.explode(F.array(*cells)).alias("c")).select("event_id", "c.*").filter("value IS NOT NULL")


@query("one_hot_sparse_and_hash")
def one_hot_sparse_and_hash(spark, sf):
    """Sparse one-hot map and hashed features (xxhash64 buckets) per order."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    o = compose.one_hot_map(o, ["o_orderstatus", "o_orderpriority"])
    return compose.feature_hash(o, ["o_orderstatus", "o_orderpriority", "o_totalprice"], n_features=1024)


_A, _C, _M = 1103515245, 12345, 2147483648


def _u(k: str) -> str:
    return f"((({_A} * ({k}) + {_C}) % {_M}) + 0.5) / {float(_M)}"


@query(
    "rbf_features",
    sql=f"""
WITH f AS (SELECT * FROM (VALUES (0, 'value', 0), (1, 'user_id', 0)) t(fi, feature, s)),
c AS (SELECT f.fi, f.feature, r.range AS j, CAST(f.fi * 10007 + r.range AS BIGINT) AS k
      FROM f CROSS JOIN range(4) r),
w AS (SELECT feature, CAST(j AS INTEGER) AS j,
        sqrt(2 * 0.5) * sqrt(-2.0 * ln({_u("3 * k")})) * cos(2 * pi() * {_u("3 * k + 1")}) AS w,
        2 * pi() * {_u("3 * k + 2")} AS b FROM c),
x AS (SELECT event_id, 'value' AS feature, value / 100.0 AS x FROM events
      UNION ALL SELECT event_id, 'user_id' AS feature, user_id / 100.0 AS x FROM events)
SELECT event_id, x.feature, w.j, {Q6("cos(x.x * w.w + w.b)")} AS value FROM x JOIN w ON x.feature = w.feature
""",
)
def rbf_features(spark, sf):
    """Random Fourier features cos(x·w + b), 4 components, gamma 0.5."""
    e = T(spark, sf, "events").select("event_id", (F.col("value") / 100.0).alias("value"),
                                      (F.col("user_id") / 100.0).alias("user_id"))
    out = compose.rbf_features(e, ["event_id"], ["value", "user_id"], n_components=4, gamma=0.5, seed=0)
    return out.select("event_id", "feature", "j", q6("value").alias("value"))


@query(
    "target_standardize",
    sql=f"""
SELECT o_orderkey,
  {Q6("CASE WHEN count(o_totalprice) OVER w > 1 AND var_samp(o_totalprice / 1000.0) OVER w > 0 "
      "THEN (o_totalprice / 1000.0 - avg(o_totalprice / 1000.0) OVER w) / sqrt(var_samp(o_totalprice / 1000.0) OVER w) "
      "ELSE 0.0 END")} AS y_scaled
FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""",
)
def target_standardize(spark, sf):
    """Target scaled for training by the customer's mean/std, its own row included."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_totalprice") / 1000.0).alias("y"))
    out = P.target_standardize(o, "y", "o_custkey", ["o_orderdate", "o_orderkey"], name="y_scaled")
    return out.select("o_orderkey", q6("y_scaled").alias("y_scaled"))
