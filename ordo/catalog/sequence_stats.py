"""Order-dependent running statistics, rolling frames and time frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import Stat
from ..operators import sequence, windows
from ..queries import Q6, T, q6, query

_EV = "PARTITION BY user_id ORDER BY event_id"
_RUN = f"{_EV} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _events(spark, sf, *cols):
    return T(spark, sf, "events").select("event_id", "user_id", *cols)


@query(
    "running_skew_kurtosis",
    sql=f"""
SELECT event_id, user_id,
  {Q6("CASE WHEN var_pop(value) OVER w = 0 OR count(value) OVER w <= 2 THEN 0.0 ELSE skewness(value) OVER w END")}
    AS value_skew,
  {Q6("CASE WHEN var_pop(value) OVER w = 0 THEN "
      "(CASE WHEN count(value) OVER w > 3 THEN -3.0 * (count(value) OVER w - 1) * (count(value) OVER w - 1) "
      "/ ((count(value) OVER w - 2) * (count(value) OVER w - 3)) ELSE -3.0 END) "
      "WHEN count(value) OVER w > 3 THEN kurtosis(value) OVER w ELSE kurtosis_pop(value) OVER w END")}
    AS value_kurtosis
FROM events WINDOW w AS ({_RUN})
""",
)
def running_skew_kurtosis(spark, sf):
    """Bias-corrected skewness / excess kurtosis as of each event."""
    e = _events(spark, sf, "value")
    out = windows.running(e, {"value_skew": Stat.of("skew", "value"), "value_kurtosis": Stat.of("kurtosis", "value")},
                          by="user_id", order="event_id")
    return out.select("event_id", "user_id", q6("value_skew").alias("value_skew"),
                      q6("value_kurtosis").alias("value_kurtosis"))


@query(
    "running_quantile_iqr",
    sql=f"""
SELECT event_id, user_id,
  {Q6("quantile_cont(value, 0.5) OVER w")} AS value_median,
  {Q6("quantile_cont(value, 0.9) OVER w")} AS value_q90,
  {Q6("quantile_cont(value, 0.75) OVER w - quantile_cont(value, 0.25) OVER w")} AS value_iqr
FROM events WINDOW w AS ({_RUN})
""",
)
def running_quantile_iqr(spark, sf):
    e = _events(spark, sf, "value")
    outs = {"value_median": Stat.of("quantile", "value", q=0.5),
            "value_q90": Stat.of("quantile", "value", q=0.9),
            "value_iqr": Stat.of("iqr", "value")}
    out = windows.running(e, outs, by="user_id", order="event_id")
    return out.select("event_id", "user_id", *[q6(c).alias(c) for c in outs])


@query(
    "running_mad",
    sql=f"""
WITH m AS (SELECT event_id, user_id, value, quantile_cont(value, 0.5) OVER ({_RUN}) AS med FROM events)
SELECT event_id, user_id, {Q6(f"quantile_cont(abs(value - med), 0.5) OVER ({_RUN})")} AS value_mad FROM m
""",
)
def running_mad(spark, sf):
    out = sequence.mad(_events(spark, sf, "value"), "value", "user_id", "event_id")
    return out.select("event_id", "user_id", q6("value_mad").alias("value_mad"))


@query(
    "running_n_unique",
    sql=f"""
WITH f AS (SELECT event_id, user_id, event_id = min(event_id) OVER (PARTITION BY user_id, event_type) AS first
           FROM events)
SELECT event_id, user_id, CAST(sum(CASE WHEN first THEN 1 ELSE 0 END) OVER ({_RUN}) AS BIGINT) AS event_type_n_unique
FROM f
""",
)
def running_n_unique(spark, sf):
    out = sequence.running_n_unique(_events(spark, sf, "event_type"), "event_type", "user_id", "event_id")
    return out.select("event_id", "user_id", "event_type_n_unique")


@query(
    "running_entropy",
    sql=f"""
WITH c AS (SELECT event_id, user_id,
             count(*) OVER (PARTITION BY user_id, event_type ORDER BY event_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM events),
t AS (SELECT *, c * ln(c) - CASE WHEN c > 1 THEN (c - 1) * ln(c - 1) ELSE 0.0 END AS term FROM c)
SELECT event_id, user_id,
  {Q6(f"greatest(ln(count(*) OVER ({_RUN})) - sum(term) OVER ({_RUN}) / count(*) OVER ({_RUN}), 0.0)")}
    AS event_type_entropy
FROM t
""",
)
def running_entropy(spark, sf):
    out = sequence.running_entropy(_events(spark, sf, "event_type"), "event_type", "user_id", "event_id")
    return out.select("event_id", "user_id", q6("event_type_entropy").alias("event_type_entropy"))


@query(
    "running_mode",
    sql=f"""
WITH f AS (SELECT user_id, event_type, min(event_id) AS fpos FROM events GROUP BY user_id, event_type),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY fpos) AS rk FROM f),
e AS (SELECT e.event_id, e.user_id, e.event_type, r.rk,
        count(*) OVER (PARTITION BY e.user_id, e.event_type ORDER BY e.event_id
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
      FROM events e JOIN r ON e.user_id = r.user_id AND e.event_type = r.event_type)
SELECT event_id, user_id,
  arg_max(CASE WHEN rk > 0 THEN event_type END, CASE WHEN rk > 0 THEN c * 1000000 - rk END) OVER ({_RUN})
    AS event_type_mode
FROM e
""",
)
def running_mode(spark, sf):
    """Mode of the event type per user, all types counted."""
    out = sequence.running_mode(_events(spark, sf, "event_type"), "event_type", "user_id", "event_id")
    return out.select("event_id", "user_id", "event_type_mode")


@query(
    "shift_link_autocorr",
    sql=f"""
WITH l AS (SELECT event_id, user_id, value, lag(value, 1) OVER ({_EV}) AS lv FROM events)
SELECT event_id, user_id, lv AS value_shift_1,
  {Q6(f"coalesce(avg(lv) OVER ({_RUN}), 0.0)")} AS value_shift_mean,
  {Q6(f"CASE WHEN var_pop(CASE WHEN lv IS NOT NULL THEN value END) OVER ({_RUN}) > 0 AND var_pop(lv) OVER ({_RUN}) > 0 "
      f"THEN covar_pop(value, lv) OVER ({_RUN}) / sqrt(var_pop(CASE WHEN lv IS NOT NULL THEN value END) OVER ({_RUN}) "
      f"* var_pop(lv) OVER ({_RUN})) ELSE 0.0 END")} AS value_autocorr_1
FROM l
""",
)
def shift_link_autocorr(spark, sf):
    """Lag, a linked statistic (running mean of the lag) and lag-1 autocorrelation."""
    e = _events(spark, sf, "value")
    e = sequence.shift(e, "value", "user_id", "event_id", amount=1)
    e = sequence.link(e, "value", "user_id", "event_id", left="shift", right="mean", name="value_shift_mean")
    e = sequence.autocorr(e, "value", "user_id", "event_id", lag=1)
    return e.select("event_id", "user_id", "value_shift_1", q6("value_shift_mean").alias("value_shift_mean"),
                    q6("value_autocorr_1").alias("value_autocorr_1"))


@query(
    "ew_mean_var",
    sql=f"""
WITH a AS (SELECT event_id, user_id, value, row_number() OVER ({_EV}) AS rn FROM events),
b AS (SELECT event_id, user_id,
        pow(0.5, rn - 1) * sum(CASE WHEN rn = 1 THEN 1.0 ELSE 0.5 END * value * pow(2.0, rn - 1)) OVER ({_RUN}) AS m1,
        pow(0.5, rn - 1) * sum(CASE WHEN rn = 1 THEN 1.0 ELSE 0.5 END * value * value * pow(2.0, rn - 1)) OVER ({_RUN})
          AS m2
      FROM a)
SELECT event_id, user_id, {Q6("m1")} AS value_ewm, {Q6("m2 - m1 * m1")} AS value_ewv FROM b
""",
)
def ew_mean_var(spark, sf):
    """Exponentially weighted mean and variance (alpha = 0.5) per user."""
    e = _events(spark, sf, "value")
    e = sequence.ew_mean(e, "value", "user_id", "event_id", alpha=0.5, name="value_ewm")
    e = sequence.ew_var(e, "value", "user_id", "event_id", alpha=0.5, name="value_ewv")
    return e.select("event_id", "user_id", q6("value_ewm").alias("value_ewm"), q6("value_ewv").alias("value_ewv"))


_ROLL = f"{_EV} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW"


@query(
    "rolling_stats",
    headline=True,
    sql=f"""
SELECT event_id, user_id,
  {Q6("sum(value) OVER w")} AS value_rsum,
  {Q6("avg(value) OVER w")} AS value_rmean,
  {Q6("CASE WHEN count(value) OVER w > 1 THEN var_samp(value) OVER w ELSE 0.0 END")} AS value_rvar,
  {Q6("sqrt(CASE WHEN count(value) OVER w > 1 THEN var_samp(value) OVER w ELSE 0.0 END / count(value) OVER w)")}
    AS value_rsem,
  min(value) OVER w AS value_rmin, max(value) OVER w AS value_rmax, max(abs(value)) OVER w AS value_rabs_max,
  {Q6("max(value) OVER w - min(value) OVER w")} AS value_rptp,
  {Q6("quantile_cont(value, 0.5) OVER w")} AS value_rmedian,
  {Q6("quantile_cont(value, 0.75) OVER w - quantile_cont(value, 0.25) OVER w")} AS value_riqr
FROM events WINDOW w AS ({_ROLL})
""",
)
def rolling_stats(spark, sf):
    """Statistics over the last 10 events of each user."""
    e = _events(spark, sf, "value")
    outs = {
        "value_rsum": Stat.of("sum", "value"),
        "value_rmean": Stat.of("mean", "value"),
        "value_rvar": Stat.of("var", "value"),
        "value_rsem": Stat.of("sem", "value"),
        "value_rmin": Stat.of("min", "value"),
        "value_rmax": Stat.of("max", "value"),
        "value_rabs_max": Stat.of("abs_max", "value"),
        "value_rptp": Stat.of("ptp", "value"),
        "value_rmedian": Stat.of("quantile", "value", q=0.5),
        "value_riqr": Stat.of("iqr", "value"),
    }
    out = windows.rolling(e, outs, window=10, by="user_id", order="event_id")
    exact = {"value_rmin", "value_rmax", "value_rabs_max"}
    return out.select("event_id", "user_id", *[F.col(c) if c in exact else q6(c).alias(c) for c in outs])


@query(
    "rolling_cov_pearson",
    sql=f"""
SELECT event_id, user_id,
  {Q6("CASE WHEN count(*) OVER w > 1 THEN covar_samp(value, CAST(event_id AS DOUBLE)) OVER w ELSE 0.0 END")} AS rcov,
  {Q6("CASE WHEN var_pop(value) OVER w > 0 AND var_pop(CAST(event_id AS DOUBLE)) OVER w > 0 "
      "THEN covar_pop(value, CAST(event_id AS DOUBLE)) OVER w / sqrt(var_pop(value) OVER w * "
      "var_pop(CAST(event_id AS DOUBLE)) OVER w) ELSE 0.0 END")} AS rpearson
FROM events WINDOW w AS ({_ROLL})
""",
)
def rolling_cov_pearson(spark, sf):
    e = _events(spark, sf, "value").withColumn("t", F.col("event_id").cast("double"))
    out = windows.rolling(e, {"rcov": Stat.of("cov", "value", "t"), "rpearson": Stat.of("pearson", "value", "t")},
                          window=10, by="user_id", order="event_id")
    return out.select("event_id", "user_id", q6("rcov").alias("rcov"), q6("rpearson").alias("rpearson"))


@query(
    "rolling_mode",
    sql="""
WITH e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
c AS (SELECT a.event_id, a.user_id, b.event_type, count(*) AS n, min(b.r) AS first FROM e a JOIN e b ON b.user_id = a.user_id AND b.r BETWEEN a.r - 9 AND a.r GROUP BY 1, 2, 3)
SELECT event_id, user_id, event_type AS event_type_rmode FROM c QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC, first) = 1
""",
)
def rolling_mode(spark, sf):
    """Most frequent event type among each user's last 10 events (ties: earliest in window)."""
    e = _events(spark, sf, "event_type")
    return sequence.rolling_mode(e, "event_type", 10, "user_id", "event_id").select(
        "event_id", "user_id", "event_type_rmode")


_HOUR_US = 3_600_000_000


@query(
    "time_rolling_stats",
    headline=True,
    sql=f"""
WITH t AS (SELECT event_id, user_id, value, epoch_us(ts) AS us FROM events)
SELECT event_id, user_id,
  count(*) OVER w AS value_count_1d,
  {Q6("sum(value) OVER w")} AS value_sum_1d,
  {Q6("avg(value) OVER w")} AS value_mean_1d,
  {Q6("CASE WHEN count(value) OVER w > 1 THEN var_samp(value) OVER w ELSE 0.0 END")} AS value_var_1d,
  max(value) OVER w AS value_max_1d
FROM t WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {24 * _HOUR_US - 1} PRECEDING AND CURRENT ROW)
""",
)
def time_rolling_stats(spark, sf):
    """Statistics over each user's events in the last 24 hours, (t - 1 day, t]."""
    e = _events(spark, sf, "ts", "value")
    outs = {
        "value_count_1d": Stat.of("count", "value"),
        "value_sum_1d": Stat.of("sum", "value"),
        "value_mean_1d": Stat.of("mean", "value"),
        "value_var_1d": Stat.of("var", "value"),
        "value_max_1d": Stat.of("max", "value"),
    }
    out = windows.time_rolling(e, outs, period_us=24 * _HOUR_US, time_col="ts", by="user_id")
    exact = {"value_count_1d", "value_max_1d"}
    return out.select("event_id", "user_id", *[F.col(c) if c in exact else q6(c).alias(c) for c in outs])
