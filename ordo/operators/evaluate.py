"""Stream evaluation: delayed labels, progressive (prequential) scoring.

With labels arriving ``delay`` after the question, a model may only use
answers released before the question.  For per-key statistics this is a
RANGE frame ending ``delay`` before the question time (an as-of join done
by the window operator, no join needed).  The metric is then accumulated in
the order answers are released: (question time + delay, row id).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import Stat
from .windows import _as_list, _window, running, time_image


def delayed_events(df: DataFrame, id_col: str, time_col: str, y: str, delay_us: int) -> DataFrame:
    """Question/answer event table: each row is asked at ``t`` (y unknown)
    and answered at ``t + delay``; answers sort before questions at the same
    instant, then by row id."""
    t = time_image(df, time_col)
    q = df.select(F.col(id_col).alias("id"), t.alias("event_us"), F.lit("question").alias("kind"),
                  F.lit(None).cast(df.schema[y].dataType).alias("y"), F.lit(1).alias("kind_rank"))
    a = df.select(F.col(id_col).alias("id"), (t + F.lit(delay_us)).alias("event_us"), F.lit("answer").alias("kind"),
                  F.col(y).alias("y"), F.lit(0).alias("kind_rank"))
    return q.unionByName(a)


def delayed_target_agg(df: DataFrame, y: str, how: str, by, time_col: str, delay_us: int, name: str | None = None,
                       **params) -> DataFrame:
    """Per-key statistic of targets whose answers were released by the
    question time: rows with t' + delay <= t."""
    by = _as_list(by)
    name = name or f"{y}_{how}_delayed"
    d = df.withColumn("_ordo_us", time_image(df, time_col))
    w = _window(by, ["_ordo_us"]).rangeBetween(Window.unboundedPreceding, -delay_us)
    stat = Stat.of(how, y, **params)
    return d.withColumn(name, stat.native(lambda a: a.over(w))).drop("_ordo_us")


def progressive_metric(df: DataFrame, y_true: str, y_pred: str, time_col: str, id_col: str, delay_us: int = 0,
                       metric: str = "mae") -> DataFrame:
    """Running metric over answers in release order (t + delay, id).
    Rows whose prediction is NULL are not scored.  Adds ``answer_no`` and
    the metric as of that answer; key-less, so the running mean is split
    into order blocks."""
    d = df.filter(F.col(y_pred).isNotNull())
    d = d.withColumn("_release", time_image(d, time_col) + F.lit(delay_us))
    err = {
        "mae": F.abs(F.col(y_true) - F.col(y_pred)),
        "mse": (F.col(y_true) - F.col(y_pred)) ** 2,
        "rmse": (F.col(y_true) - F.col(y_pred)) ** 2,
        "accuracy": (F.col(y_true) == F.col(y_pred)).cast("double"),
    }[metric]
    d = d.withColumn("_err", err.cast("double"))
    d = running(d, {metric: Stat.of("mean", "_err"), "answer_no": Stat.of("count", "_err")}, by=None,
                order=["_release", id_col])
    if metric == "rmse":
        d = d.withColumn(metric, F.sqrt(metric))
    return d.drop("_err")


def horizon_eval(df: DataFrame, series: Sequence[str] | str, t_col: str, y: str, forecasts: DataFrame,
                 grace_period: int = 1, complete: bool = False) -> DataFrame:
    """(h, mae, n): per-horizon mean absolute error of forecasts (series, t, h, yhat).

    A forecast of row t is set against the value of row t + h; rows before
    ``grace_period`` are not scored.  ``complete``: only rows with values at
    all their horizons are.
    """
    series = _as_list(series)
    actual = df.select(*series, F.col(t_col).alias("_target_t"), F.col(y).alias("_y")).filter(F.col("_y").isNotNull())
    f = forecasts.filter(F.col(t_col) >= grace_period).withColumn("_target_t", F.col(t_col) + F.col("h"))
    j = f.join(actual, [*series, "_target_t"]).select(*series, t_col, "h", F.abs(F.col("_y") - F.col("yhat")).alias("_e"))
    if complete:
        asked = forecasts.groupBy(*series, t_col).agg(F.count(F.lit(1)).alias("_n"))
        met = j.groupBy(*series, t_col).agg(F.count(F.lit(1)).alias("_n"))
        j = j.join(asked.join(met, [*series, t_col, "_n"], "left_semi"), [*series, t_col], "left_semi")
    return j.groupBy("h").agg(F.avg("_e").alias("mae"), F.count(F.lit(1)).alias("n"))
