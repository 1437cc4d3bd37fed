"""Running shapes: blocked (hot-key split) plan == plain window plan."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ordo.functions.stats import Stat
from ordo.operators import windows
from ordo.plans import session as S

from paths import SF001


def _frame(df, cols):
    return df.select(*cols).toPandas().sort_values(cols[0]).reset_index(drop=True)


@pytest.fixture()
def force_hot(spark):
    spark.conf.set(S.CONF_HOT_ROWS, "5")
    spark.conf.set(S.CONF_MAX_HOT_KEYS, "1000000")
    spark.conf.set(S.CONF_BLOCKS, "7")
    yield
    for k in (S.CONF_HOT_ROWS, S.CONF_MAX_HOT_KEYS, S.CONF_BLOCKS):
        spark.conf.unset(k)


OUTS = {
    "n": Stat.of("count", "value"),
    "s": Stat.of("sum", "value"),
    "m": Stat.of("mean", "value"),
    "v": Stat.of("var", "value"),
    "v0": Stat.of("var", "value", ddof=0),
    "lo": Stat.of("min", "value"),
    "hi": Stat.of("max", "value"),
    "ptp": Stat.of("ptp", "value"),
    "c": Stat.of("cov", "value", "event_id"),
    "r": Stat.of("pearson", "value", "event_id"),
}


@pytest.mark.parametrize("lagged", [False, True])
def test_blocked_equals_plain(spark, force_hot, lagged):
    e = spark.read.parquet(f"{SF001}/events.parquet").select("event_id", "user_id", "value")
    blocked = windows.running(e, OUTS, by="user_id", order="event_id", lagged=lagged)
    plain = windows.running(e, OUTS, by="user_id", order="event_id", lagged=lagged, split_hot=False)
    cols = ["event_id", *OUTS]
    a, b = _frame(blocked, cols), _frame(plain, cols)
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9, atol=1e-9)


def test_global_running_matches_python(spark):
    e = spark.read.parquet(f"{SF001}/events.parquet").select("event_id", "value")
    out = windows.running(e, {"m": Stat.of("mean", "value"), "v": Stat.of("var", "value")}, order="event_id",
                          blocks=5)
    got = out.toPandas().sort_values("event_id")
    xs = got["value"].tolist()
    for i in range(0, len(xs), 97):
        pre = xs[: i + 1]
        mean = sum(pre) / len(pre)
        var = sum((x - mean) ** 2 for x in pre) / (len(pre) - 1) if len(pre) > 1 else 0.0
        assert math.isclose(got["m"].iloc[i], mean, rel_tol=1e-9)
        assert math.isclose(got["v"].iloc[i], var, rel_tol=1e-7, abs_tol=1e-9)


def test_lagged_empty_values(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", 4.0), (3, "b", 1.0)], "t long, k string, y double")
    out = windows.running(df, {"m": Stat.of("mean", "y"), "lo": Stat.of("min", "y"), "v": Stat.of("var", "y")},
                          by="k", order="t", lagged=True).orderBy("t").collect()
    assert [r.m for r in out] == [0.0, 2.0, 0.0]
    assert out[0].lo == math.inf and out[1].lo == 2.0
    assert [r.v for r in out] == [0.0, 0.0, 0.0]


def test_time_rolling_exclusive_lower_bound(spark):
    rows = [(0, 1.0), (1_000_000, 2.0), (2_000_000, 4.0)]
    df = spark.createDataFrame(rows, "us long, y double").withColumn(
        "ts", F.timestamp_micros("us").cast("timestamp_ntz"))
    out = windows.time_rolling(df, {"s": Stat.of("sum", "y")}, period_us=1_000_000, time_col="ts")
    got = [r.s for r in out.orderBy("us").collect()]
    assert got == [1.0, 2.0, 4.0]


def test_key_less_running_over_a_string_order(spark):
    rows = [(c + d, 1.0) for c in "zaéb" for d in ("", "x", "long tail", "long tale")]
    df = spark.createDataFrame(rows, "t string, y double")
    out = windows.running(df, {"n": Stat.of("count", "y")}, order="t", blocks=5).collect()
    places = {t: i + 1 for i, (t, _) in enumerate(sorted(rows, key=lambda r: r[0].encode()))}
    assert {r.t: r.n for r in out} == places


@pytest.mark.parametrize("alpha", [0.5, 0.05, 0.999])
def test_ew_mean_keeps_all_history_and_restarts_at_zero(spark, alpha):
    from ordo.operators import sequence

    xs = [0.0, 0.0, 5.0, 1e300, *[1e-9] * 1500, 3.0]
    df = spark.createDataFrame([(i, "k", x) for i, x in enumerate(xs)], "i long, k string, x double")
    got = {r.i: r.m for r in sequence.ew_mean(df, "x", "k", "i", alpha=alpha, name="m").collect()}
    mean = 0.0
    for i, x in enumerate(xs):
        mean = alpha * x + (1 - alpha) * mean if mean else x
        assert math.isclose(got[i], mean, rel_tol=1e-6, abs_tol=1e-300), i


def test_binned_auc_equals_the_definition(spark):
    from ordo.operators import metrics

    rows = [(i % 3 == 0, (i * 7 % 21) / 20) for i in range(200)] + [(True, None), (None, 0.5), (True, 1.0), (False, 0.0)]
    df = spark.createDataFrame(rows, "y boolean, s double")
    known = [(y, s) for y, s in rows if y is not None and s is not None]
    cuts = [-1e-7, *[i / 9 for i in range(1, 9)], 1 + 1e-7]
    pos, neg = sum(y for y, _ in known), sum(not y for y, _ in known)
    points = [(sum(not y and s > c for y, s in known) / neg, sum(y and s > c for y, s in known) / pos) for c in cuts]
    area = sum((a[0] - b[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:], strict=False))
    assert math.isclose(metrics.roc_auc_binned(df, "y", "s").first().roc_auc, area, abs_tol=1e-12)
