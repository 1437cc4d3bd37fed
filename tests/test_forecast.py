"""Published forecasts, many series in one table, and streams equal to batches."""

import datetime as dt
import functools
import math

import pytest

from ordo.operators import forecast as FC
from ordo.operators.evaluate import horizon_eval
from ordo.streaming.forecast import forecast_stream

# Monthly airline passengers, 1949 to 1960, thousands.
PASSENGERS = [
    112, 118, 132, 129, 121, 135, 148, 148, 136, 119, 104, 118, 115, 126, 141, 135, 125, 149, 170, 170, 158, 133, 114, 140,
    145, 150, 178, 163, 172, 178, 199, 199, 184, 162, 146, 166, 171, 180, 193, 181, 183, 218, 230, 242, 209, 191, 172, 194,
    196, 196, 236, 235, 229, 243, 264, 272, 237, 211, 180, 201, 204, 188, 235, 227, 234, 264, 302, 293, 259, 229, 203, 229,
    242, 233, 267, 269, 270, 315, 364, 347, 312, 274, 237, 278, 284, 277, 317, 313, 318, 374, 413, 405, 355, 306, 271, 306,
    315, 301, 356, 348, 355, 422, 465, 467, 404, 347, 305, 336, 340, 318, 362, 348, 363, 435, 491, 505, 404, 359, 310, 337,
    360, 342, 406, 396, 420, 472, 548, 559, 463, 407, 362, 405, 417, 391, 419, 461, 472, 535, 622, 606, 508, 461, 390, 432,
]
# Mean absolute errors by horizon of the published example.
HOLT_WINTERS_MAE = [25.899087, 26.26131, 25.735903, 25.625678, 26.093842, 26.90249, 28.634398, 29.284769, 31.018351, 32.252349, 33.518946, 33.975057]
# Forecasts of 1961 of the published example.
SNARIMAX_1961 = [442.554, 427.305, 471.861, 483.978, 489.995, 544.270, 632.882, 633.229, 531.349, 457.258, 405.978, 439.674]


# workers do not import test modules, so no function of this one
seasonal = functools.partial(FC.HoltWinters, 0.3, 0.1, 0.6, 12, multiplicative=True)


def test_holt_winters_published_errors(spark):
    """Two copies of the series and a short one, shuffled together."""
    rows = [(k, i, float(v)) for k in ("a", None) for i, v in enumerate(PASSENGERS)] + [("short", i, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, t long, y double").repartition(6)
    made = FC.forecast(df, seasonal, "y", "k", "t", 12)
    assert made.filter("k = 'short' AND forecast IS NOT NULL").count() == 0
    one = df.filter("k = 'a'")
    found = horizon_eval(one, "k", "t", "y", FC.long_form(made.filter("k = 'a'")), 12, complete=True).orderBy("h").collect()
    assert [round(r.mae, 5) for r in found] == [round(v, 5) for v in HOLT_WINTERS_MAE] and {r.n for r in found} == {120}
    both = [made.filter(c).orderBy("t").toPandas().forecast.tolist() for c in ("k = 'a'", "k IS NULL")]
    assert [None if v is None else list(v) for v in both[0]] == [None if v is None else list(v) for v in both[1]]


def features(month):
    return [float(month.toordinal()), *(math.exp(-((month.month - k) ** 2)) for k in range(1, 13))]


def test_snarimax_published_forecasts():
    model = FC.Snarimax(0, 0, 0, 12, 3, 0, 6, lr=0.01, intercept_lr=0.3, intercept=110)
    errors = []
    for i, y in enumerate(PASSENGERS):
        x = features(dt.date(1949 + i // 12, 1 + i % 12, 1))
        errors.append(abs(model.forecast(1, [x])[0] - y))
        model.learn(y, x)
    assert sum(errors[-12:]) / 12 == pytest.approx(11.636563, abs=1e-5)
    assert [round(v, 3) for v in model.forecast(12, [features(dt.date(1961, m, 1)) for m in range(1, 13)])] == SNARIMAX_1961


def test_differences_are_undone():
    """A series that is linear is forecast exactly once two differences leave nothing to learn."""
    model = FC.Snarimax(2, 1, 0, 1, sd=1, lr=0.0, intercept_lr=0.0)
    assert model.back == {1: -2, 2: 1}
    assert FC.lag_weights(3) == {1: -3, 2: 3, 3: -1} and FC.lag_weights(2, 7) == {7: -2, 14: 1}


def test_stream_equals_batch(spark, tmp_path):
    """Rows of a series over several files; a missing value is forecast, not learnt."""
    rows = [(k, i, None if i == 40 else float(v) * (1 + k)) for k in (0, 1) for i, v in enumerate(PASSENGERS)]
    df = spark.createDataFrame(rows, "k long, t long, y double")
    want = {(r.k, r.t): r.forecast for r in FC.forecast(df, seasonal, "y", "k", "t", 3).collect()}
    for part in range(4):
        df.filter(f"t div 36 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sdf = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = forecast_stream(sdf, seasonal, "y", "k", "t", 3).writeStream.format("parquet")
    out.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.k, r.t): r.forecast for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want and want[(0, 41)] is not None


def test_edges(spark):
    df = spark.createDataFrame([], "k long, t long, y double")
    assert FC.forecast(df, seasonal, "y", "k", "t", 2).count() == 0
    flat = FC.HoltWinters(0.5)
    for y in (2.0, 4.0, 4.0):
        flat.learn(y)
    assert flat.forecast(2) == [3.5, 3.5]
    zero = FC.HoltWinters(0.5, 0.1, 0.1, 2, multiplicative=True)
    for y in (0.0, 0.0, 0.0, 5.0):
        zero.learn(y)
    assert all(math.isfinite(v) for v in zero.forecast(4))
