"""Frames and lags of hot keys, cut into blocks, equal the plain windows; time-rolling streams with late rows."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from ordo.functions.stats import Stat
from ordo.operators import distributions, metrics, sequence, windows
from ordo.plans import session as S
from ordo.streaming import time_rolling as TRS


@pytest.fixture(scope="module")
def rows(spark):
    """Ties in time, a string and a date order, null values, a null key."""
    rng = random.Random(6)
    data, t = [], 0
    for i in range(240):
        t += rng.choice([0, 0, 1, 2, 5])
        data.append((i, rng.choice(["a", "a", "a", "b", None]), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), f"{i:04d}", dt.date(2024, 1, 1) + dt.timedelta(days=i),
                     None if i % 17 == 0 else float(rng.randint(0, 5)), rng.choice("xyz")))
    return spark.createDataFrame(data, "i long, k string, ts timestamp_ntz, s string, d date, v double, c string").repartition(5)


@pytest.fixture()
def cut(spark):
    """Blocks of 7 rows."""

    def both(make):
        plain = make().orderBy("i").collect()
        spark.conf.set(S.CONF_HOT_ROWS, "7")
        try:
            blocked = make().orderBy("i").collect()
        finally:
            spark.conf.unset(S.CONF_HOT_ROWS)
        assert len(plain) == len(blocked) == 240
        for a, b in zip(plain, blocked):
            for x, y in zip(a, b):
                assert x == y or (isinstance(x, float) and x == pytest.approx(y, abs=1e-9)), (a, b)

    return both


OUTS = {n: Stat.of(n, "v") for n in ("count", "sum", "mean", "var", "min", "max", "abs_max", "ptp", "quantile", "iqr", "sem")}


@pytest.mark.parametrize("order", ["i", "s", "d"])
@pytest.mark.parametrize("lagged", [False, True])
def test_rolling(rows, cut, order, lagged):
    cut(lambda: windows.rolling(rows, OUTS, 9, "k", order, lagged).select("i", *OUTS))


def test_rolling_without_a_key(rows, cut):
    pair = {"cov": Stat.of("cov", "v", "i"), "r": Stat.of("pearson", "v", "i")}
    cut(lambda: windows.rolling(rows, pair, 11, None, "i").select("i", *pair))
    cut(lambda: metrics.rolling_metric(rows.withColumn("p", F.lit("x")), "f1", "c", "p", "i", 12, positive="x").select("i", "f1"))


@pytest.mark.parametrize("by", [None, "k"])
def test_time_rolling(rows, cut, by):
    cut(lambda: windows.time_rolling(rows, OUTS, 10_000_000, "ts", by).select("i", *OUTS))
    cut(lambda: distributions.time_rolling_share(rows, "c", 10_000_000, "ts", by).select("i", "share"))


def test_lags(rows, cut):
    cut(lambda: sequence.shift(rows, "v", "k", "i", 3, fill=-1.0, name="s3").select("i", "s3"))
    cut(lambda: sequence.autocorr(rows, "v", "k", "i", 2, name="r").select("i", "r"))
    cut(lambda: sequence.link(rows, "v", "k", "i", "shift", "mean", 2, name="m").select("i", "m"))
    cut(lambda: sequence.rolling_mode(rows, "c", 5, "k", "i", name="mode").select("i", "mode"))
    cut(lambda: distributions.difference(rows.fillna({"v": 0.0}), "v", "k", "i", [(1, 1), (1, 4)]).select("i", "v_diff"))


@pytest.mark.parametrize("by", [None, "k"])
@pytest.mark.parametrize("bias", [False, True])
def test_running_shape(rows, cut, by, bias):
    outs = {"skew": Stat.of("skew", "v", bias=bias), "kurt": Stat.of("kurtosis", "v", bias=bias), "n": Stat.of("count", "v")}
    far = rows.withColumn("v", F.col("v") + 1e5)
    if by:
        cut(lambda: windows.running(far, outs, by, "i").select("i", *outs))
        return
    got = windows.running(far, outs, None, "i").orderBy("i").collect()
    plain = {n: s.native(lambda a: a.over(windows.Window.partitionBy(F.lit(0)).orderBy("i"))) for n, s in outs.items()}
    for a, b in zip(got, far.withColumns(plain).orderBy("i").collect()):
        assert all(a[n] == pytest.approx(b[n], abs=1e-6) for n in outs)


def plain_period(events, period, value):
    """Rows as they come: what is in the period after each."""
    held, latest, out = [], -math.inf, []
    for t, *row in events:
        held.append((t, row))
        if t > latest:
            latest = t
            held = [h for h in held if h[0] > t - period]
        out.append(value([r for _, r in held], row))
    return out


def test_time_rolling_streams_with_late_rows(spark, tmp_path):
    """Rows of a key come out of order within and between files."""
    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    events = [(i, rng.choice(["a", "b"]), 10 * (i // 3) + rng.choice([0, -25, 3, 7]), float(rng.randint(0, 9)), float(rng.randint(0, 9)), rng.choice("xy")) for i in range(90)]
    schema = "i long, k string, ts timestamp, y double, p double, c string"
    for part in range(3):
        mine = [(i, k, start + dt.timedelta(seconds=100 + t), y, p, c) for i, k, t, y, p, c in events[30 * part : 30 * part + 30]]
        spark.createDataFrame(mine, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(make, name):
        sdf = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = make(sdf).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-ck"))
        out.trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / name))

    period = 40_000_000
    got = run(lambda s: TRS.time_rolling_metric_stream(s, "mae", "y", "p", "k", "ts", period, "10 minutes"), "mae")
    shares = run(lambda s: TRS.time_rolling_share_stream(s, "c", "k", "ts", period, "10 minutes"), "share")
    for key in "ab":
        mine = [e for e in events if e[1] == key]
        want = plain_period([(1_000_000 * t, y, p) for _, _, t, y, p, _ in mine], period, lambda held, _: sum(abs(y - p) for y, p in held) / len(held))
        found = sorted((r.ts.timestamp() - start.timestamp() - 100, r.y, r.p, round(r.mae, 9)) for r in got.filter(F.col("k") == key).collect())
        assert found == sorted((t, y, p, round(m, 9)) for (_, _, t, y, p, _), m in zip(mine, want))
        want = plain_period([(1_000_000 * t, c) for _, _, t, _, _, c in mine], period, lambda held, row: sum(h == row for h in held) / len(held))
        found = sorted((r.ts.timestamp() - start.timestamp() - 100, r.c, round(r.share, 9)) for r in shares.filter(F.col("k") == key).collect())
        assert found == sorted((t, c, round(m, 9)) for (_, _, t, _, _, c), m in zip(mine, want))
