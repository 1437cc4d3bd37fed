"""Draws, rates and repeats of the samplers."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ordo.operators import imbalance as I
from ordo.plans import session as S


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, "a" if i % 10 else "b", float(i % 7) if i % 50 else 100.0) for i in range(4000)] + [(9000, None, None), (9001, "c", 1.0)]
    return spark.createDataFrame(data, "i long, y string, v double").repartition(5)


def test_draws_are_uniform(spark):
    u = [r.u for r in spark.range(20000).select(I.draw("id").alias("u")).collect()]
    assert 0 < min(u) and max(u) < 1
    assert max(abs(sum(v < k / 20 for v in u) / len(u) - k / 20) for k in range(21)) < 0.02
    pairs = Counter((int(4 * a), int(4 * b)) for a, b in zip(u, u[1:]))
    assert min(pairs.values()) > 1000


@pytest.mark.parametrize("rate", [0.3, 2.0, 40.0])
def test_poisson(spark, rate):
    n = [r.n for r in spark.range(20000).select(I.poisson(F.lit(rate), I.draw("id", 1)).alias("n")).collect()]
    mean = sum(n) / len(n)
    assert mean == pytest.approx(rate, rel=0.03)
    assert sum((v - mean) ** 2 for v in n) / len(n) == pytest.approx(rate, rel=0.06)
    assert n.count(0) / len(n) == pytest.approx(math.exp(-rate), abs=0.01)


def test_poisson_is_searched_once_a_row(spark, rows):
    """The draws are a batch's work, not computed again by the filter and the explode."""
    def plain(rate, u):
        p = cdf = math.exp(-rate)
        n, end = 0, math.ceil(rate + 12 * math.sqrt(rate) + 30)
        while cdf < u and n < end:
            n += 1
            p = p * rate / n
            cdf += p
        return n

    given = [(0.3, 0.9), (2.0, 0.5), (700.0, 0.2), (1.0, 0.1), (None, 0.5), (2.0, None), (900.0, 0.5)]
    df = spark.createDataFrame(given, "rate double, u double").coalesce(1)
    got = [r.n for r in df.select(I.poisson(F.col("rate"), F.col("u")).alias("n")).collect()]
    assert got == [None if rate is None else 0 if u is None else plain(rate, u) for rate, u in given]
    plan = I.oversample(rows, "y", {"a": 0.5, "b": 0.5}, "i", "i")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "aggregate(sequence(" not in plan


@pytest.mark.parametrize("hot", [None, "50"])
def test_classes_reach_what_is_wished(spark, rows, hot):
    wished = {"a": 0.5, "b": 0.5}
    if hot:
        spark.conf.set(S.CONF_HOT_ROWS, hot)
    try:
        under = Counter(r.y for r in I.undersample(rows, "y", wished, "i", "i").collect())
        over = I.oversample(rows, "y", wished, "i", "i").collect()
        mixed = Counter(r.y for r in I.resample(rows, "y", wished, "i", "i", rate=0.5).collect())
    finally:
        spark.conf.unset(S.CONF_HOT_ROWS)
    assert set(under) == set(wished) and 0.8 < under["a"] / under["b"] < 1.3 and 380 < under["b"] <= 400
    counts = Counter(r.y for r in over)
    assert set(counts) == set(wished) and 0.8 < counts["a"] / counts["b"] < 1.25 and counts["a"] >= 3590
    copies = [r.copy for r in over if r.i == 10]
    assert sorted(copies) == list(range(1, len(copies) + 1))
    assert 0.8 < mixed["a"] / mixed["b"] < 1.25 and 1800 < mixed.total() < 2200


def test_chebyshev(spark):
    data = [(0, 5.0), (1, 5.0), (2, 5.0), (3, 9.0), (4, None), (5, 5.9), (6, 60.0)]
    df = spark.createDataFrame(data, "i long, v double")
    got = Counter(r.i for r in I.chebyshev_oversample(df, "v", "i").collect())
    want, seen = Counter(), []
    for i, v in data:
        if v is None:
            continue
        seen.append(v)
        mean = sum(seen) / len(seen)
        sd = math.sqrt(sum((s - mean) ** 2 for s in seen) / (len(seen) - 1)) if len(seen) > 1 else 0.0
        want[i] = math.ceil(abs(v - mean) / sd) if sd else 1
    assert got == +want and got[6] == 3
    kept = {r.i for r in I.chebyshev_undersample(df, "v", "i", "i").collect()}
    assert {0, 1, 2} <= kept and 5 not in kept and 4 not in kept


def test_empty(spark, rows):
    none = rows.limit(0)
    assert I.undersample(none, "y", {"a": 1.0}, "i", "i").count() == 0
    assert I.chebyshev_oversample(none, "v", "i").count() == 0
