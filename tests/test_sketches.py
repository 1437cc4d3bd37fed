"""Skylines, histograms and sliding Fourier coefficients against plain versions."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordo.operators import sketches as S
from ordo.operators import skyline as K


def plain_front(rows, better):
    return sorted(a for a in rows if not any(better(b, a) for b in rows))


@pytest.mark.parametrize("block_rows", [3, 20_000])
def test_skyline_of_a_large_front(spark, monkeypatch, block_rows):
    """More undominated rows than a block holds, repeats among them."""
    monkeypatch.setattr(K, "FIRST", 5)
    monkeypatch.setattr(K, "LOCAL", 7)
    rng = random.Random(2)
    rows = [(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(300)] + [(i, i) for i in range(0, 12)] * 2 + [(60 - i, -i) for i in range(9)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(4)
    got = sorted(tuple(r) for r in K.skyline(df, minimize="a", maximize="b", block_rows=block_rows).collect())
    assert got == plain_front(rows, lambda x, y: x[0] <= y[0] and x[1] >= y[1] and x != y)


def test_skyline_by_key_with_odd_values(spark):
    day = dt.date(2024, 1, 1)
    rows = [(None, 1.0, day, True), (None, 1.0, day, True), (None, 2.0, day, True), ("a", float("nan"), day, True), ("a", None, day, True), ("a", -0.0, day, False)]
    rows += [("a", 0.0, day, False), ("a", 0.0, day, True), ("b", float("inf"), day, None), ("b", float("inf"), day, False), ("b", 5.0, dt.date(2023, 1, 1), False)]
    df = spark.createDataFrame(rows, "k string, x double, d date, f boolean")
    got = [tuple(r) for r in K.skyline(df, minimize="x", maximize=["d", "f"], by="k").collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[1], rows[7], rows[9], rows[10]], key=str)
    assert K.skyline(df.limit(0), minimize="x").count() == 0
    with pytest.raises(TypeError):
        K.skyline(df, minimize="k")


@pytest.mark.parametrize("block_rows,local", [(8, 4096), (20_000, 7)])
def test_skyline_of_many_keys_takes_no_round_a_block(spark, monkeypatch, block_rows, local):
    """Fronts of small keys are found side by side; only a key with more survivors than a block takes rounds."""
    monkeypatch.setattr(K, "LOCAL", local)
    monkeypatch.setattr(K, "STEP", 5)
    names, write = [], K.written
    monkeypatch.setattr(K, "written", lambda df, name: names.append(name) or write(df, name))
    rng = random.Random(3)
    rows = [(k if k else None, rng.randint(0, 9), rng.randint(0, 9)) for k in range(90) for _ in range(12)] + [(500, i, i) for i in range(30)] * 2
    df = spark.createDataFrame(rows, "k long, a long, b long").repartition(3)
    got = [tuple(r) for r in K.skyline(df, minimize="a", maximize="b", by="k", block_rows=block_rows).collect()]
    want = [y for y in rows if not any(x[0] == y[0] and x[1] <= y[1] and x[2] >= y[2] and x != y for x in rows)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len(names) <= (12 if block_rows == 8 else 1)


def cdf_of(h, x):
    total = 0.0
    for b in h.bins:
        total += b.n if x >= b.right else b.n * (x - b.left) / (b.right - b.left) if x > b.left else 0
    return total / h.n


def test_histogram_is_exact_below_its_bins(spark):
    rows = [("a", float(i % 50)) for i in range(2000)] + [("b", 7.0)] * 30 + [("c", None), (None, 1.0), ("a", float("nan"))]
    h = {r.k: r for r in S.histogram(spark.createDataFrame(rows, "k string, x double").repartition(9), "x", "k").collect()}
    assert set(h) == {"a", "b", None}
    assert [(b.left, b.right, b.n) for b in h["a"].bins] == [(float(i), float(i), 40.0) for i in range(50)]
    assert h["a"].slack == 0 and h["b"].n == 30 and [(b.left, b.right, b.n) for b in h["b"].bins] == [(7.0, 7.0, 30.0)]


@pytest.mark.parametrize("parts,fan_in", [(1, 64), (40, 4)])
def test_merged_histogram_keeps_its_error(spark, monkeypatch, parts, fan_in):
    """Sketches merged in one or several rounds stay within the error that they state."""
    monkeypatch.setattr(S, "FAN_IN", fan_in)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(-3, 1, 3000), rng.normal(3, 1, 3000), rng.exponential(30, 200)])
    rng.shuffle(x)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(parts)
    h = S.histogram(df, "x", max_bins=64).first()
    assert h.n == len(x) and len(h.bins) <= 64 and abs(sum(b.n for b in h.bins) - len(x)) < 1e-6
    widest = max(b.n for b in h.bins)
    for v in np.quantile(x, np.linspace(0, 1, 41)):
        assert abs(cdf_of(h, v) * h.n - (x <= v).sum()) <= h.slack + widest + 1e-6
    assert h.slack < 0.25 * len(x)


def test_cdf_and_quantile_expressions(spark):
    h = S.histogram(spark.createDataFrame([(float(v),) for v in range(4)], "x double"), "x")
    at = [-1.0, 0.0, 0.5, 1.0, 2.5, 3.5]
    got = h.select(*[S.cdf(F.col("bins"), F.col("n"), F.lit(v)) for v in at]).first()
    assert list(got) == [0.0, 0.25, 0.25, 0.5, 0.75, 1.0]
    assert h.select(S.quantile(F.col("bins"), F.col("n"), 0.5)).first()[0] == 1.0


def test_equi_width_of_odd_columns(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("a", 5.0), ("a", None), ("b", 3.0), ("b", 3.0), (None, 1.0)], "k string, x double")
    got = {(r.k, r.bin): r.n for r in S.equi_width(df, "x", 2, "k").collect()}
    assert got == {("a", 0): 1, ("a", 1): 2, ("b", 0): 2, (None, 0): 1}
    assert S.equi_width(df.drop("k"), "x", 5).agg(F.sum("n")).first()[0] == 6


@pytest.mark.parametrize("rows", [6, 1000])
def test_sliding_dft_is_the_window_s_transform(spark, rows):
    """Blocks of a few rows give what one block gives, and both numpy's transform."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=40).tolist()
    x[7] = None
    df = spark.createDataFrame([(i, i % 2, v) for i, v in enumerate(x)], "i long, k long, v double")
    got = {r.i: r for r in S.sliding_dft(df, "v", 5, "k", "i", rows=rows).collect()}
    for k in (0, 1):
        mine = [(i, v or 0.0) for i, v in enumerate(x) if i % 2 == k]
        for at, (i, _) in enumerate(mine):
            if at < 4:
                assert got[i].re_0 is None
                continue
            want = np.fft.fft([v for _, v in mine[at - 4 : at + 1]])
            assert np.allclose([complex(got[i][f"re_{j}"], got[i][f"im_{j}"]) for j in range(5)], want)
