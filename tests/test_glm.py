"""Every step of a fit against numpy, fits that go on after a cut, and the losses' gradients."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordo.functions import losses as L
from ordo.operators import glm as G


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = x @ [1.5, -2.0] + 0.5 + rng.normal(size=300) * 0.1
    data = [(i % 3, float(a), float(b), float(t), int(t > 0), "abc"[int(np.digitize(t, [-1, 1]))], 1.0 + i % 2) for i, ((a, b), t) in enumerate(zip(x, y))]
    data += [(0, None, 1.0, 1.0, 1, "a", 1.0), (1, 1.0, float("nan"), 1.0, 0, "b", 1.0), (2, 1.0, 1.0, None, None, None, 1.0)]
    return spark.createDataFrame(data, "batch int, a double, b double, y double, z int, label string, w double").repartition(7)


def local(rows, columns):
    found = [r for r in rows.collect() if all(r[c] is not None and r[c] == r[c] for c in ["a", "b", *columns])]
    return [[r for r in found if r.batch == k] for k in range(3)]


GRADIENTS = {
    "squared": (lambda y, p: 2 * (p - y), "y"),
    "absolute": (lambda y, p: np.where(p > y, 1, -1), "y"),
    "huber": (lambda y, p: np.clip(p - y, -0.1, 0.1), "y"),
    "log": (lambda y, p: -(2 * y - 1) / (np.exp((2 * y - 1) * p) + 1), "z"),
    "hinge": (lambda y, p: np.where((2 * y - 1) * p <= 1, -(2 * y - 1), 0), "z"),
}


@pytest.mark.parametrize("name", GRADIENTS)
def test_each_step_equals_numpy(rows, name):
    slope, target = GRADIENTS[name]
    seen = []
    G.fit(rows, ["a", "b"], target, L.LOSSES[name](), G.Sgd(0.1), 0.05, l2=0.03, epochs=2, batch="batch", weight="w", on_step=lambda m: seen.append((m.weights[0].copy(), m.intercepts[0])))
    w, b = np.zeros(2), 0.0
    batches = local(rows, [target])
    assert len(seen) == 6
    for step, (got_w, got_b) in enumerate(seen):
        part = batches[step % 3]
        x, y, v = np.array([[r.a, r.b] for r in part]), np.array([r[target] for r in part]), np.array([r.w for r in part])
        g = v * slope(y, x @ w + b)
        b, w = b - 0.05 * g.mean(), w - 0.1 * ((g[:, None] * x).mean(axis=0) + 0.03 * w)
        assert np.allclose(got_w, w) and math.isclose(got_b, b, abs_tol=1e-12)


def test_softmax_step_equals_numpy(rows):
    seen = []
    model = G.fit_softmax(rows, ["a", "b"], "label", optimizer=G.Sgd(0.5), l2=0.01, class_weight={"b": 2.0}, epochs=1, batch="batch", on_step=lambda m: seen.append(m.weights.copy()))
    w = np.zeros((3, 2))
    assert model.labels == ["a", "b", "c"]
    for step, part in enumerate(local(rows, ["label"])):
        x, y = np.array([[r.a, r.b] for r in part]), np.array([["abc".index(r.label) == c for c in range(3)] for r in part], float)
        s = np.exp(x @ w.T)
        g = (s / s.sum(axis=1, keepdims=True) - y) * [1.0, 2.0, 1.0]
        w = w - 0.5 * (np.einsum("nc,nf->cf", g, x) / len(x) + 0.01 * w)
        assert np.allclose(seen[step], w)
    out = G.predict_label(rows.filter("label IS NOT NULL AND a IS NOT NULL AND NOT isnan(b)"), model)
    assert out.filter("y_pred = label").count() > 200 and out.select(F.aggregate("y_proba", F.lit(0.0), lambda a, p: a + p)).first()[0] == pytest.approx(1)


def test_one_class(rows):
    seen = []
    model = G.fit_one_class(rows, ["a", "b"], nu=0.4, optimizer=G.Sgd(0.1), intercept_lr=0.02, epochs=3, on_step=lambda m: seen.append((m.weights[0].copy(), m.intercepts[0])))
    x = np.array([[r.a, r.b] for part in local(rows, []) for r in part])
    w, b = np.zeros(2), 1.0
    for got_w, got_b in seen:
        g = np.where(x @ w + b <= 1, -1.0, 0.0)
        b, w = b - (0.02 * g.mean() + 2 * 0.02 * 0.2), w - 0.1 * ((g[:, None] * x).mean(axis=0) + 0.2 * w)
        assert np.allclose(got_w, w) and math.isclose(got_b, b, abs_tol=1e-12)
    r = G.anomaly_score(rows.filter("a IS NOT NULL"), model).first()
    assert r.svm_score == pytest.approx(w @ [r.a, r.b]) or math.isnan(r.b)


@pytest.mark.parametrize("make", [lambda: G.Momentum(0.05), lambda: G.AdaGrad(0.5), lambda: G.Adam(0.1), lambda: G.Sgd(lambda step: 0.3 / (1 + step))])
def test_optimizers_converge_and_go_on_after_a_cut(spark, rows, tmp_path, make):
    whole = G.fit(rows, ["a", "b"], "y", optimizer=make(), intercept_lr=0.1, epochs=25)
    assert np.allclose(whole.weights, [[1.5, -2.0]], atol=0.6)
    path = str(tmp_path / "steps")
    G.fit(rows, ["a", "b"], "y", optimizer=make(), intercept_lr=0.1, epochs=4, path=path)
    steps = []
    rest = G.fit(rows, ["a", "b"], "y", optimizer=make(), intercept_lr=0.1, epochs=6, path=path, on_step=lambda m: steps.append(m.steps))
    assert steps == [5, 6]
    straight = G.fit(rows, ["a", "b"], "y", optimizer=make(), intercept_lr=0.1, epochs=6)
    assert np.allclose(rest.weights, straight.weights) and np.allclose(rest.intercepts, straight.intercepts)


def test_gradients_are_the_values_slopes(spark):
    """Of every loss whose published gradient is that of its value, away from its corners."""
    eps = 1e-5
    points = [(t, p) for t in (0.0, 1.0) for p in (-2.2, -0.3, 0.45, 1.7)]
    df = spark.createDataFrame(points, "y double, p double")
    for name, make in L.LOSSES.items():
        loss = make()
        if name in ("cauchy", "quantile"):
            continue
        cols = [loss.value(F.col("y"), F.col("p") + e) for e in (eps, -eps)]
        for r in df.select((cols[0] - cols[1]).alias("v"), loss.gradient(F.col("y"), F.col("p")).alias("g")).collect():
            assert r.v / (2 * eps) == pytest.approx(r.g, abs=1e-4), name


def test_nulls_empty_and_extremes(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, None), (1.0, 500.0), (0.0, 500.0), (1.0, -500.0)], "y double, p double")
    for name, make in L.LOSSES.items():
        loss = make()
        out = df.select(loss.value(F.col("y"), F.col("p")).alias("v"), loss.gradient(F.col("y"), F.col("p")).alias("g")).collect()
        assert out[0] == (None, None) and out[1] == (None, None), name
    value = [r[0] for r in df.select(L.log().value(F.col("y"), F.col("p"))).collect()]
    assert value[2:] == [math.exp(-500), 500.0, 500.0]
    model = G.fit(df.limit(0), ["p"], "y")
    assert model.steps == 0 and not model.weights.any()
