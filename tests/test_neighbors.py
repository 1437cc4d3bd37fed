"""Outlier factors and nearest neighbours against brute force."""

import math
import random

import numpy as np
import pytest

from ordo.operators import neighbors as N


def plain_lof(points, k, window):
    out = []
    for i in range(len(points)):
        w = points[max(0, i - window + 1) : i + 1]
        if len(w) <= k:
            out.append(1.0)
            continue
        near = {a: sorted((math.dist(w[a], w[b]), b) for b in range(len(w)) if b != a)[:k] for a in range(len(w))}

        def density(a):
            reach = sum(max(d, near[b][-1][0]) for d, b in near[a])
            return k / reach if reach else 1e6

        last = len(w) - 1
        out.append(sum(density(b) for _, b in near[last]) / (k * density(last)))
    return out


@pytest.mark.parametrize("block_rows", [1, 5000])
def test_outlier_factor(spark, block_rows):
    """500 rows with ties and copies; small blocks give the same as one."""
    rng = random.Random(1)
    rows = [(i, i % 2, float(rng.randint(0, 9)), rng.choice([0.0, 1.0, rng.random()])) for i in range(500)]
    rows += [(1000, 0, None, 1.0), (1001, 1, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "i long, k long, x double, y double")
    got = {r.i: r.lof for r in N.local_outlier_factor(df, ["x", "y"], "k", "i", k=4, window_size=25, block_rows=block_rows).collect()}
    assert len(got) == len(rows) and got[1000] is None and got[1001] is None
    for key in (0, 1):
        mine = [r for r in rows[:500] if r[1] == key]
        want = plain_lof([(r[2], r[3]) for r in mine], 4, 25)
        assert np.allclose([got[r[0]] for r in mine], want)


@pytest.mark.parametrize("block_rows,p", [(1, 2), (5000, 3)])
def test_window_neighbors(spark, block_rows, p):
    rng = random.Random(3)
    rows = [(i, float(rng.randint(0, 6)), rng.random() if i % 3 else 1.0, None if i % 11 == 5 else f"y{i % 4}") for i in range(220)] + [(500, None, 1.0, "y")]
    df = spark.createDataFrame(rows, "i long, a double, b double, y string")
    got = {r.i: r.neighbors for r in N.window_neighbors(df, ["a", "b"], "y", None, "i", k=3, window_size=17, p=p, block_rows=block_rows).collect()}
    assert got[500] is None
    for i, a, b, _ in rows[:220]:
        near = sorted((round((abs(a - c) ** p + abs(b - d) ** p) ** (1 / p), 9), j, y) for j, c, d, y in rows[max(0, i - 17) : i] if y is not None)[:3]
        assert [(round(n.d, 9), n.y) for n in got[i]] == [(d, y) for d, _, y in near]


def test_predictions(spark):
    kind = "i long, neighbors array<struct<d:double,y:string>>"
    rows = [(1, [(1.0, "b"), (2.0, "a"), (2.0, "a")]), (2, [(0.0, "c"), (1.0, "a")]), (3, []), (4, None), (5, [(1.0, "b"), (1.0, "a")])]
    out = {r.i: r for r in N.knn_classify(spark.createDataFrame(rows, kind), labels=["a", "b", "c"]).collect()}
    assert [out[i].y_pred for i in range(1, 6)] == ["a", "c", None, None, "a"]
    assert out[2].y_proba == {"a": 0.0, "b": 0.0, "c": 1.0}
    e = math.e
    assert np.allclose([out[5].y_proba[c] for c in "abc"], [e / (2 * e + 1), e / (2 * e + 1), 1 / (2 * e + 1)])
    flat = {r.i: r.y_pred for r in N.knn_classify(spark.createDataFrame(rows, kind), weighted=False).collect()}
    assert flat[1] == "a"
    rows = [(1, [(1.0, 4.0), (2.0, 1.0), (4.0, 1.0), (4.0, 10.0)]), (2, [(0.0, 3.0), (1.0, 9.0)]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "i long, neighbors array<struct<d:double,y:double>>")
    want = {"mean": 4.0, "median": 2.5, "weighted_mean": (4 + 0.5 + 0.25 + 2.5) / 2}
    for how, value in want.items():
        got = {r.i: r.y_pred for r in N.knn_regress(df, how=how).collect()}
        assert got == {1: value, 2: 3.0, 3: 0.0, 4: None}


@pytest.mark.parametrize("dims,k,p,n_pivots,ring_rows", [(2, 4, 2, 5, 8), (3, 1, 1, 1, 5), (2, 30, 2, 64, 4096)])
def test_join_is_exact(spark, dims, k, p, n_pivots, ring_rows):
    """Clusters, copies and ties; a point that a third of the rows share."""
    rng = random.Random(dims * k)
    points = [[round(rng.gauss(rng.choice([0, 50]), 4), 1) for _ in range(dims)] for _ in range(250)] + [[1.0] * dims] * 130
    rows = [(i, i % 5, *v) for i, v in enumerate(points)] + [(900, 0, *[None] * dims), (None, 1, *[1.0] * dims)]
    names = [f"f{i}" for i in range(dims)]
    df = spark.createDataFrame(rows, "i long, y int, " + ", ".join(f"{n} double" for n in names)).repartition(5)
    asked = df.filter("i % 3 = 0 OR i >= 360")
    got = {r.i: [(round(n.d, 9), n.id, n.y) for n in r.neighbors] for r in N.knn_join(asked, df, names, "i", "i", "y", k, p, n_pivots, ring_rows).collect()}
    assert set(got) == {i for i in range(380) if i % 3 == 0 or i >= 360}
    for i, found in got.items():
        near = sorted((sum(abs(a - b) ** p for a, b in zip(points[i], v)) ** (1 / p), j) for j, v in enumerate(points) if j != i)[:k]
        assert found == [(round(d, 9), j, j % 5) for d, j in near]


def test_join_with_too_few_rows(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 1, 2.0)], "i long, y int, x double")
    got = {r.i: [n.id for n in r.neighbors] for r in N.knn_join(df, df, ["x"], "i", "i", "y", k=5).collect()}
    assert got == {1: [2], 2: [1]}
    assert N.knn_join(df, df.limit(0), ["x"], "i", "i", "y").count() == 0


def test_outlier_factors_share_the_order_of_a_chunk(monkeypatch):
    """Rows are sorted once a chunk, not once a row; windows that start and slide give what brute force gives, ties included."""
    rng = random.Random(7)
    calls = []
    argsort = np.argsort
    monkeypatch.setattr(N.np, "argsort", lambda *a, **kw: calls.append(1) or argsort(*a, **kw))
    for k, window, own in ((3, 20, 0), (10, 250, 249), (5, 6, 40), (5, 5, 0), (40, 90, 0)):
        points = [(float(rng.randint(0, 6)), rng.choice([0.0, 1.0, rng.random()])) for _ in range(330)]
        calls.clear()
        got = N.local_outlier_factors(np.array(points), own, k, window)
        assert len(calls) <= 330 // N.CHUNK + 1
        some = list(range(0, 330 - own, 23))
        want = [plain_lof(points[max(0, own + i - window + 1) : own + i + 1], k, window)[-1] for i in some]
        assert np.allclose(got[some], want)


def test_join_compares_few_rows(spark, monkeypatch):
    """Rows searched for a query stay near a box of them, wherever the query is."""
    rng = random.Random(5)
    points = [[rng.uniform(0, 1), rng.uniform(0, 4), rng.uniform(0, 9)] for _ in range(6000)]
    df = spark.createDataFrame([(i, i % 7, *v) for i, v in enumerate(points)], "i long, y int, a double, b double, c double").repartition(4)
    searched, compared = N._searched, []

    def counted(wanted, held, *rest):
        keys = [c for c in ("box", "cell", "ring") if c in held.columns]
        compared.append(wanted.join(held.groupBy(*keys).count(), keys).agg({"count": "sum"}).first()[0] or 0)
        return searched(wanted, held, *rest)

    monkeypatch.setattr(N, "_searched", counted)
    got = {r.i: [n.id for n in r.neighbors] for r in N.knn_join(df.filter("i % 20 = 0"), df, ["a", "b", "c"], "i", "i", "y", 3, 2, 16, 50).collect()}
    assert len(got) == 300 and sum(compared) / len(got) < 500
    for i in list(got)[::10]:
        assert got[i] == [j for _, j in sorted((math.dist(points[i], v), j) for j, v in enumerate(points) if j != i)[:3]]


def test_join_of_queries_with_one_id(spark):
    """Rows of one id share their k nearest; ids that come twice and one place of many rows among them."""
    rng = random.Random(9)
    points = [(f"k{j % 150:03d}", [float(rng.randint(0, 30)), float(rng.randint(0, 30))]) for j in range(260)] + [(f"z{j:03d}", [7.0, 7.0]) for j in range(200)]
    rows = [(i, None if n % 9 == 4 else n, *v) for n, (i, v) in enumerate(points)]
    df = spark.createDataFrame(rows, "i string, y int, a double, b double").repartition(3)
    got = {r.i: [(round(n.d, 9), n.id) for n in r.neighbors] for r in N.knn_join(df, df, ["a", "b"], "i", "i", "y", 6, 2, 2, 20).collect()}
    assert set(got) == {i for i, _ in points}
    for i, found in got.items():
        mine = [v for j, v in points if j == i]
        assert found == sorted((round(math.dist(v, w), 9), j) for v in mine for j, w in points if j != i)[:6]
