"""Trees against a plain version that counts rows one by one."""

import math
import random

import pytest

from ordo.functions.criteria import CRITERIA
from ordo.operators import tree as TR


def entropy(c):
    n = sum(c)
    return -sum(v / n * math.log2(v / n) for v in c if v) if n else 0.0


def plain_merit(name, left, right):
    a, b = sum(left), sum(right)
    if name == "gini":
        return 1 - sum(n / (a + b) * (1 - sum((v / n) ** 2 for v in side) if n else 1.0) for side, n in ((left, a), (right, b)))
    if min(a, b) <= 0.01 * (a + b):
        return None
    if name == "hellinger":
        neg, pos = left[0] + right[0], left[1] + right[1]
        return math.sqrt(sum((math.sqrt(s[0] / neg) - math.sqrt(s[1] / pos)) ** 2 for s in (left, right))) if neg and pos else 0.0
    return entropy([x + y for x, y in zip(left, right)]) - (a * entropy(left) + b * entropy(right)) / (a + b)


def plain_tree(rows, numeric, nominal, labels, name, delta, tie, max_depth, min_rows):
    """(feature, at, left, right) or class counts, nested."""

    def counts(part):
        return [sum(r["y"] == v for r in part) for v in labels]

    def grow(part, depth, own):
        if depth == max_depth or sum(v > 0 for v in own) < 2 or sum(own) < min_rows:
            return own
        best = []
        for f in numeric + nominal:
            held = [r for r in part if r[f] is not None and r[f] == r[f]]
            found = []
            if f in numeric and held:
                lo, hi = min(r[f] for r in held), max(r[f] for r in held)
                step = (hi - lo) / 11.0
                tests = [(lo + step * k, lambda r, at=lo + step * k: r[f] <= at) for k in range(1, 11)] if step > 0 else []
            else:
                tests = [(v, lambda r, v=v: r[f] == v) for v in sorted({r[f] for r in held})]
            for at, test in tests:
                a, b = counts([r for r in held if test(r)]), counts([r for r in held if not test(r)])
                if (m := plain_merit(name, a, b)) is not None:
                    found.append((-round(m, 12), at, f, a, b))
            if found:
                best.append(min(found, key=lambda t: t[:2]))
        best.sort(key=lambda t: (t[0], t[2]))
        if not best:
            return own
        n = sum(own)
        value_range = 1.0 if name == "gini" else math.log2(max(2, sum(v > 0 for v in own)))
        bound = math.sqrt(value_range**2 * math.log(1 / delta) / (2 * n))
        nothing = sum((v / n) ** 2 for v in own) if name == "gini" else 0.0
        merit, at, f, a, b = -best[0][0], *best[0][1:]
        second = max(-best[1][0] if len(best) > 1 else 0.0, nothing)
        if merit <= nothing + 1e-12 or (merit - second <= bound and bound >= tie):
            return own
        null_left = sum(a) >= sum(b)
        side = [[], []]
        for r in part:
            v = r[f]
            missing = v is None or v != v
            left = null_left if missing else (v == at if f in nominal else v <= at)
            side[not left].append(r)
        return (f, at, grow(side[0], depth + 1, a), grow(side[1], depth + 1, b))

    return grow(rows, 0, counts(rows))


def nested(tree, i=0):
    n = tree.nodes[i]
    if n.feature is None:
        return [int(v) for v in n.stats]
    return (n.feature, n.at, nested(tree, n.left), nested(tree, n.right))


@pytest.mark.parametrize("name", ["info_gain", "gini"])
def test_tree_equals_the_plain_one(spark, name):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        r = {"a": rng.random(), "b": float(rng.randint(0, 3)), "c": rng.choice(["x", "y", "z"]), "d": 1.0}
        r["y"] = "p" if r["a"] > 0.6 else "q" if r["c"] == "x" else rng.choice("qr")
        if i % 13 == 0:
            r[rng.choice("ac")] = None
        rows.append(r)
    rows[5]["a"] = float("nan")
    df = spark.createDataFrame([(r["a"], r["b"], r["c"], r["d"], r["y"]) for r in rows] + [(1.0, 1.0, "x", 1.0, None)], "a double, b double, c string, d double, y string").repartition(5)
    how = {"delta": 0.01, "tie": 0.2, "max_depth": 3, "min_rows": 20}
    tree = TR.fit_classifier(df, ["a", "b", "c", "d"], "y", name, **how)
    want = plain_tree(rows, ["a", "b", "d"], ["c"], ["p", "q", "r"], name, **how)
    assert nested(tree) == want and isinstance(want, tuple)
    out = TR.predict(df.filter("y IS NOT NULL"), tree, proba="share", leaf="leaf")
    assert out.filter("y = y_pred").count() > 600
    assert {r.leaf for r in out.select("leaf").distinct().collect()} <= set(tree.leaves())
    table = tree.table(spark)
    assert table.count() == len(tree.nodes) and table.filter("feature IS NULL").count() == len(tree.leaves())


def test_regression_tree(spark):
    rng = random.Random(4)
    rows = [(x := rng.random(), k := rng.choice(["u", "v"]), 1e6 + (10.0 if x > 0.5 else 0.0) + (3.0 if k == "u" else 0.0) + rng.gauss(0, 0.1)) for _ in range(1500)]
    df = spark.createDataFrame(rows + [(0.1, "u", None), (None, None, 1e6)], "x double, k string, y double")
    tree = TR.fit_regressor(df, ["x", "k"], "y", delta=0.05, max_depth=4)
    assert tree.nodes[0].feature == "x" and abs(tree.nodes[0].at - 0.5) < 0.06
    assert {n.feature for n in tree.nodes} == {"x", "k", None}
    errors = [abs(r.y - r.y_pred) for r in TR.predict(df.filter("y IS NOT NULL AND abs(x - 0.5) > 0.06"), tree).collect()]
    assert max(errors) < 1.0


@pytest.mark.parametrize("name", ["gini", "info_gain", "hellinger"])
def test_merits(spark, name):
    pairs = [([3.0, 1.0], [0.0, 4.0]), ([5.0, 5.0], [5.0, 5.0]), ([0.0, 0.0], [2.0, 3.0]), ([9.0, 0.0], [1.0, 0.0]), ([1.0, 999.0], [1.0, 0.0])]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(CRITERIA[name].merit(F.col("a"), F.col("b"))).collect()]
    assert got == [None if w is None else pytest.approx(w) for w in (plain_merit(name, a, b) for a, b in pairs)]


def test_empty_and_bound(spark):
    df = spark.createDataFrame([], "x double, y string")
    tree = TR.fit_classifier(df, ["x"], "y")
    assert TR.predict(spark.createDataFrame([(1.0, "a")], "x double, y string"), tree).first().y_pred is None
    assert TR.fit_regressor(spark.createDataFrame([], "x double, y double"), ["x"], "y").nodes[0].feature is None
    assert TR.hoeffding_bound(1.0, 1e-7, 200) == pytest.approx(0.2007, abs=1e-4)


def test_work_grows_with_nodes_and_rows_alone(spark):
    """A tree's expression holds every node once, nulls and NaN find their branch, and features do not multiply rows."""
    tree = TR.Tree(["x"], ["s"], ["a"])

    def grow(depth, low, high):
        at = len(tree.nodes)
        tree.nodes.append(TR.Node(depth, [1.0]))
        if depth < 6:
            n, n.feature, n.at, n.null_left = (tree.nodes[at], "x", (low + high) / 2, depth % 2 == 0)
            n.left = grow(depth + 1, low, n.at)
            n.right = grow(depth + 1, n.at, high)
        return at

    def leaf(x):
        at = 0
        while tree.nodes[at].feature:
            n = tree.nodes[at]
            left = n.null_left if x is None or x != x else x <= n.at
            at = n.left if left else n.right
        return at

    grow(0, 0.0, 64.0)
    values = [None, float("nan"), *[float(v) for v in range(-1, 67)]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = {r.i: r.leaf for r in df.select("i", tree.leaf().alias("leaf")).collect()}
    assert got == {i: leaf(v) for i, v in enumerate(values)}
    plan = df.select(tree.leaf().alias("leaf"))._jdf.queryExecution().analyzed().toString()
    assert plan.upper().count("CASE WHEN") <= 2 * 63 + 1

    rows = spark.createDataFrame([(0, [1.0, 0.0], 1.0, 2.0), (0, [0.0, 1.0], 2.0, None)], f"{TR.NODE} int, {TR.Y} array<double>, x double, z double")
    found = TR.candidates(rows, ["x", "z"], [], 2, CRITERIA["info_gain"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1  # of thresholds, not of rows
