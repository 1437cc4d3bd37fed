"""Combined predictions against row-by-row versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ordo.operators import ensemble as EN


def test_expert_weighting_and_greedy(spark):
    rng = random.Random(2)
    rows = [(i, float(i % 5), None if i % 9 == 4 else float(i % 5) + rng.gauss(0, 0.3), float(rng.randint(0, 4)), 2.0) for i in range(120)]
    df = spark.createDataFrame(rows, "i long, y double, a double, b double, c double").repartition(4)
    got = {r.i: r.p for r in EN.expert_weighting(df, ["a", "b", "c"], "y", "i", learning_rate=0.2, name="p").collect()}
    lost = [0.0] * 3
    for i, y, *ps in rows:
        here = [k for k, p in enumerate(ps) if p is not None]
        least = min(lost[k] for k in here)
        w = {k: math.exp(-0.2 * (lost[k] - least)) for k in here}
        assert got[i] == pytest.approx(sum(w[k] * ps[k] for k in here) / sum(w.values()))
        for k in here:
            lost[k] += (ps[k] - y) ** 2
    chosen = {r.i: (r.model, r.y_pred) for r in EN.greedy_selection(df, ["a", "b", "c"], "y", "i").collect()}
    lost, n = [0.0] * 3, [0] * 3
    for i, y, *ps in rows:
        means = [lost[k] / n[k] if n[k] else math.inf for k in range(3)]
        best = min(range(3), key=lambda k: (round(means[k], 12), k))
        assert chosen[i] == ("abc"[best], ps[best])
        for k, p in enumerate(ps):
            if p is not None:
                lost[k], n[k] = lost[k] + abs(p - y), n[k] + 1


def test_votes(spark):
    df = spark.createDataFrame([("b", "a", "b"), ("b", "a", None), (None, None, None), ("c", "c", "c")], "x string, y string, z string")
    assert [r.y_pred for r in EN.voting(df, ["x", "y", "z"]).collect()] == ["b", "a", None, "c"]
    maps = [({"a": 0.6, "b": 0.4}, {"b": 0.9, "a": 0.1}), ({"a": 1.0}, None), (None, None), ({"b": 0.5, "a": 0.5}, {"c": 0.5})]
    df = spark.createDataFrame(maps, "x map<string,double>, y map<string,double>")
    assert [r.y_pred for r in EN.soft_voting(df, ["x", "y"]).collect()] == ["b", "a", None, "a"]


def test_bags(spark):
    df = spark.range(4000).withColumn("y", F.col("id") % 10)
    bags = EN.bags(df, 5, "id")
    found = bags.groupBy("model").agg(F.sum("weight").alias("n"), (F.sum(F.col("weight") * F.col("y")) / F.sum("weight")).alias("mean")).collect()
    assert len(found) == 5 and all(3700 < r.n < 4300 and abs(r.mean - 4.5) < 0.2 for r in found)
    assert 0.6 < bags.select("id", "model").count() / 20000 < 0.66
    assert len({r.n for r in found}) > 1
