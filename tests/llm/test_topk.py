"""The search against all pairs scored in Python integers."""

import math
import random

import numpy as np
import pytest

from ordo.llm import topk


def plain(rows, every, k):
    ints = {}
    for i, (vec_id, v) in enumerate(rows):
        if vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints[i] = (vec_id, v, [math.floor(1024 * float(x)) for x in v])
    asked = {}
    for vec_id, v, w in ints.values():
        if vec_id % every == 0 and (vec_id not in asked or v < asked[vec_id][0]):
            asked[vec_id] = (v, w)
    out = []
    for q, (_, w) in asked.items():
        found = [(sum(a * b for a, b in zip(w, x)), i) for i, _, x in ints.values() if i != q]
        found = sorted(((min(max(s, -(1 << 63)), (1 << 63) - 1), i) for s, i in found), key=lambda t: (-t[0], t[1]))[:k]
        out += [(q, r, i, s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def check(spark, rows, every=5, k=4, **more):
    table = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, rank int, score int, id int").repartition(5)
    got = topk.nearest_embeddings(table, every, k, **more).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, every, k)


def test_ties_copies_and_small_values(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.5, 0.0, 2.0]) for _ in range(3)]) for i in range(150)]
    rows += [(1000 + i, [1.0, 1.0, 1.0]) for i in range(60)]  # a group of copies
    check(spark, rows)
    check(spark, rows, k=1, block_bytes=8 * 3 * 7)  # several blocks of queries


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (5, [nan, 1.0]), (10, None), (15, [None, 1.0]), (20, [inf, 0.0]), (25, []), (30, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    rows += [(35, [0.1, -0.1]), (35, [0.3, 0.3]), (41, [1e-9, -1e-9]), (42, [5.0]), (42, [5.0]), (-5, [2.5, 2.5])]
    check(spark, rows, k=20)
    check(spark, rows, k=3)


@pytest.mark.parametrize("big", [1e6, 1e13, 1e300])
def test_large_components(spark, big):
    rng = np.random.default_rng(3)
    check(spark, [(i, (rng.normal(size=4) * big).tolist()) for i in range(40)])


def test_empty_and_alone(spark):
    check(spark, [])
    check(spark, [(1, [1.0])])
    check(spark, [(0, [1.0])])
    check(spark, [(0, None), (1, None)])
