"""Randomised hashing and half-space chains against plain row-by-row versions."""

import math
import random

import numpy as np
import pytest

from ordo.operators import subspaces as S


def plain_rs_hash(rows, components, decay):
    seen, out = [{} for _ in components], []
    for t, x in enumerate(rows):
        total = 0.0
        for c, cells in zip(components, seen):
            key = tuple(math.floor((x[f] + s) / c.width) for f, s in zip(c.features, c.shifts))
            last, weight = cells.get(key, (t, 0.0))
            weight *= 2.0 ** (-decay * (t - last))
            total += math.log(1 + weight)
            cells[key] = (t, weight + 1)
        out.append(total / len(components))
    return out


@pytest.mark.parametrize("decay", [0.015, 1.0])
def test_rs_hash(spark, decay):
    """With a fast decay the blocks are short, so that several follow each other."""
    rng = random.Random(7)
    rows = [(rng.random(), rng.random() ** 3, rng.choice([0.1, 0.9])) for _ in range(2500)]
    parts = S.hash_components(3, 12, decay, seed=1)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)] + [(9999, None, 1.0, 1.0)], "i long, a double, b double, c double").repartition(6)
    got = {r.i: r.rs_hash for r in S.rs_hash(df, ["a", "b", "c"], "i", decay=decay, components=parts).collect()}
    assert got[9999] is None
    assert np.allclose([got[i] for i in range(len(rows))], plain_rs_hash(rows, parts, decay))


def test_drawn_grids():
    parts = S.hash_components(9, 200, seed=2, usable=[1, 4, 5])
    assert all(set(c.features) <= {1, 4, 5} and len(set(c.features)) == len(c.features) for c in parts)
    assert all(1 / math.sqrt(1000) <= c.width <= 1 - 1 / math.sqrt(1000) and max(c.shifts) <= c.width for c in parts)
    assert len({len(c.features) for c in parts}) > 1
    matrix = S.projection(60, 40, seed=3)
    assert 0.28 < (matrix != 0).mean() < 0.39


def plain_xstream(rows, matrix, drawn, window):
    """One row at a time: score, then learn."""
    k = matrix.shape[1]
    spread, current, out = np.full(k, 0.5), [], []
    old = [[{} for _ in c.features] for c in drawn]
    new = [[{} for _ in c.features] for c in drawn]
    first = True
    for t, x in enumerate(rows):
        y = np.zeros(k)
        for j, v in enumerate(x):
            y = y + v * matrix[j]
        total = 0.0
        for c, chain in enumerate(drawn):
            bins, halved, least = np.zeros(k), set(), math.inf
            for d, f in enumerate(chain.features):
                shift = chain.shifts[f] * spread[f]
                bins[f] = 2.0 * bins[f] - shift / spread[f] if f in halved else (y[f] + shift) / spread[f]
                halved.add(f)
                key = tuple(np.floor(bins).tolist())
                held = (new if first else old)[c][d].get(key, 0)
                least = min(least, math.log2(1.0 + held) + d + 1)
                new[c][d][key] = new[c][d].get(key, 0) + 1
            total -= least
        out.append(total / len(drawn))
        current.append(y)
        if (t + 1) % window == 0:
            half = (np.max(current, axis=0) - np.min(current, axis=0)) / 2.0
            half[half <= 0.0001] = 1.0
            spread, current, first = half, [], False
            old, new = new, [[{} for _ in c.features] for c in drawn]
    return out


@pytest.mark.parametrize("windows_per_block", [2, 1000])
def test_xstream(spark, windows_per_block):
    rng = random.Random(9)
    rows = [(rng.gauss(0, 1), rng.random(), float(i // 200)) for i in range(590)]
    matrix, drawn = S.projection(3, 5, density=0.8, seed=1), S.chains(4, 6, 5, seed=2)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)] + [(9999, float("nan"), 1.0, 1.0)], "i long, a double, b double, c double").repartition(4)
    found = S.xstream(df, ["a", "b", "c"], "i", matrix=matrix, drawn=drawn, window_size=40, windows_per_block=windows_per_block)
    got = {r.i: r.xstream for r in found.collect()}
    assert got[9999] is None
    assert np.allclose([got[i] for i in range(len(rows))], plain_xstream(rows, matrix, drawn, 40))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "i long, a double")
    assert S.rs_hash(df, ["a"], "i").count() == 0
    assert S.xstream(df, ["a"], "i").count() == 0
