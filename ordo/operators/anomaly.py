"""Anomaly scorers and thresholders.

Half-space trees: the score of a row depends only on the node masses of the
*previous* window of ``window_size`` rows.  Rows are numbered once and cut into
blocks of many windows, each with the window before its first (``plans.rows``);
one call scores a block.  Each row descends every tree in numpy to one leaf; a
node's mass is the number of the previous window's leaves below it, counted for
all windows of the block at once, and the score is the depth-weighted
mass along each path (it stops once the mass drops below 0.1·window).  The
first window scores 0.  A null or NaN feature goes left.

Trees are drawn from a seeded generator on the driver (their size is set by
the parameters, not the data).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import Stat
from ..plans.rows import PLACE, blockwise, placed, plus
from .windows import _as_list, _window, running


def hst_trees(features: Sequence[str], n_trees: int = 10, height: int = 8,
              limits: Mapping[str, tuple[float, float]] | None = None, seed: int = 0,
              padding: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """Random padded half-space trees in heap layout.

    Returns ``feat[t, node]`` (feature index) and ``thr[t, node]`` for
    internal nodes 1 .. 2**height - 1.  A node splits a feature picked with
    probability proportional to the width of that feature's current range,
    at a uniform point inside the range shrunk by ``padding`` on both sides.
    Built level by level with vectorised draws.
    """
    rng = np.random.default_rng(seed)
    k = len(features)
    base = np.array([limits.get(f, (0.0, 1.0)) if limits else (0.0, 1.0) for f in features], dtype=float)
    n_int = 2 ** height
    feat = np.zeros((n_trees, n_int), dtype=np.int32)
    thr = np.zeros((n_trees, n_int), dtype=float)
    for t in range(n_trees):
        lims = base[None, :, :].copy()  # (nodes in level, k, 2)
        for level in range(height):
            first = 2 ** level
            widths = lims[:, :, 1] - lims[:, :, 0]
            tot = widths.sum(axis=1, keepdims=True)
            p = np.where(tot > 0, widths / np.where(tot > 0, tot, 1.0), 1.0 / k)
            u = rng.random(len(lims))
            f = np.minimum((np.cumsum(p, axis=1) < u[:, None]).sum(axis=1), k - 1)
            idx = np.arange(len(lims))
            a, b = lims[idx, f, 0], lims[idx, f, 1]
            at = a + padding * (b - a) + rng.random(len(lims)) * (1 - 2 * padding) * (b - a)
            feat[t, first:2 * first] = f
            thr[t, first:2 * first] = at
            left, right = lims.copy(), lims.copy()
            left[idx, f, 1] = at
            right[idx, f, 0] = at
            nxt = np.empty((2 * len(lims), k, 2))
            nxt[0::2], nxt[1::2] = left, right
            lims = nxt
    return feat, thr


def hst_leaves(X: np.ndarray, feat: np.ndarray, thr: np.ndarray, height: int) -> np.ndarray:
    """Leaf heap ids (n_rows, n_trees): go right when x >= threshold."""
    n = X.shape[0]
    out = np.empty((n, feat.shape[0]), dtype=np.int64)
    flat, rows = np.ascontiguousarray(X).ravel(), np.arange(n) * X.shape[1]
    for t in range(feat.shape[0]):
        node = np.ones(n, dtype=np.int64)
        for _ in range(height):
            node = 2 * node + (flat.take(rows + feat[t].take(node)) >= thr[t].take(node))
        out[:, t] = node
    return out


def hst_score_window(leaves: np.ndarray, prev_leaves: np.ndarray | None, n_trees: int, height: int,
                     window_size: int) -> np.ndarray:
    """Scores of one window's rows from the previous window's leaves.

    The mass of a node at depth d is the number of previous-window leaves in
    its heap range [node << (h-d), (node+1) << (h-d)); with each tree's
    leaves sorted that is two binary searches, vectorised over rows."""
    if prev_leaves is None or len(prev_leaves) == 0:
        return np.zeros(leaves.shape[0])
    size_limit = 0.1 * window_size
    max_score = n_trees * window_size * (2 ** (height + 1) - 1)
    score = np.zeros(leaves.shape[0])
    for t in range(n_trees):
        keys = np.sort(prev_leaves[:, t])
        leaf = leaves[:, t]
        alive = np.ones(leaf.shape[0], dtype=bool)
        for depth in range(height + 1):
            shift = height - depth
            node = leaf >> shift
            m = (np.searchsorted(keys, (node + 1) << shift) - np.searchsorted(keys, node << shift)).astype(float)
            score += np.where(alive, m * (2.0 ** depth), 0.0)
            alive &= m >= size_limit
    return 1.0 - score / max_score


def hst_scores(leaves: np.ndarray, windows: np.ndarray, own: int, n_trees: int, height: int, window_size: int) -> np.ndarray:
    """Scores of the rows from ``own`` on, given the leaves and the window number of all rows in order.

    As ``hst_score_window`` for all windows at once: a level is looked at only
    for rows whose path still has mass, in a table of counts while it is small
    and by binary search below.
    """
    size_limit = 0.1 * window_size
    max_score = n_trees * window_size * (2 ** (height + 1) - 1)
    at = (windows - windows[0]).astype(np.int64) if len(windows) else windows
    count = int(at[-1]) + 1 if len(at) else 0
    earlier = at[own:] - 1  # the window that a row is judged by
    score = np.zeros(len(leaves) - own)
    held = np.bincount(at, minlength=count)
    judged = np.flatnonzero(earlier >= 0)
    judged = judged[held[earlier[judged]] > 0]
    for t in range(n_trees):
        leaf = np.ascontiguousarray(leaves[:, t])
        rows, mine, before, keys = judged, leaf[own:][judged], earlier[judged], None
        for depth in range(height + 1):
            shift = height - depth
            if 2**depth <= window_size:  # nodes of a level are numbered from 2 ** depth
                masses = np.bincount((at << depth) + (leaf >> shift) - 2**depth, minlength=count << depth)
                m = masses[(before << depth) + (mine >> shift) - 2**depth]
            else:
                if keys is None:
                    keys = np.sort((at << (height + 2)) + leaf)
                first = (before << (height + 2)) + ((mine >> shift) << shift)
                m = np.searchsorted(keys, first + (1 << shift)) - np.searchsorted(keys, first)
            score[rows] += m * 2.0**depth
            alive = np.flatnonzero(m >= size_limit)
            if not len(alive):
                break
            rows, mine, before = rows[alive], mine[alive], before[alive]
    out = np.zeros(len(score))
    out[judged] = 1.0 - score[judged] / max_score
    return out


def half_space_trees(df: DataFrame, features: Sequence[str], order: Sequence[str] | str, n_trees: int = 10,
                     height: int = 8, window_size: int = 250,
                     limits: Mapping[str, tuple[float, float]] | None = None, seed: int = 0,
                     id_col: str = "_rn", name: str = "hst_score", windows_per_block: int = 40) -> DataFrame:
    """Test-then-train half-space-tree anomaly score of every row (1 = anomalous); ``id_col`` numbers the rows from 1."""
    order, fcols = _as_list(order), list(features)
    trees = df.sparkSession.sparkContext.broadcast(hst_trees(features, n_trees, height, limits, seed))
    rows = placed(df, [], order)
    schema = plus(rows, (id_col, T.LongType()), (name, T.DoubleType()))

    def run(frame: pd.DataFrame, own: int) -> pd.DataFrame:
        places = frame[PLACE].to_numpy()
        leaves = hst_leaves(frame[fcols].to_numpy(dtype=float), *trees.value, height)
        found = hst_scores(leaves, places // window_size, own, n_trees, height, window_size)
        return frame.iloc[own:].assign(**{id_col: places[own:] + 1, name: found})[schema.names]

    return blockwise(rows, [], max(1, windows_per_block) * window_size, window_size, run, schema)


def threshold_constant(df: DataFrame, score: str, threshold: float, name: str = "is_anomaly") -> DataFrame:
    return df.withColumn(name, (F.col(score) > F.lit(threshold)).cast("int"))


def threshold_quantile(df: DataFrame, score: str, q: float, by, order, name: str = "is_anomaly") -> DataFrame:
    """1 when the score exceeds the running q-quantile of scores so far
    (current score included)."""
    w = _window(_as_list(by), _as_list(order)).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_ordo_q", F.percentile(F.col(score), F.lit(float(q))).over(w))
    return d.withColumn(name, (F.col(score) > F.col("_ordo_q")).cast("int")).drop("_ordo_q")


def minmax_unkeyed(df: DataFrame, cols: Sequence[str], order) -> DataFrame:
    """Running min-max scaling over the whole stream (blocked, never one task)."""
    tmp = {}
    for c in cols:
        tmp[f"_lo_{c}"] = Stat.of("min", c)
        tmp[f"_hi_{c}"] = Stat.of("max", c)
    d = running(df, tmp, by=None, order=order)
    out = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.lit(0.0))
           for c in cols}
    return d.withColumns(out).drop(*tmp)
