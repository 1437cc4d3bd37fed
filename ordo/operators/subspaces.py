"""Anomaly scores from counts in random subspaces: randomised hashing with decay, and half-space chains.

Both look back a bounded number of rows, so a stream is cut into blocks with a
halo (``plans.rows``) and each block is scored on its own.

Randomised hashing counts, for each of its components, the earlier rows in the
row's grid cell, each weighted by ``2 ** (-decay * age)``.  A row whose weight
all earlier rows together could not lift above a double's rounding of 1 is out
of sight, which bounds the halo; within a block the sums are taken relative to
the block's start, so that no power overflows.

Half-space chains count the rows of the window before in ever finer bins of
chained random features of a sparse projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..plans.rows import PLACE, blockwise, placed, plus
from .neighbors import _with_nulls, complete
from .windows import _as_list

POWERS = 900  # of two that a block's decay may span
EPSILON_BITS = 54  # a term below 2 ** -EPSILON_BITS does not change 1 + count


@dataclass(frozen=True)
class Component:
    """One grid: the width of its cells, its features, and their shifts."""

    width: float
    features: tuple[int, ...]
    shifts: tuple[float, ...]


def hash_components(n_features: int, n: int = 100, decay: float = 0.015, seed: int = 0, usable: Sequence[int] | None = None) -> list[Component]:
    """Random grids for features scaled to about one unit.

    The cell width is uniform between 1/sqrt(s) and 1 - 1/sqrt(s), where s is
    the effective number of rows, at least 1000; the number of features lies
    between 1 + l/2 and l with l = log(s) / log(max(2, 1/width)).  ``usable``:
    features that vary.
    """
    rng = np.random.default_rng(seed)
    usable = list(range(n_features)) if usable is None else list(usable)
    rows = max(1000.0, 1 / (1 - 2.0**-decay))
    out = []
    for _ in range(n):
        width = rng.uniform(1 / math.sqrt(rows), 1 - 1 / math.sqrt(rows))
        most = math.log(rows) / math.log(max(2.0, 1 / width))
        least = 1 + most / 2
        size = 1 if int(least) >= int(most) else min(int(rng.integers(int(least), int(most))), len(usable))
        picked = tuple(int(f) for f in rng.choice(usable, size=max(1, size), replace=False))
        out.append(Component(float(width), picked, tuple(float(s) for s in rng.uniform(0, width, len(picked)))))
    return out


def decayed_scores(x: np.ndarray, own: int, components: Sequence[Component], decay: float) -> np.ndarray:
    """Mean over the components of ln(1 + decayed count of earlier rows in the row's cell)."""
    age = np.arange(len(x), dtype=float)
    weight = np.exp2(decay * age)
    out = np.zeros(len(x) - own)
    for c in components:
        cells = np.floor((x[:, list(c.features)] + np.array(c.shifts)) / c.width)
        codes = pd.DataFrame(cells).groupby(list(range(cells.shape[1])), sort=False).ngroup()
        before = pd.Series(weight).groupby(codes.to_numpy()).cumsum().to_numpy() - weight
        out += np.log(1 + np.maximum(before[own:], 0.0) * np.exp2(-decay * age[own:]))
    return out / len(components)


def rs_hash(
    df: DataFrame,
    features: Sequence[str],
    order: Sequence[str] | str,
    by: Sequence[str] | str | None = None,
    decay: float = 0.015,
    components: Sequence[Component] | None = None,
    seed: int = 0,
    name: str = "rs_hash",
) -> DataFrame:
    """``df`` with the randomised-hashing score of each row (low: anomalous), from the rows before it.

    Features should be scaled to [0, 1].  Rows with a null or NaN feature are
    not counted and get null.
    """
    if decay <= 0:
        raise ValueError("decay must be positive")
    features, by, order = _as_list(features), _as_list(by), _as_list(order)
    components = components or hash_components(len(features), decay=decay, seed=seed)
    # all rows older than this together weigh less than rounding: sum of 2 ** (-decay * age) from there on
    before = math.ceil((EPSILON_BITS - math.log2(1 - 2.0**-decay)) / decay)
    rows_per_block = max(before, int(POWERS / decay) - before)
    ok = complete(df, features)
    rows = placed(df.filter(ok), by, order)
    schema = plus(rows, (name, T.DoubleType()))

    def run(frame: pd.DataFrame, own: int) -> pd.DataFrame:
        found = decayed_scores(frame[features].to_numpy(dtype=float), own, components, decay)
        return frame.iloc[own:].assign(**{name: found})[schema.names]

    return _with_nulls(df, ok, blockwise(rows, by, rows_per_block, before, run, schema), name)


@dataclass(frozen=True)
class Chain:
    """Feature of the projection that each depth halves, and the shift of each feature as a share of its range."""

    features: tuple[int, ...]
    shifts: tuple[float, ...]


def projection(n_features: int, n_components: int = 10, density: float = 1 / 3, seed: int = 0) -> np.ndarray:
    """Sparse random signs, (n_features, n_components): each is 0 but for a share ``density``."""
    u = np.random.default_rng(seed).random((n_features, n_components))
    size = math.sqrt(1 / density) / math.sqrt(n_components)
    return np.where(u <= density / 2, -size, np.where(u <= density, size, 0.0))


def chains(n: int = 10, depth: int = 8, n_components: int = 10, seed: int = 0) -> list[Chain]:
    rng = np.random.default_rng(seed)
    return [Chain(tuple(int(f) for f in rng.integers(0, n_components, depth)), tuple(float(s) for s in rng.random(n_components))) for _ in range(n)]


def chain_bins(y: np.ndarray, spread: np.ndarray, chain: Chain) -> np.ndarray:
    """Bins (rows, depth, components) of projected rows, given each row's half range of every component."""
    bins, out = np.zeros_like(y), np.zeros((len(y), len(chain.features), y.shape[1]))
    halved = set()
    for depth, f in enumerate(chain.features):
        shift = chain.shifts[f] * spread[:, f]
        bins[:, f] = 2.0 * bins[:, f] - shift / spread[:, f] if f in halved else (y[:, f] + shift) / spread[:, f]
        halved.add(f)
        out[:, depth] = np.floor(bins)
    return out


def half_ranges(y: np.ndarray, window: np.ndarray, first: int) -> np.ndarray:
    """For each row half the range of every component in the window before; 0.5 in the first window, 1 where there is none."""
    low = pd.DataFrame(y).groupby(window).min()
    high = pd.DataFrame(y).groupby(window).max()
    half = ((high - low) / 2.0).where(lambda h: h > 0.0001, 1.0)
    out = half.reindex(window - 1).to_numpy()
    out[window == 0] = 0.5
    return out


def chain_scores(x: np.ndarray, places: np.ndarray, own: int, matrix: np.ndarray, drawn: Sequence[Chain], window_size: int) -> np.ndarray:
    """Mean over the chains of -min over depths d of log2(1 + count) + d, the counts from the window before.

    In the first window the counts are those of the rows so far.
    """
    y = np.zeros((len(x), matrix.shape[1]))
    for j in range(x.shape[1]):  # feature by feature, so that sums do not depend on the block
        y += x[:, j, None] * matrix[None, j, :]
    window = places // window_size
    spread = half_ranges(y, window, int(window[0]))
    out = np.zeros(len(x) - own)
    for chain in drawn:
        bins = chain_bins(y, spread, chain)
        least = np.full(len(x) - own, np.inf)
        for d in range(bins.shape[1]):
            keys = pd.DataFrame(bins[:, d]).groupby(list(range(bins.shape[2])), sort=False).ngroup().to_numpy()
            counts = pd.Series(1, index=pd.MultiIndex.from_arrays([window + 1, keys])).groupby(level=[0, 1]).sum()
            held = counts.reindex(pd.MultiIndex.from_arrays([window[own:], keys[own:]])).fillna(0).to_numpy()
            so_far = pd.Series(keys).groupby([window, keys]).cumcount().to_numpy()[own:]
            held = np.where(window[own:] == 0, so_far, held)
            least = np.minimum(least, np.log2(1.0 + held) + d + 1)
        out -= least
    return out / len(drawn)


def xstream(
    df: DataFrame,
    features: Sequence[str],
    order: Sequence[str] | str,
    by: Sequence[str] | str | None = None,
    n_components: int = 10,
    n_chains: int = 10,
    depth: int = 8,
    window_size: int = 250,
    seed: int = 0,
    matrix: np.ndarray | None = None,
    drawn: Sequence[Chain] | None = None,
    name: str = "xstream",
    windows_per_block: int = 80,
) -> DataFrame:
    """``df`` with the half-space-chain score of each row (high: anomalous) against the window before.

    Rows with a null or NaN feature are not counted and get null.
    """
    features, by, order = _as_list(features), _as_list(by), _as_list(order)
    matrix = projection(len(features), n_components, seed=seed) if matrix is None else matrix
    drawn = chains(n_chains, depth, matrix.shape[1], seed + 1) if drawn is None else drawn
    ok = complete(df, features)
    rows = placed(df.filter(ok), by, order)
    schema = plus(rows, (name, T.DoubleType()))

    def run(frame: pd.DataFrame, own: int) -> pd.DataFrame:
        x, places = frame[features].to_numpy(dtype=float), frame[PLACE].to_numpy()
        found = chain_scores(x, places, own, matrix, drawn, window_size)
        return frame.iloc[own:].assign(**{name: found})[schema.names]

    # counts of the window before, binned by the ranges of the one before that
    size = max(2, windows_per_block) * window_size
    return _with_nulls(df, ok, blockwise(rows, by, size, 2 * window_size, run, schema), name)
