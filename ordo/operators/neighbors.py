"""Nearest neighbours: in row windows, in a whole table through boxes, and what is predicted from them.

``window_neighbors`` looks among the rows just before each row, block by block
with a halo.  ``knn_join`` finds the exact neighbours of query rows in a whole
table: a tree of cuts across the widest feature deals training rows to boxes of
about equal size, and the extent of a box's rows tells how near they can be.
Each query first searches the box of its own place, which bounds its k-th
distance; only boxes within that bound follow.  Ties go to the older row, or the
smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.rows import PLACE, blockwise, placed, plus, written
from .windows import _as_list

BLOCK_ROWS = 20_000
CHUNK = 64  # rows whose windows share one matrix of distances
CELLS = 1 << 21  # distances held at a time
CELLS_SEARCHED = 1 << 17  # the same while a box is searched
MAX_BOXES = 50_000  # bound of the tree that tasks get
SLACK = 1e-9  # relative rounding of distances that bounds allow for


def distances(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Minkowski distances of all rows of ``a`` and ``b``, summed feature by feature."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = np.abs(a[:, j, None] - b[None, :, j])
        out += gap * gap if p == 2 else gap if p == 1 else gap**p
    return np.sqrt(out) if p == 2 else out if p == 1 else out ** (1 / p)


def complete(df: DataFrame, features: Sequence[str]) -> Column:
    """Whether a row has a value other than NaN in every feature."""
    out = F.lit(True)
    for c in features:
        out = out & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return out


def _with_nulls(df: DataFrame, ok: Column, found: DataFrame, name: str) -> DataFrame:
    rest = df.filter(~ok).withColumn(name, F.lit(None).cast(found.schema[name].dataType))
    return found.unionByName(rest)


# ------------------------------------------------------------ row windows


def local_outlier_factors(x: np.ndarray, own: int, k: int, window: int) -> np.ndarray:
    """Factor of each row from ``own`` on within the ``window`` rows that end with it.

    Rows of a chunk share one order of neighbours; a window lacks fewer than
    CHUNK of its rows, so each row's first k + CHUNK - 1 hold the k nearest.
    """
    out = np.ones(len(x) - own)
    if window <= k:
        return out  # too few rows to compare with
    for at in range(max(own, k), len(x), CHUNK):
        low, end = max(0, at - window + 1), min(at + CHUNK, len(x))
        near = distances(x[low:end], x[low:end], 2)
        np.fill_diagonal(near, np.inf)
        order = np.argsort(near, axis=1, kind="stable")[:, : k + CHUNK - 1].astype(np.int32)
        step = max(1, CELLS // (k * k * order.shape[1]))
        for lo in range(at, end, step):
            i = np.arange(lo, min(lo + step, end))
            out[i - own] = _factors(near, order, i - low, np.maximum(0, i - window + 1) - low, k)
    return out


def _factors(near: np.ndarray, order: np.ndarray, i: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """Factor of each row of ``i`` among the rows from its ``start`` to itself."""
    first, last = start.astype(np.int32), i.astype(np.int32)
    short = np.ascontiguousarray(order[:, : 2 * k + 4])

    def nearest(rows: np.ndarray, at: np.ndarray, among: np.ndarray, only_last: bool) -> np.ndarray:
        """The k nearest of each row, or the k-th alone, in the window of place ``at``."""
        o = among[rows]
        met = (o >= first[at, None]) & (o <= last[at, None])
        upto = np.cumsum(met, axis=1, dtype=np.int32)
        if not only_last:
            met &= upto <= k
        few = upto[:, -1] < k  # most of what is near is out of the window
        if few.any():
            out = np.empty(len(rows) if only_last else (len(rows), k), np.int32)
            out[few] = nearest(rows[few], at[few], order, only_last)
            o, met, upto = o[~few], met[~few], upto[~few]
        got = o[np.arange(len(o)), (upto >= k).argmax(axis=1)] if only_last else o[met].reshape(-1, k)
        if not few.any():
            return got
        out[~few] = got
        return out

    at = np.arange(len(i))
    mine = nearest(i, at, order, False)
    theirs = nearest(mine.ravel(), np.repeat(at, k), short, False).reshape(len(i), k, k)
    pairs, where = np.unique((at[:, None] * len(near) + theirs.reshape(len(i), -1)).ravel(), return_inverse=True)
    rows = pairs % len(near)
    kth = near[rows, nearest(rows, pairs // len(near), short, True)][where].reshape(theirs.shape)
    reach = np.maximum(near[i[:, None], mine], near[mine, theirs[..., -1]]).sum(axis=-1)
    reaches = np.maximum(near[mine[..., None], theirs], kth).sum(axis=-1)
    density = np.where(reach != 0, k / np.where(reach != 0, reach, 1.0), 1e6)
    densities = np.where(reaches > 0, k / np.where(reaches > 0, reaches, 1.0), 1e6)
    return densities.sum(axis=-1) / (k * density)


def local_outlier_factor(
    df: DataFrame,
    features: Sequence[str],
    by: Sequence[str] | str | None = None,
    order: Sequence[str] | str = (),
    k: int = 10,
    window_size: int = 250,
    name: str = "lof",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``df`` with the local outlier factor of each row among its key's last ``window_size`` rows, its own included.

    1 while there are at most k rows.  The density of rows at one place is
    1e6.  Rows with a null or NaN feature are in no window and get null.
    """
    features, by, order = _as_list(features), _as_list(by), _as_list(order)
    ok = complete(df, features)
    rows = placed(df.filter(ok), by, order)
    schema = plus(rows, (name, T.DoubleType()))

    def run(frame: pd.DataFrame, own: int) -> pd.DataFrame:
        found = local_outlier_factors(frame[features].to_numpy(dtype=float), own, k, window_size)
        return frame.iloc[own:].assign(**{name: found})[schema.names]

    return _with_nulls(df, ok, blockwise(rows, by, max(block_rows, window_size), window_size - 1, run, schema), name)


def window_neighbors(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    by: Sequence[str] | str | None = None,
    order: Sequence[str] | str = (),
    k: int = 5,
    window_size: int = 1000,
    p: float = 2,
    name: str = "neighbors",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``df`` with the k nearest of the key's ``window_size`` rows before each row: array of (d, y), nearest first.

    ``y`` is the neighbour's target; equally far rows come oldest first.  The
    window counts rows; those with a null target are no neighbours.  Rows with
    a null or NaN feature are in no window and get null.
    """
    if p < 1:
        raise ValueError("p must be at least 1")
    features, by, order = _as_list(features), _as_list(by), _as_list(order)
    ok = complete(df, features)
    rows = placed(df.filter(ok), by, order)
    kind = T.ArrayType(T.StructType([T.StructField("d", T.DoubleType()), T.StructField("y", df.schema[target].dataType)]))
    schema = plus(rows, (name, kind))

    def run(frame: pd.DataFrame, own: int) -> pd.DataFrame:
        x, y = frame[features].to_numpy(dtype=float), frame[target].tolist()
        unknown = frame[target].isna().to_numpy()
        out = []
        for at in range(own, len(x), CHUNK):
            low, end = max(0, at - window_size), min(at + CHUNK, len(x))
            near = distances(x[at:end], x[low:end], p)
            near[:, unknown[low:end]] = np.inf
            for i in range(at, end):
                a = max(0, i - window_size) - low
                d = near[i - at, a : i - low]
                out.append([{"d": float(d[j]), "y": y[low + a + j]} for j in _smallest(d, k)])
        rows = frame.iloc[own:]
        return rows.assign(**{name: pd.Series(out, index=rows.index, dtype=object)})[schema.names]

    return _with_nulls(df, ok, blockwise(rows, by, max(block_rows, window_size), window_size, run, schema), name)


def _smallest(d: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k least finite values in order, ties by position."""
    if len(d) > k:
        some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    else:
        some = np.arange(len(d))
    some = some[np.isfinite(d[some])]
    return some[np.argsort(d[some], kind="stable")][:k]


# ------------------------------------------------------------ predictions


def votes(neighbors: Column, labels: Column, weighted: bool = True) -> Column:
    """Array of (label, vote): 1, or 1 / distance if ``weighted``, summed by label; a nearest neighbour at distance 0 has the only vote."""
    weight = (lambda n: 1.0 / n["d"]) if weighted else (lambda n: F.lit(1.0))

    def vote(label: Column) -> Column:
        total = F.aggregate(F.filter(neighbors, lambda n: n["y"] == label), F.lit(0.0), lambda acc, n: acc + weight(n))
        return F.struct(label.alias("label"), F.when(hit, (neighbors[0]["y"] == label).cast("double")).otherwise(total).alias("vote"))

    hit = F.coalesce(F.get(neighbors, F.lit(0))["d"] == 0, F.lit(False))
    return F.transform(labels, vote)


def knn_classify(df: DataFrame, neighbors: str = "neighbors", labels: Sequence | None = None, weighted: bool = True, name: str = "y_pred", proba: str = "y_proba") -> DataFrame:
    """``df`` with the label of most votes and the softmax of the votes as a map.

    A neighbour at distance 0 decides alone, with probability 1.  ``labels``
    are those the probabilities are over, the neighbours' own by default; ties
    go to the smaller label; no neighbours, no prediction.
    """
    near = F.col(neighbors)
    among = F.array_sort(F.array_distinct(F.transform(near, lambda n: n["y"]))) if labels is None else F.array(*[F.lit(v) for v in sorted(labels)])
    out = df.withColumn("_ordo_votes", F.when(F.size(near) > 0, votes(near, among, weighted)))
    held = F.col("_ordo_votes")
    top = F.array_max(F.transform(held, lambda v: v["vote"]))
    out = out.withColumn(name, F.filter(held, lambda v: v["vote"] == top)[0]["label"])
    exact = F.get(near, F.lit(0))["d"] == 0
    total = F.aggregate(held, F.lit(0.0), lambda acc, v: acc + F.exp(v["vote"] - top))
    share = F.transform(held, lambda v: F.struct(v["label"], F.when(exact, v["vote"]).otherwise(F.exp(v["vote"] - top) / total)))
    return out.withColumn(proba, F.map_from_entries(share)).drop("_ordo_votes")


def knn_regress(df: DataFrame, neighbors: str = "neighbors", how: str = "mean", name: str = "y_pred") -> DataFrame:
    """``df`` with the mean, median or (by 1 / distance) weighted mean of the neighbours' targets.

    A neighbour at distance 0 decides alone; without neighbours it is 0.
    """
    near = F.col(neighbors)
    y = F.transform(near, lambda n: n["y"].cast("double"))
    plus_ = lambda acc, v: acc + v
    if how == "mean":
        value = F.aggregate(y, F.lit(0.0), plus_) / F.size(near)
    elif how == "median":
        ranked = F.array_sort(y)
        value = (F.get(ranked, F.expr(f"(size({neighbors}) - 1) div 2").cast("int")) + F.get(ranked, F.expr(f"size({neighbors}) div 2").cast("int"))) / 2
    elif how == "weighted_mean":
        over = F.aggregate(near, F.lit(0.0), lambda acc, n: acc + n["y"].cast("double") / n["d"])
        value = over / F.aggregate(near, F.lit(0.0), lambda acc, n: acc + 1.0 / n["d"])
    else:
        raise ValueError(f"unknown aggregation {how}")
    first = F.get(near, F.lit(0))
    return df.withColumn(name, F.when(near.isNull(), None).when(F.size(near) == 0, 0.0).when(first["d"] == 0, first["y"].cast("double")).otherwise(value))


# ------------------------------------------------------------ whole tables


class Boxes(NamedTuple):
    """Cuts of a tree by node, the root first: rows with feature ``dim`` up to ``cut`` go left.  ``dim`` is -1 at a box."""

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray


def cuts(points: np.ndarray, most: int) -> Boxes:
    """Boxes of at most ``most`` of the points, halved across their widest feature; points at one place stay together."""
    nodes, left = [[-1, np.nan, -1, -1]], [(0, points)]
    while left:
        at, some = left.pop()
        if len(some) <= most:
            continue
        with np.errstate(invalid="ignore"):
            wide = np.nan_to_num(some.max(axis=0) - some.min(axis=0), nan=0.0)
        j = int(wide.argmax())
        if not wide[j] > 0:
            continue
        v = some[:, j]
        cut = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
        if not (v > cut).any():
            cut = v[v < cut].max()
        nodes[at] = [j, cut, len(nodes), len(nodes) + 1]
        left += [(len(nodes), some[v <= cut]), (len(nodes) + 1, some[v > cut])]
        nodes += [[-1, np.nan, -1, -1], [-1, np.nan, -1, -1]]
    dim, cut, low, high = zip(*nodes, strict=True)
    return Boxes(np.array(dim), np.array(cut, float), np.array(low), np.array(high))


def _box(x: np.ndarray, tree: Boxes) -> np.ndarray:
    """Box of each row."""
    node, rows = np.zeros(len(x), np.int32), np.arange(len(x))
    while True:
        rows = rows[tree.dim[node[rows]] >= 0]
        if not len(rows):
            return node
        at = node[rows]
        node[rows] = np.where(x[rows, tree.dim[at]] <= tree.cut[at], tree.left[at], tree.right[at])


def _extents(found: dict[int, tuple], tree: Boxes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest values of the rows under each node, from those of the boxes; none are at infinity."""
    low, high = np.full((len(tree.dim), n), np.inf), np.full((len(tree.dim), n), -np.inf)
    for node in range(len(tree.dim) - 1, -1, -1):  # children come after their parent
        if node in found:
            low[node], high[node] = found[node][:n], found[node][n:]
        elif tree.dim[node] >= 0:
            both = [tree.left[node], tree.right[node]]
            low[node], high[node] = low[both].min(axis=0), high[both].max(axis=0)
    return low, high


def _reached(x: np.ndarray, bound: np.ndarray, tree: Boxes, low: np.ndarray, high: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, box) for every box that may have rows within the ``bound`` of the row of ``x``."""
    limit = np.minimum(np.where(np.isnan(bound), np.inf, bound) * (1 + SLACK), np.finfo(float).max)
    row, node = np.arange(len(x)), np.zeros(len(x), int)
    rows, boxes = [], []
    with np.errstate(invalid="ignore", over="ignore"):
        while len(row):
            gap = np.maximum(np.maximum(low[node] - x[row], x[row] - high[node]), 0.0)
            some = (gap**p).sum(axis=1) ** (1 / p) <= limit[row]
            row, node = row[some], node[some]
            at_box = tree.dim[node] < 0
            rows.append(row[at_box])
            boxes.append(node[at_box])
            row, node = row[~at_box], node[~at_box]
            row, node = np.concatenate([row, row]), np.concatenate([tree.left[node], tree.right[node]])
    return np.concatenate(rows), np.concatenate(boxes)


def _matrix(batch: pa.RecordBatch | pa.Table, features: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features])


def _of_use(rows: pa.Table, x: Sequence[str], k: int) -> pa.Table:
    """The rows without those that k others at the same place, of smaller ids than theirs, precede for any query.

    A query leaves out one id, its own: k + 1 ids at a place, k rows of each, hold its k nearest there.
    """
    points = _matrix(rows, x)
    mark = sum(points[:, j] / (j + 1) for j in range(points.shape[1]))  # equal at equal places
    if len(np.unique(mark)) == len(mark):
        return rows
    rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in [*x, "id"]])).combine_chunks()
    points, ids = _matrix(rows, x), pc.dictionary_encode(rows.column("id")).combine_chunks().indices.to_numpy()
    place = np.r_[True, (points[1:] != points[:-1]).any(axis=1)]
    other = place | np.r_[True, ids[1:] != ids[:-1]]
    at, nth = np.arange(len(ids)), np.cumsum(other)
    rank = nth - nth[np.maximum.accumulate(np.where(place, at, 0))]  # of the id at its place
    copy = at - np.maximum.accumulate(np.where(other, at, 0))
    return rows.filter(pa.array((rank <= k) & (copy < k)))


def _nearest(asked: pa.Table, rows: pa.Table, x: Sequence[str], p: float, k: int, bound: np.ndarray | None = None) -> pa.Array:
    """For each row asked an array of (d, id, y), its k nearest of ``rows`` (none beyond its ``bound``)."""
    rows = _of_use(rows, x, k)
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending")]))
    a, b = _matrix(asked, x), _matrix(rows, x)
    code = pd.factorize(np.concatenate([rows.column("id").to_numpy(), asked.column("q").to_numpy()]))[0]
    code, mine = code[: len(b)], np.where(code[len(b) :] < 0, -2, code[len(b) :])
    order = np.argsort(code, kind="stable")
    start, stop = (np.searchsorted(code[order], mine, side=s) for s in ("left", "right"))
    sizes, hits, near = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    step = max(1, CELLS_SEARCHED // max(1, len(b)))
    for lo in range(0, len(a), step):
        d = distances(a[lo : lo + step], b, p)
        for i in np.flatnonzero(stop[lo : lo + step] > start[lo : lo + step]):
            d[i, order[start[lo + i] : stop[lo + i]]] = np.inf  # rows with the query's own id
        limit = np.full(len(d), np.finfo(float).max) if bound is None else bound[lo : lo + step]
        if d.shape[1] > k:
            limit = np.fmin(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero(d <= np.fmin(limit, np.finfo(float).max)[:, None])
        best = np.lexsort((j, d[i, j], i))
        i, j = i[best], j[best]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[nth < k], j[nth < k]
        sizes.append(np.bincount(i, minlength=len(d)))
        hits.append(j)
        near.append(d[i, j])
    ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    found = rows.select(["id", "y"]).take(pa.array(np.concatenate(hits))).combine_chunks()
    parts = [pa.array(np.concatenate(near)), *[pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in found.columns]]
    parts = pa.StructArray.from_arrays(parts, names=["d", "id", "y"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts, type=pa.list_(pa.field("element", parts.type, nullable=False)))


def knn_join(
    queries: DataFrame,
    train: DataFrame,
    features: Sequence[str],
    query_id: str,
    train_id: str,
    target: str,
    k: int = 5,
    p: float = 2,
    n_pivots: int = 64,
    ring_rows: int = 4096,
) -> DataFrame:
    """(query_id, neighbors): the exact k nearest rows of ``train`` for each row of ``queries``.

    ``neighbors`` is an array of (d, id, y), nearest first, ties by the smaller
    id.  A training row with the query's id is left out, so a table can be
    joined with itself.  Rows with a null id or a null or NaN feature take no
    part on either side; queries of one id share k neighbours; with an empty
    training table there are no rows.  A box holds about ``ring_rows`` rows;
    ``n_pivots`` of them, those of the least hashes, place the cuts.
    """
    features = _as_list(features)
    asked = queries.filter(complete(queries, features) & F.col(query_id).isNotNull())
    asked = asked.select(F.col(query_id).alias("q"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    rows = train.filter(complete(train, features) & F.col(train_id).isNotNull())
    rows = rows.select(F.col(train_id).alias("id"), F.col(target).alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    x = [f"x{i}" for i in range(len(features))]
    kind = T.StructType([T.StructField("d", T.DoubleType()), *[T.StructField(c, rows.schema[c].dataType) for c in ("id", "y")]])
    near = T.StructField("near", T.ArrayType(kind, False))
    box = T.StructField("box", T.IntegerType())
    n = rows.count()
    if not n:
        empty = rows.sparkSession.createDataFrame([], T.StructType([asked.schema["q"], near]))
        return empty.toDF(query_id, "neighbors")

    # boxes: cut by the points of the least hashes, a fixed choice whatever the layout
    size = max(ring_rows, 8 * (k + 1), -(-n // MAX_BOXES))
    share = n_pivots * -(-n // size) / n
    some = rows if share >= 1 else rows.filter(F.xxhash64(*x, "id") < int(share * 2.0**64) - 2**63)
    tree = cuts(_matrix(some.select(*x).toArrow(), x), n_pivots)
    cut = rows.sparkSession.sparkContext.broadcast(tree)

    def boxed(useful: bool, schema: T.StructType):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                some = _of_use(pa.Table.from_batches([batch]), x, k) if useful and batch.num_rows else pa.Table.from_batches([batch])
                yield from some.append_column("box", pa.array(_box(_matrix(some, x), cut.value), pa.int32())).select(schema.names).to_batches()

        return run

    with_box = T.StructType([*rows.schema.fields, box])
    held = written(rows.mapInArrow(boxed(True, with_box), with_box), "boxes")
    with_box = T.StructType([*asked.schema.fields, box])
    asked = written(asked.mapInArrow(boxed(False, with_box), with_box), "queries")

    # first each query's own box, which bounds its k-th distance
    plain = asked.columns

    def own(left: pa.Table, right: pa.Table) -> pa.Table:
        return left.select(plain).append_column("near", _nearest(left, right, x, p, k))

    first = _searched(asked, held, own, T.StructType([*asked.schema.fields, near]))
    if len(tree.dim) == 1:
        return _merged(first.select("q", "near"), k, query_id)
    first = written(first, "near")

    # then all others within it
    ends = [F.min(c) for c in x] + [F.max(c) for c in x]
    extents = _extents({r[0]: tuple(r[1:]) for r in held.groupBy("box").agg(*ends).collect()}, tree, len(x))  # at most 2 * MAX_BOXES
    shared = rows.sparkSession.sparkContext.broadcast((tree, *extents))
    bounded = first.select("q", *x, "box", F.get("near", F.lit(k - 1))["d"].alias("bound"))
    names, bounds = bounded.columns, T.StructField("bound", T.DoubleType())

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, low, high = shared.value
        step = max(1, CELLS // len(tree.dim))
        for batch in batches:
            points, home = _matrix(batch, x), batch.column("box").to_numpy()
            bound = batch.column("bound").to_numpy(zero_copy_only=False).astype(float)
            for lo in range(0, len(points), step):
                row, to = _reached(points[lo : lo + step], bound[lo : lo + step], tree, low, high, p)
                row, to = row[to != home[row + lo]] + lo, to[to != home[row + lo]]
                for at in range(0, len(row), 65_536):
                    part = batch.take(pa.array(row[at : at + 65_536]))
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names if c not in ("box", "bound")], pa.array(to[at : at + 65_536], pa.int32()), part.column("bound")], names=names)

    wanted = written(bounded.mapInArrow(others, T.StructType([*asked.schema.fields, bounds])), "wanted")

    def other(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _nearest(left, right, x, p, k, left.column("bound").to_numpy().astype(float))
        out = left.select(["q"]).append_column("near", found)
        return out.filter(pc.greater(pc.list_value_length(out.column("near")), 0))

    second = _searched(wanted, held, other, T.StructType([asked.schema["q"], near]))
    return _merged(first.select("q", "near").unionByName(second), k, query_id)


def _merged(found: DataFrame, k: int, name: str) -> DataFrame:
    """The k nearest of each query from those of its boxes; none, no row."""
    best = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k)
    return found.groupBy(F.col("q").alias(name)).agg(best.alias("neighbors")).filter(F.size("neighbors") > 0)


def _searched(wanted: DataFrame, held: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType, chunk: int = 20_000) -> DataFrame:
    """What ``run`` gives for the queries of each wanted box and the box's rows.

    A box that very many queries want is sent to several tasks, each with a
    part of them.
    """
    shares = F.broadcast(wanted.groupBy("box").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("shares")))  # a row a box
    asking = wanted.join(shares, "box").withColumn("share", F.pmod(F.xxhash64("q"), F.col("shares")).cast("int")).drop("shares")
    answering = held.join(shares, "box").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    return asking.groupBy("box", "share").cogroup(answering.groupBy("box", "share")).applyInArrow(run, schema)
