"""Exact top-k search by inner product: the k-th score of each query is located by distributed histograms.

Every query is scored against all vectors, in blocks of queries small enough
to be sent to all tasks.  A round counts each query's scores in bins of its
interval; the bin that holds the k-th value is the next interval, finer by the
number of bins, until it is one integer.  Then one pass keeps what lies above,
and of the ties the smallest ids.

A task reports a query's counts from the top down to the bin in which its own
count reaches what is sought: the k-th value of all cannot lie lower.  So a
task sends at most k rows a query, whatever it read, and no score is stored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import ensure_checkpoint_dir
from .common import materialize

BITS = 12  # of a score that one round settles
CELLS = 1 << 20  # scores held at a time
EXACT = 1 << 53  # integers that doubles hold exactly
LONG = np.iinfo(np.int64)
OUT = "query_id long, rank int, vec_id long, score long"


def finite(vector: Column) -> Column:
    """Whether a vector and all its components are there, and the components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def matrix(ids: pa.Array, vectors: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer components of the rows that take part; shorter vectors end in zeros."""
    offsets = np.asarray(vectors.offsets).astype(np.int64)
    values = scale * vectors.values[offsets[0] : offsets[-1]].to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = offsets - offsets[0]
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(values))])  # nulls are NaN here
    there = np.asarray(ids.is_valid()) & np.asarray(vectors.is_valid())
    keep = np.flatnonzero(there & (odd[offsets[1:]] == odd[offsets[:-1]]))
    lengths = np.diff(offsets)[keep]
    out = np.zeros((len(keep), dims))
    column = np.arange(dims)
    inside = column[None, :] < lengths[:, None]
    out[inside] = np.floor(values[(offsets[:-1][keep, None] + column[None, :])[inside]])
    return ids.take(pa.array(keep)).to_numpy(zero_copy_only=False).astype(np.int64), out


def inner(queries: np.ndarray, vectors: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; those beyond a long are held at its ends."""
    if exact:
        return (queries @ vectors.T).astype(np.int64)
    wide = np.vectorize(int, otypes=[object])
    products = wide(queries) @ wide(vectors).T if queries.shape[1] else np.zeros((len(queries), len(vectors)), object)
    return np.clip(products, LONG.min, LONG.max).astype(np.int64)


@dataclass
class Extent:
    """What all vectors have in common: longest length and norm, and whether doubles score them exactly."""

    dims: int
    norm: float
    exact: bool


def extent(rows: DataFrame, scale: float) -> Extent | None:
    """Bounds from one pass; None without any vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longest = max(np.diff(np.asarray(batch.column(1).offsets)), default=0)
            found = matrix(batch.column(0), batch.column(1), int(longest), scale)[1]
            if len(found):
                values = [[int(longest)], [float(np.abs(found).max(initial=0))], [float(np.linalg.norm(found, axis=1).max())]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["dims", "most", "norm"])

    found = rows.mapInArrow(run, "dims long, most double, norm double").agg(F.max("dims"), F.max("most"), F.max("norm")).first()
    if found[0] is None:
        return None
    return Extent(found[0], found[2], found[0] * found[1] * found[1] < EXACT)


@dataclass
class Block:
    """Queries of one block with their intervals: scores from ``low`` on, ``1 << width`` of them, in which ``need`` are sought."""

    ids: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    need: np.ndarray
    width: int


def scored(batches: Iterator[pa.RecordBatch], block: Block, floor: np.ndarray, common: Extent, scale: float) -> Iterator[tuple]:
    """(query numbers, ids, scores) of pairs at or above ``floor``, which the caller may raise on the way; own ids left out."""
    for batch in batches:
        ids, vectors = matrix(batch.column(0), batch.column(1), common.dims, scale)
        step = max(1, CELLS // max(1, len(ids)))
        for at in range(0, len(block.ids) if len(ids) else 0, step):
            scores = inner(block.vectors[at : at + step], vectors, common.exact)
            q, v = np.nonzero(scores >= floor[at : at + step, None])
            other = ids[v] != block.ids[at + q]
            q, v = q[other], v[other]
            yield at + q, ids[v], scores[q, v]


def from_top(query: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Running count within each query, for rows sorted by query."""
    total = np.cumsum(counts)
    first = np.flatnonzero(np.insert(query[1:] != query[:-1], 0, True)) if len(query) else np.zeros(0, np.int64)
    before = (total - counts)[first]
    return total - np.repeat(before, np.diff(np.append(first, len(query))))


def histogram(rows: DataFrame, shared, common: Extent, scale: float) -> DataFrame:
    """(q, need, bin, n): counts of all scores in bins of the queries' intervals, as far down as each task can tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        shift = np.uint64(max(0, block.width - BITS))
        floor = block.low.copy()
        query, bins, counts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for q, _, score in scored(batches, block, floor, common, scale):
            place = (score - block.low[q]).view(np.uint64)
            if block.width < 64:
                inside = place >> np.uint64(block.width) == 0
                q, place = q[inside], place[inside]
            if not len(q):
                continue
            query = np.concatenate([query, q])
            bins = np.concatenate([bins, (place >> shift).astype(np.int64)])
            counts = np.concatenate([counts, np.ones(len(q), np.int64)])
            order = np.lexsort((-bins, query))
            query, bins, counts = query[order], bins[order], counts[order]
            starts = np.flatnonzero(np.insert((query[1:] != query[:-1]) | (bins[1:] != bins[:-1]), 0, True))
            query, bins, counts = query[starts], bins[starts], np.add.reduceat(counts, starts)
            so_far = from_top(query, counts)
            keep = so_far - counts < block.need[query]
            full = so_far[keep] >= block.need[query[keep]]
            query, bins, counts = query[keep], bins[keep], counts[keep]
            done = query[full]
            floor[done] = block.low[done] + (bins[full].astype(np.uint64) << shift).view(np.int64)
        if len(query):
            columns = [query, block.need[query], bins, counts]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "need", "bin", "n"])

    parts = rows.mapInArrow(run, "q long, need long, bin long, n long")
    return parts.groupBy("q", "need", "bin").agg(F.sum("n").alias("n"))


def refine(rows: DataFrame, block: Block, common: Extent, scale: float) -> Block:
    """The block after one round; queries with fewer scores than sought take all."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(block)
    counts = histogram(rows, shared, common, scale)
    above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
    hit = counts.withColumn("above", above).filter("above >= need AND above - n < need").select("q", "bin", (F.col("above") - F.col("n")).alias("over"))
    found = hit.collect()  # one row a query of this block
    shared.destroy()
    shift = max(0, block.width - BITS)
    low, need = np.full(len(block.ids), LONG.min), block.need.copy()
    for q, place, over in found:
        low[q] = int(block.low[q]) + (place << shift)
        need[q] -= over
    return Block(block.ids, block.vectors, low, need, shift)


def answers(rows: DataFrame, block: Block, k: int, common: Extent, scale: float) -> DataFrame:
    """The k best of each query, once ``low`` is the k-th score and ``need`` the number of ties to take there."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        tied = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def out(q, ids, score):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (block.ids[q], ids, score)], names=["query_id", "vec_id", "score"])

        for q, ids, score in scored(batches, block, block.low, common, scale):
            over = score > block.low[q]
            if over.any():
                yield out(q[over], ids[over], score[over])
            if not over.all():
                tied = [np.concatenate([tied[0], q[~over]]), np.concatenate([tied[1], ids[~over]])]
                order = np.lexsort((tied[1], tied[0]))
                tied = [t[order] for t in tied]
                few = from_top(tied[0], np.ones(len(order), np.int64)) <= block.need[tied[0]]
                tied = [t[few] for t in tied]
        if len(tied[0]):
            yield out(tied[0], tied[1], block.low[tied[0]])

    found = rows.mapInArrow(run, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 1024.0,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of highest inner product for each row of ``queries``.

    Components are ``floor(scale * x)`` and scores exact integers, ties going
    to the smaller id; scores beyond a long are held at its ends.  A vector
    that is null, holds a null or a component not finite (also once scaled), or
    has a null id takes no part; of vectors unlike in length the shorter ends in zeros.  Rows
    with a query's id are no candidates of it; other rows with equal ids are
    candidates each, and an id that is asked several times is asked once, with
    its least vector.  Other columns are ignored; empty tables give no rows.
    Queries are sent to the tasks in blocks of at most ``block_bytes``.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & finite(F.col("v")))
    asked = materialize(asked.groupBy("id").agg(F.min("v").alias("v")), "queries")
    n, common = asked.count(), extent(rows, scale)
    if not n or common is None:
        return spark.createDataFrame([], OUT)
    longest = asked.agg(F.max(F.size("v"))).first()[0]
    most = max(1, block_bytes // (8 * max(1, common.dims, longest)))
    common = Extent(max(common.dims, longest), common.norm, common.exact)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ordo-topk-{uuid.uuid4().hex}"
    for ids, found in query_blocks(asked, n, most, common.dims, scale):
        with np.errstate(all="ignore"):
            reach = np.linalg.norm(found, axis=1) * common.norm * 1.000001 + 2
        reach[np.isnan(reach)] = np.inf
        bound = int(min(float(reach.max()), float(LONG.max)))
        low = np.maximum(np.floor(-reach), float(-bound)).astype(np.int64) if bound < EXACT else np.full(len(ids), LONG.min)
        block = Block(ids, found, low, np.full(len(ids), k, np.int64), (2 * bound + 2).bit_length() if bound < EXACT else 64)
        while block.width:
            block = refine(rows, block, common, scale)
        answers(rows, block, k, common, scale).write.mode("append").parquet(path)
    return spark.read.schema(OUT).parquet(path)


def query_blocks(asked: DataFrame, n: int, most: int, dims: int, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and integer vectors of the queries, at most ``most`` at a time, dealt by the hash of the id."""
    parts = 1 if n <= most else -(-2 * n // most)
    while True:
        bucket = F.pmod(F.xxhash64("id"), F.lit(parts))
        sizes = {r["b"]: r["n"] for r in asked.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        if max(sizes.values()) <= most:
            break
        parts *= 2
    for b in sorted(sizes):
        table = asked.filter(bucket == b).orderBy("id").toArrow().combine_chunks()
        yield matrix(table.column(0).combine_chunks(), table.column(1).combine_chunks(), dims, scale)


def nearest_embeddings(embeddings: DataFrame, every: int = 100, k: int = 10, **parameters) -> DataFrame:
    """``top_k`` of every vector whose id is divisible by ``every`` among all others."""
    return top_k(embeddings, embeddings.filter(F.col("vec_id") % every == 0), k, **parameters)
