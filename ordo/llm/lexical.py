"""Ranked lexical search with the Best Position Algorithm, exact.

The corpus is counted once: numbers of documents and terms, the terms that the
items name with the documents holding each.  Then shards of documents are
searched, each by itself: every term's impacts are a list in falling order, and
an item's lists are read side by side.  A document met in one list is looked up
in all others at once (direct access), which scores it whole and marks its
place in each list.  A list's best position is the last of its places seen
without a gap; an unseen document can score no more than the impacts at the
best positions together.  Reading stops when that is strictly below the k-th
score found, so that no tie is lost.

A task keeps an item's k best from shard to shard, which ends later shards
sooner; shards are bounded by the cells of their direct-access table.  Items
are sent to the tasks in blocks of bounded size.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import ensure_checkpoint_dir
from .common import materialize
from .decontaminate import blocks, bucket

TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
FIRST_DEPTH = 16
CELLS = 1 << 22  # documents times terms of a shard's direct-access table
LEAST_DOCS = 256
OUT = "item_id long, rank int, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and bytes of other characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


def distinct_items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(i, t, n): distinct items that have terms, with the number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(terms_of(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=["i", "t", "n"])

    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).distinct()
    return rows.mapInArrow(run, "i long, t string, n long").filter("n > 0")


def counted(docs: DataFrame, vocabulary, name: str) -> DataFrame:
    """(doc_id, n, terms, tf) of every document with a term: its length and the named terms with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            rows, lengths, sizes, terms, tfs = [], [], [0], [], []
            for row, text in enumerate(batch.column(1)):
                found = terms_of(text.as_py())
                if not found:
                    continue
                for term, tf in Counter(found).items():
                    if (t := number.get(term)) is not None:
                        terms.append(t)
                        tfs.append(tf)
                rows.append(row)
                lengths.append(len(found))
                sizes.append(len(terms))
            offsets = pa.array(sizes, pa.int32())
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64())]
            columns += [pa.ListArray.from_arrays(offsets, pa.array(v, kind)) for v, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tf"])

    return materialize(docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>"), name)


@dataclass
class Queries:
    """Items of a block as terms with repeats; weights of the terms; the corpus' counts."""

    ids: list[int | None]
    terms: list[np.ndarray]
    times: list[np.ndarray]
    weights: np.ndarray
    n_docs: int
    n_terms: int
    k: int


class Shard:
    """Impact lists of some documents, and their direct access by document."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, lengths: np.ndarray, ids: np.ndarray, queries: Queries):
        m = 75 + (25 * queries.n_docs * lengths) // queries.n_terms
        impact = queries.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        some = np.flatnonzero(impact > 0)
        doc, term, impact = doc[some], term[some], impact[some]
        order = np.lexsort((ids[doc], -impact, term))
        self.doc, self.impact, term = doc[order], impact[order], term[order]
        n = len(queries.weights)
        self.starts = np.searchsorted(term, np.arange(n + 1))
        self.scores = np.zeros((n, len(lengths)), np.int64)
        self.scores[term, self.doc] = self.impact
        self.places = np.full((n, len(lengths)), -1, np.int32)
        self.places[term, self.doc] = np.arange(len(order)) - self.starts[term]

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores that can be among the k best, given scores ``floor`` already found elsewhere."""
        starts = self.starts[terms]
        sizes = self.starts[terms + 1] - starts
        held = sizes > 0
        terms, times, starts, sizes = terms[held], times[held, None], starts[held], sizes[held]
        marks = [np.zeros(size + 1, bool) for size in sizes.tolist()]  # the last stays unseen
        best = np.zeros(len(terms), np.int64)
        seen = np.zeros(self.scores.shape[1], bool)
        docs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        top, depth, step = floor, 0, FIRST_DEPTH
        while (best < sizes).any():
            reads = [self.doc[s + depth : s + min(depth + step, z)] for s, z in zip(starts.tolist(), sizes.tolist(), strict=True)]
            fresh = np.zeros(len(seen), bool)
            fresh[np.concatenate(reads)] = True
            new = np.flatnonzero(fresh & ~seen)
            seen[new] = True
            docs.append(new)
            scores.append((self.scores[terms[:, None], new] * times).sum(axis=0))
            places = self.places[terms[:, None], new]
            for j, mark in enumerate(marks):
                at = places[j]
                mark[at[at >= 0]] = True
                best[j] += np.argmin(mark[best[j] :])  # places seen without a gap
            top = np.concatenate([top, scores[-1]])
            if len(top) > k:
                top = np.partition(top, len(top) - k)[len(top) - k :]
            # what an unseen document can reach; a list seen to its end adds nothing
            last = self.impact[starts + np.maximum(best - 1, 0)]
            if len(top) == k and (np.where(best < sizes, last, 0) * times[:, 0]).sum() < top.min():
                break
            depth, step = depth + step, 2 * step
        return np.concatenate(docs), np.concatenate(scores)


def best_in_shards(counted_docs: DataFrame, shared) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of every item (its number in the block)."""

    def pieces(batch: pa.RecordBatch, size: int) -> Iterator[tuple]:
        offsets = np.asarray(batch.column(2).offsets).astype(np.int64)
        term = batch.column(2).values.to_numpy()
        tf = batch.column(3).values.to_numpy()
        for a in range(0, len(batch), size):
            z = min(a + size, len(batch))
            part = slice(offsets[a], offsets[z])
            doc = np.repeat(np.arange(z - a), np.diff(offsets[a : z + 1]))
            ids = batch.column(0).slice(a, z - a)
            null = ~np.asarray(ids.is_valid())
            yield doc, term[part], tf[part], batch.column(1).slice(a, z - a).to_numpy(), ids.fill_null(np.iinfo(np.int64).max).to_numpy(), null

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        size = max(LEAST_DOCS, CELLS // max(1, len(queries.weights)))
        none = np.zeros(0, np.int64)
        kept = [(none, none, none) for _ in queries.ids]
        for batch in batches:
            for doc, term, tf, lengths, ids, null in pieces(batch, size):
                shard = Shard(doc, term, tf, lengths, ids, queries)
                for i, (terms, times) in enumerate(zip(queries.terms, queries.times, strict=True)):
                    docs, scores = shard.search(terms, times, queries.k, kept[i][0])
                    scores = np.concatenate([kept[i][0], scores])
                    names = np.concatenate([kept[i][1], ids[docs]])
                    nameless = np.concatenate([kept[i][2], null[docs]])
                    order = np.lexsort((names, nameless, -scores))[: queries.k]
                    kept[i] = (scores[order], names[order], nameless[order])
        counts = [len(s) for s, _, _ in kept]
        if sum(counts):
            score, name, nameless = (np.concatenate([x[c] for x in kept]) for c in range(3))
            columns = [pa.array(np.repeat(np.arange(len(kept)), counts)), pa.array(name, mask=nameless.astype(bool)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return counted_docs.select("doc_id", "n", "terms", "tf").mapInArrow(run, "item long, doc_id long, score long")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search_block(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) for one block of items, given as terms."""
    spark = docs.sparkSession
    number = {term: i for i, term in enumerate(sorted({t for _, terms in items for t in terms}))}
    vocabulary = spark.sparkContext.broadcast(number)
    corpus = counted(docs, vocabulary, "terms")
    n_docs, n_terms = corpus.agg(F.count(F.lit(1)), F.sum("n")).first()
    holds = dict(corpus.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect())  # the block's terms
    weights = np.array([weight(n_docs, holds.get(t, 0)) for t in range(len(number))], np.int64)
    split = [np.unique([number[t] for t in terms], return_counts=True) for _, terms in items]
    queries = Queries([i for i, _ in items], [t for t, _ in split], [n for _, n in split], weights, n_docs, n_terms or 1, k)
    found = best_in_shards(corpus, spark.sparkContext.broadcast(queries))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    found = found.withColumn("rank", place).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(items)], "item long, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = 16_384,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item.

    Equal scores go by ascending doc_id, null ids last.  Null and empty texts
    have no terms: such documents do not count, such items find nothing.  Rows
    with equal ids are documents each; of items equal in id and text one is
    ranked, items with equal ids and other texts each by itself.  Other columns
    are ignored; an empty table on either side gives no rows.  Texts of any
    length are counted whole.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    item_rows = distinct_items(items, item_col, item_text_col)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ordo-search-{uuid.uuid4().hex}"
    found = False
    for n_buckets, first, last, _ in blocks(item_rows, block_words):
        rows = item_rows.filter(bucket(n_buckets).between(first, last)).select("i", "t").orderBy("i", "t").collect()
        search_block(source, [(r["i"], terms_of(r["t"])) for r in rows], k).write.mode("append").parquet(path)
        found = True
    return spark.read.schema(OUT).parquet(path) if found else spark.createDataFrame([], OUT)
