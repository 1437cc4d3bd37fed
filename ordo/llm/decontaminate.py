"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Benchmark items are cut into word n-grams, and every one of them is a seed,
however common: a leak makes its own n-grams common.  One pass looks the seeds
up in every document: each hit joins a passage with an item; items that have
too few words in common with the document to reach the limit go; hits of an
item close to one another share a window, and the item is aligned with that
window word by word (local alignment, linear gaps).  A passage whose score
reaches the limit is a leak, whole, edited or partial.  The verdict on a
document depends on it and the item alone, not on the other documents.

The benchmark goes to the tasks in blocks of at most ``block_words`` words (or
of one longer item), so what is broadcast has a fixed bound and a larger
benchmark takes more passes.  Equal items travel once, with their number.
Documents never leave their task, so neither an item that a third of them
quotes nor a very long text gathers anywhere.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .shingles import blocks_of, mix, word_hashes

NOT_WORD = re.compile(r"[\W_]+")
MATCH, MISMATCH, GAP = 2, -1, -1


def normal(text: str | None) -> str:
    """Lower case, words of letters and digits parted by single spaces."""
    return NOT_WORD.sub(" ", (text or "").lower()).strip()


def grams(words: np.ndarray, width: int) -> np.ndarray:
    out = np.full(max(0, len(words) - width + 1), width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(out)]
    return mix(out)


class Items:
    """A block of benchmark items: word hashes, and where each n-gram stands in which item."""

    def __init__(self, rows: list[tuple[int, str, int]], width: int):
        self.ids, self.words, self.copies = [], [], []
        self.widths: set[int] = set()
        found: list[np.ndarray] = []
        for item_id, text, copies in rows:
            words, _ = word_hashes(np.frombuffer(normal(text).encode("utf-8", "surrogatepass"), np.uint8))
            if len(words):
                n = min(width, len(words))
                self.widths.add(n)
                self.ids.append(item_id)
                self.copies.append(copies)
                self.words.append(words)
                found.append(grams(words, n))
        none = np.zeros(0, np.uint64)
        of_gram = np.concatenate([none, *found])
        order = np.argsort(of_gram, kind="stable")
        self.seeds, starts = np.unique(of_gram[order], return_index=True)
        self.starts = np.append(starts, len(order))
        self.item = np.repeat(np.arange(len(found)), [len(f) for f in found])[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(f)) for f in found)])[order]
        bags = [np.unique(w, return_counts=True) for w in self.words]
        self.bag_words = np.concatenate([none, *(b[0] for b in bags)])
        self.bag_counts = np.concatenate([np.zeros(0, np.int64), *(b[1] for b in bags)])
        self.bag_starts = np.cumsum([0, *(len(b[0]) for b in bags)])
        self.lengths = np.array([len(w) for w in self.words], np.int64)

    def postings(self, places: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in text, place in item) of every hit, sorted."""
        at = np.searchsorted(self.seeds, found)
        n = self.starts[at + 1] - self.starts[at]
        entry = spread(self.starts[at], n)
        places, item, of = np.repeat(places, n), self.item[entry], self.place[entry]
        order = np.lexsort((of, places, item))
        return item[order], places[order], of[order]

    def in_common(self, some: np.ndarray, text: np.ndarray) -> np.ndarray:
        """How many words (repeats counted) each of some items has in common with a text."""
        words, counts = np.unique(text, return_counts=True)
        n = self.bag_starts[some + 1] - self.bag_starts[some]
        entry = spread(self.bag_starts[some], n)
        near = np.minimum(np.searchsorted(words, self.bag_words[entry]), len(words) - 1)
        both = np.where(words[near] == self.bag_words[entry], np.minimum(counts[near], self.bag_counts[entry]), 0)
        return np.add.reduceat(both, np.cumsum(n) - n)


def spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranges of ``n`` numbers from each start, one after the other."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def hits_in(texts: pa.Array, wanted: np.ndarray, widths: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, word hashes, hit places, hit n-grams) of every text with a wanted n-gram."""
    plain = pa.array([normal(v.as_py()) for v in texts], pa.string())
    for rows, block, starts in blocks_of(plain):
        words, places = word_hashes(block)
        bounds = np.searchsorted(places, starts)
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for width in widths:
            rolled = grams(words, width)
            near = np.minimum(np.searchsorted(wanted, rolled), len(wanted) - 1)
            at = np.flatnonzero(wanted[near] == rolled)
            doc = np.searchsorted(bounds, at, side="right") - 1
            inside = at + width <= bounds[doc + 1]
            at, doc = at[inside], doc[inside]
            for d in np.unique(doc):
                own = at[doc == d] if len(at) < 64 else at[np.searchsorted(doc, d) : np.searchsorted(doc, d, side="right")]
                found[int(d)].append((own - bounds[d], rolled[own]))
        for d, parts in found.items():
            yield rows[d], words[bounds[d] : bounds[d + 1]], np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def align(item: np.ndarray, text: np.ndarray) -> int:
    """Best local alignment score of two word sequences, row by row in numpy."""
    slope = np.arange(len(text) + 1) * -GAP
    row = np.zeros(len(text) + 1, np.int64)
    best = 0
    for word in item:
        step = np.where(text == word, MATCH, MISMATCH)
        new = np.zeros(len(text) + 1, np.int64)
        new[1:] = np.maximum(np.maximum(row[:-1] + step, row[1:] + GAP), 0)
        row = np.maximum.accumulate(new + slope) - slope  # gaps along the text
        best = max(best, int(row.max()))
    return best


def passages(places: list[tuple[int, int]], length: int, n_words: int) -> list[tuple[int, int]]:
    """Windows of the text around hits (place in text, place in item) that lie close together."""
    out: list[tuple[int, int]] = []
    for at, of in sorted(places):
        reach = length // 4 + 2
        a, z = max(0, at - of - reach), min(n_words, at - of + length + reach)
        if out and a <= out[-1][1]:
            out[-1] = (min(a, out[-1][0]), max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def leaks(words: np.ndarray, places: np.ndarray, found: np.ndarray, items: Items, limit: float) -> list[tuple[int, float, int, int]]:
    """(item, score, first word, end word) of the items that a text leaks."""
    item_of, at, of = items.postings(places, found)
    some, starts = np.unique(item_of, return_index=True)
    ends = np.append(starts[1:], len(item_of))
    # no alignment matches more words than both have in common
    likely = np.flatnonzero(items.in_common(some, words) / items.lengths[some] >= limit)
    out = []
    for i, start, end in zip(some[likely].tolist(), starts[likely].tolist(), ends[likely].tolist(), strict=True):
        item = items.words[i]
        best = (0.0, 0, 0)
        for a, z in passages(list(zip(at[start:end].tolist(), of[start:end].tolist(), strict=True)), len(item), len(words)):
            text = words[a:z]
            if items.in_common(np.array([i]), text)[0] / len(item) >= limit:
                best = max(best, (align(item, text) / (MATCH * len(item)), a, z))
        if best[0] >= limit:
            out += [(items.ids[i], *best)] * items.copies[i]
    return sorted(out)


def annotate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 3,
    limit: float = 0.4,
    block_words: int = 1_000_000,
) -> DataFrame:
    """All columns of ``docs`` plus ``leaks``: array of (item_id, score, first_word, end_word).

    ``score`` is the local alignment score over that of the whole item (1: a
    full exact copy).  Items of fewer than ``width`` words match as a whole.
    Null or empty texts and items have no words and no leaks; repeated items
    are reported each; repeated rows and null ids stay as they are; an empty
    benchmark leaks nothing and an empty table gives no rows.
    """
    item_rows = distinct_items(benchmark, item_col, item_text_col)
    leak = "array<struct<item_id:bigint,score:double,first_word:int,end_word:int>>"
    names, at = docs.columns, docs.columns.index(text_col)
    spark = docs.sparkSession
    out = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("leaks", F.array().cast(leak))

    for n_buckets, first, last, n_words in blocks(item_rows, block_words):
        rows = item_rows.filter(bucket(n_buckets).between(first, last)).select("i", "t", "copies", "n").collect()
        assert sum(r["n"] for r in rows) == n_words, "the benchmark changed while it was read"
        items = Items([(r["i"], r["t"], r["copies"]) for r in rows], width)
        if len(items.seeds):
            out = _with_leaks(out, at, spark.sparkContext.broadcast(items), limit)
    return out.toDF(*names, "leaks")


def distinct_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(i, t, copies, n): distinct items that have words, how often each occurs, and its number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(normal(t.as_py()).split()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=["i", "t", "copies", "n"])

    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).groupBy("i", "t").agg(F.count("*").alias("copies"))
    return rows.mapInArrow(run, "i long, t string, copies long, n long").filter("n > 0")


def bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("i", "t"), F.lit(n))


def blocks(item_rows: DataFrame, block_words: int) -> list[tuple[int, int, int, int]]:
    """(number of buckets, first and last bucket, words) of every block of items.

    Items are dealt to buckets by hash, so many that none has more words than
    a block or than one item; a block is a run of buckets.
    """
    total, longest = item_rows.agg(F.sum("n"), F.max("n")).first()
    if not total:
        return []
    most = max(block_words, longest)
    n = 1 if total <= most else 8 * -(-total // most)
    while True:
        found = sorted((r["b"], r["n"]) for r in item_rows.groupBy(bucket(n).alias("b")).agg(F.sum("n").alias("n")).collect())
        if all(words <= most for _, words in found):
            break
        n *= 2
    out: list[tuple[int, int, int, int]] = []
    for b, words in found:
        if out and out[-1][3] + words <= most:
            out[-1] = (n, out[-1][1], b, out[-1][3] + words)
        else:
            out.append((n, b, b, words))
    return out


def _with_leaks(docs: DataFrame, at: int, shared, limit: float) -> DataFrame:
    """Adds the leaks of one block of items to the last column."""
    schema = StructType([StructField(f.name, f.dataType) for f in docs.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            found = batch.column(batch.num_columns - 1).to_pylist()
            for row, words, places, hits in hits_in(batch.column(at), items.seeds, items.widths):
                found[row] = (found[row] or []) + [
                    {"item_id": i, "score": s, "first_word": a, "end_word": z} for i, s, a, z in leaks(words, places, hits, items, limit)
                ]
            last = pa.array(found, batch.schema.field(batch.num_columns - 1).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], last], names=schema.names)

    return docs.mapInArrow(run, schema)


def leaked_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """One row per leak: doc_id, item_id, score, first_word, end_word."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = annotate(source, benchmark, "doc_id", "text", **parameters).filter(F.size("leaks") > 0)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
