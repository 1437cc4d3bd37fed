"""Repeated byte strings across a collection, ordered as by a suffix array.

A byte is removed if a string of ``length`` bytes that covers it also starts
somewhere else, in the same document or another.

1. *Anchors.*  Every window of ``length`` bytes has an anchor: the place of
   its least ``GRAM``-byte hash.  Windows that follow one another mostly share
   it, so a text has few anchors (about one per 50 bytes), and equal windows
   have equal anchors at the same place inside.  Anchors meet by the hash of
   their gram; an anchor that occurs once rules out all its windows, and one
   whose whole surroundings occur again settles them all.
2. *Column-wise construction.*  What is left are short segments around
   anchors whose surroundings differ (edges of repeats, edits), and of those
   only the ones that share a stretch almost as long as a window.  Segments of
   equal anchors go to one task, and a Burrows-Wheeler transform of each such
   collection is built column by column: every round inserts the next symbol,
   from the right, of every segment at once, at the place that the symbol
   counts of the transform so far give (C[c] + rank).  The order that comes
   out is that of the suffixes; neighbours whose common prefix reaches
   ``length`` are repeats.
3. Documents with repeats are read again, and the removed bytes cut out.

Whole documents are not inserted column by column: the rounds would be as many
as the longest document has bytes, each a pass over the whole collection.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .shingles import BYTE_CODES, mix, powers

GRAM = 100
SLICE = 1 << 20
STEP = 25  # a window holds its anchor and one of these stretches of the rest, in steps
LEAST_RANGE_BITS = 10
CHUNK = 250  # segments whose transform is built together
BROADCAST_KEYS = 500_000
RECORD = np.dtype([("gram", "<u8"), ("span", "<u8"), ("key", "<i8"), ("run", "<u4")])
RUN, SEVERAL, DECIDED = np.uint32((1 << 30) - 1), np.uint32(1 << 30), np.uint32(1 << 31)  # parts of a record's run
SINGLE, WHOLE, MODEL = 0, 1, 2  # a run to compare, one that occurs again as a whole, and one of the latter to compare with


class Runs:
    """The runs of windows with one anchor, of one text."""

    def __init__(self, text: np.ndarray, length: int):
        first, last, at, gram, span = [], [], [], [], []
        step = SLICE - length
        for lo in range(0, max(1, len(text) - length + 1), step):
            part = text[lo : lo + SLICE]
            if lo + SLICE < len(text):
                part = part[: step + length - 1]
            if len(part) >= length:
                s, e, p, g, h = self._slice(part, length)
                first.append(s + lo)
                last.append(e + lo)
                at.append(p + lo)
                gram.append(g)
                span.append(h)
        none = [np.zeros(0, np.int64)]
        self.first, self.last = np.concatenate(first or none), np.concatenate(last or none)
        self.at = np.concatenate(at or none)
        self.gram, self.span = np.concatenate(gram or none).astype(np.uint64), np.concatenate(span or none).astype(np.uint64)

    @staticmethod
    def _slice(part: np.ndarray, length: int):
        up, down = powers(len(part) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODES[part] * up[: len(part)])])
        n = len(part) - GRAM + 1
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[:n])
        # least hash, leftmost on ties, in every stretch of `width` places: block minima from both sides
        keyed = grams >> np.uint64(20) << np.uint64(20) | np.arange(n, dtype=np.uint64)
        width = length - GRAM + 1
        rows = -(-n // width)
        grid = np.full(rows * width, np.iinfo(np.uint64).max)
        grid[:n] = keyed
        ahead = np.minimum.accumulate(grid.reshape(rows, width), axis=1).ravel()
        behind = np.minimum.accumulate(grid.reshape(rows, width)[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - width + 1
        anchor = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & np.uint64(SLICE - 1)).astype(np.int64)
        first = np.flatnonzero(np.insert(anchor[1:] != anchor[:-1], 0, True))
        last = np.append(first[1:], windows) - 1
        at = anchor[first]
        whole = (sums[last + length] - sums[first]) * down[first]
        shape = ((last - first) * 4096 + (at - first)).astype(np.uint64)
        return first, last, at, grams[at], mix(mix(whole) + shape)


def text_bytes(value: str | None) -> np.ndarray:
    return np.frombuffer((value or "").encode("utf-8", "surrogatepass"), np.uint8)


def anchors(docs: DataFrame, length: int, range_bits: int, block: int = 1 << 18) -> DataFrame:
    """(range, records): the runs of all texts, packed, by range of their anchor's hash.

    Of runs with equal surroundings in a block only the first goes to its
    anchor's range, marked ``SEVERAL``.  The others occur again as a whole
    whatever else there is; they are marked ``DECIDED`` and spread evenly.  So
    a passage that very many texts share sends one record a block.
    """

    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        rows = rows[np.lexsort((rows["span"], rows["gram"]))]
        same = (rows["gram"][1:] == rows["gram"][:-1]) & (rows["span"][1:] == rows["span"][:-1])
        decided, first = np.insert(same, 0, False), np.append(same, False)
        first &= ~decided
        spread = mix(rows["key"].view(np.uint64) + rows["run"].astype(np.uint64))
        slot = (np.where(decided, spread, rows["gram"]) >> np.uint64(64 - range_bits)).astype(np.int32)
        rows["run"] |= np.where(decided, DECIDED, np.where(first, SEVERAL, np.uint32(0)))
        order = np.argsort(slot, kind="stable")
        rows, slot = rows[order], slot[order]
        starts = np.flatnonzero(np.insert(slot[1:] != slot[:-1], 0, True))
        ends = np.append(starts[1:], len(rows))
        blobs = [rows[a:z].tobytes() for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(slot[starts]), pa.array(blobs, pa.binary())], names=["range", "records"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                runs = Runs(text_bytes(value.as_py()), length)
                rows = np.empty(len(runs.first), RECORD)
                rows["gram"], rows["span"], rows["key"], rows["run"] = runs.gram, runs.span, key, np.arange(len(rows))
                held.append(rows)
                n += len(rows)
                if n >= block:
                    yield emit(held)
                    held, n = [], 0
        if n:
            yield emit(held)

    return docs.select("key", "text").mapInArrow(run, "range int, records binary")


def judged(packed: DataFrame, n_tasks: int) -> DataFrame:
    """(key, run, kind) of the runs whose anchor occurs again."""

    def marks(keys: np.ndarray, runs: np.ndarray, kinds: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(keys), 1 << 18):
            part = slice(lo, lo + (1 << 18))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[part]), pa.array(runs[part].astype(np.int32)), pa.array(kinds[part].astype(np.int32))], names=["key", "run", "kind"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.frombuffer(b, RECORD) for batch in batches for b in batch.column(1).to_pylist()]
        if not rows:
            return
        rows = np.concatenate(rows)
        done = rows["run"] & DECIDED > 0
        yield from marks(rows["key"][done], rows["run"][done] & RUN, np.full(int(done.sum()), WHOLE))
        rows = rows[~done]
        several, number = (rows["run"] & SEVERAL > 0).astype(np.int64), rows["run"] & RUN
        order = np.lexsort((number, rows["key"], rows["span"], rows["gram"]))
        rows, number, weight = rows[order], number[order], 1 + several[order]
        new_gram = np.insert(rows["gram"][1:] != rows["gram"][:-1], 0, True)[: len(rows)]
        new_span = new_gram | np.insert(rows["span"][1:] != rows["span"][:-1], 0, True)[: len(rows)]
        of_gram, of_span = np.cumsum(new_gram) - 1, np.cumsum(new_span) - 1
        in_gram, in_span = np.bincount(of_gram, weight), np.bincount(of_span, weight)
        spans_of = np.bincount(of_gram[new_span])  # different surroundings of each anchor
        kind = np.where(in_span[of_span] == 1, SINGLE, np.where(new_span & (spans_of[of_gram] > 1), MODEL, WHOLE))
        keep = in_gram[of_gram] > 1
        yield from marks(rows["key"][keep], number[keep], kind[keep])

    return packed.repartition(n_tasks, "range").mapInArrow(run, "key long, run int, kind int")


def segments(docs: DataFrame, length: int) -> DataFrame:
    """(gram, key, run, known, at, bytes): what has to be compared window by window; docs have ``runs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for key, value, marks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text_bytes(value.as_py())
                runs = Runs(text, length)
                for mark in marks:
                    if mark["kind"] != WHOLE:
                        i = mark["run"]
                        piece = text[runs.first[i] : runs.last[i] + length].tobytes()
                        for column, x in zip(out, (int(runs.gram[i].view(np.int64)), key, i, mark["kind"] == MODEL, int(runs.at[i] - runs.first[i]), piece), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary()), strict=True)],
                names=["gram", "key", "run", "known", "at", "bytes"],
            )

    return docs.select("key", "text", "runs").mapInArrow(run, "gram long, key long, run int, known boolean, at int, bytes binary")


def suffix_order(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(segment, start) of all non-empty suffixes of a collection in order, built column by column.

    The Burrows-Wheeler transform of the suffixes inserted so far holds, before
    each suffix, the symbol that was inserted there; it is kept as the places of
    each symbol, symbol after symbol.  A round inserts one symbol of every
    segment: how often it stands before the place of the segment's latest suffix
    gives the new suffix's place, and all places after it move up.  Symbols are
    1 to 256; equal suffixes follow the segments' order.
    """
    m = len(texts)
    sizes = np.array([len(t) for t in texts])
    pool = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes)
    names = np.arange(m, dtype=np.int32)  # of the suffixes in order, by when they came; first the empty ones
    owners, starts = [np.arange(m, dtype=np.int32)], [sizes.astype(np.int32)]
    place = np.arange(m)  # of each segment's latest suffix
    places = np.zeros(0, np.int64)  # of the symbols in the transform, by symbol
    counts = np.zeros(258, np.int64)  # suffixes by first symbol; 0: the empty ones
    counts[0] = made = m
    for column in range(1, int(sizes.max(initial=0)) + 1):
        live = np.flatnonzero(sizes >= column)
        new, at = pool[ends[live] - column], place[live]
        by = np.lexsort((at, new))  # new suffixes with one place keep the order of symbol and of what follows
        live, new, at = live[by], new[by], at[by]
        below = np.cumsum(counts) - counts  # C: suffixes that begin with a lesser symbol
        first = below - m  # of each symbol in ``places``
        rank = np.empty(len(live), np.int64)
        lo = 0
        for hi in [*(np.flatnonzero(np.diff(new)) + 1).tolist(), len(new)]:
            own = places[first[new[lo]] : first[new[lo]] + counts[new[lo]]]
            rank[lo:hi] = np.searchsorted(own, at[lo:hi])
            lo = hi
        spots = below[new] + rank + np.arange(len(live))
        room = np.ones(len(names) + len(live), bool)
        room[spots] = False
        kept = np.flatnonzero(room)
        places = kept[np.insert(places, first[new] + rank, at)]
        grown = np.empty(len(room), np.int32)
        grown[kept], grown[spots] = names, np.arange(made, made + len(live))
        names = grown
        owners.append(live.astype(np.int32))
        starts.append((sizes[live] - column).astype(np.int32))
        made += len(live)
        place = kept[place]
        place[live] = spots
        counts += np.bincount(new, minlength=258)
    return np.concatenate(owners)[names[m:]], np.concatenate(starts)[names[m:]]


def repeated_windows(texts: list[bytes], known: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(segment, starts of its windows that occur elsewhere); ``known`` segments occur elsewhere as a whole."""
    owner, start = suffix_order(texts)
    sizes = np.array([len(t) for t in texts])
    long = np.flatnonzero(sizes[owner] - start >= length)
    owner, start = owner[long], start[long]
    pool = np.frombuffer(b"".join(texts), np.uint8)
    at = (np.cumsum(sizes) - sizes)[owner] + start
    # common prefixes of neighbours, column by column
    same = np.arange(len(at) - 1)
    for column in range(length):
        same = same[pool[at[same] + column] == pool[at[same + 1] + column]]
        if not len(same):
            return
    again = np.zeros(len(at), bool)
    again[same] = again[same + 1] = True
    again &= ~known[owner]
    for segment in np.unique(owner[again]):
        yield int(segment), np.sort(start[again & (owner == segment)])


def promising(group: list[tuple], length: int) -> list[tuple]:
    """Of the segments of one anchor, those that may hold a window of another one.

    A window has ``length - GRAM`` bytes beside the anchor, so among stretches
    that reach ``STEP`` times a bytes to the left and the rest but one step to
    the right, one lies within it: that stretch must occur twice.
    """
    rest = length - GRAM - STEP
    counts: Counter = Counter()
    held = []
    for *_, at, piece in group:
        own = {
            (left, piece[at - left : at + GRAM + rest - left])
            for left in range(0, rest + 1, STEP)
            if at >= left and at + GRAM + rest - left <= len(piece)
        }
        counts.update(own)
        held.append(own)
    return [row for row, own in zip(group, held, strict=True) if any(counts[x] > 1 for x in own)]


def compared(pieces: DataFrame, length: int, n_tasks: int) -> DataFrame:
    """(key, run, windows): the windows of a run, counted from its first, that occur elsewhere."""

    def chunks(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
        """Promising rows of whole anchors, about ``CHUNK`` at a time."""
        chunk: list[tuple] = []
        for _, group in groupby(rows, key=itemgetter(0)):
            chunk += promising(list(group), length)
            if len(chunk) >= CHUNK:
                yield chunk
                chunk = []
        if chunk:
            yield chunk

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(rows_of(batches)):
            keys, runs, windows = [], [], []
            known = np.array([r[3] for r in chunk])
            for i, starts in repeated_windows([r[5] for r in chunk], known, length):
                keys.append(chunk[i][1])
                runs.append(chunk[i][2])
                windows.append(starts.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(runs, pa.int32()), pa.array(windows, pa.list_(pa.int32()))], names=["key", "run", "windows"]
            )

    dealt = pieces.repartition(n_tasks, "gram").sortWithinPartitions("gram", "key", "run")
    return dealt.mapInArrow(run, "key long, run int, windows array<int>")


def cut(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept of documents with ``runs`` and ``found``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, value, marks, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text = text_bytes(value.as_py())
                runs = Runs(text, length)
                edges = np.zeros(len(text) + 1, np.int32)
                for mark in marks or ():
                    if mark["kind"] != SINGLE:
                        edges[runs.first[mark["run"]]] += 1
                        edges[runs.last[mark["run"]] + length] -= 1
                for hit in found or ():
                    at = runs.first[hit["run"]] + np.array(hit["windows"], np.int64)
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + length, -1)
                gone = np.cumsum(edges[:-1]) > 0
                spans = int(np.sum(gone & ~np.insert(gone[:-1], 0, False))) if len(gone) else 0
                out.append((doc_id, len(text), int(gone.sum()), spans, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return docs.select("doc_id", "text", "runs", "found").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, task_bytes: int = 32 << 20) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null text is empty; texts under ``length`` bytes keep all.  Repeated rows
    are copies of each other.  Null ids stay; other columns are ignored; an
    empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.withColumn("key", F.xxhash64("doc_id", "text"))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_bytes = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_tasks = max(least, n_bytes // 50 * RECORD.itemsize // task_bytes + 1)
    range_bits = max(LEAST_RANGE_BITS, (4 * n_tasks).bit_length())
    marks = materialize(judged(anchors(source, length, range_bits), n_tasks), "runs")
    by_doc = materialize(
        marks.distinct().groupBy("key").agg(F.collect_list(F.struct("run", "kind")).alias("runs")), "marked"
    )
    keys = by_doc.select("key")
    few = by_doc.count() <= BROADCAST_KEYS
    marked = source.join(F.broadcast(keys) if few else keys, "key", "left_semi")
    plain = source.join(F.broadcast(keys) if few else keys, "key", "left_anti")

    # one copy of each text is enough to compare
    open_ = marked.join(by_doc.filter(F.exists("runs", lambda r: r["kind"] != WHOLE)).select("key", "runs"), "key")
    pieces = segments(open_.dropDuplicates(["key"]), length)
    found = compared(pieces, length, n_tasks)
    found = found.groupBy("key").agg(F.collect_list(F.struct("run", "windows")).alias("found"))
    rest = plain.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )
    both = marked.join(by_doc.select("key", "runs"), "key").join(materialize(found, "windows"), "key", "left")
    return cut(both, length).unionByName(rest)
