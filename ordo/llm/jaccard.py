"""Exact Jaccard join of word-shingle sets with PartEnum signatures.

Equal sets form one class, and the join runs on classes.  A pair at or above
the similarity has sizes a <= b <= a / s, so it lies in one size band or in
the window around the border of two; every band and window ("instance") has
its own partition of the feature domain (ranges of the hash).  Two sets of a
pair differ in at most ``k = (a + b)(1 - s) / (1 + s)`` features, so of any
more than k non-empty parts at least one is equal in both: a signature is the
content of one part.  A set of size a emits only the first ``m(a)`` parts,
which suffices because m grows with size and k is bounded by the smaller set.
Small sets use parts of one feature each; for larger ones the number of parts
makes a set with too few non-empty parts rare: the chance is 5e-7 for a set of
256 features, 5e-8 for 264, 6e-10 for 512.  A job that meets one deals the
features anew, by another hash and to more parts, so no link is lost.

Signatures travel packed, 13 bytes each, to ranges of the signature space,
where those with two or more classes are found and counted.  A class can spare
as many of its N signatures as it has beyond k + 1, and spares the most common
ones; the others, as far as any other class has them, are its probes.  Classes
without a probe have no partner.  So neither common shingles nor passages that
many documents quote make candidates.

Each probe is compared with the most central class of its signature (a star,
linear in the group); components of those links are found.  Classes that still
may have partners in other components, and those that may be these, are then
looked at by the features that several components have: of these a pair can
differ in few, so parts of them make signatures once more, with few and large
parts where little can differ.  A class meets the components that have one of
its signatures, one row for every class and component, whose members come in
blocks, so that no pair is written out before it is likely.

A class has a profile, its features counted by 256 buckets.  The profiles of two
sets differ by no more than the sets do, so pairs whose profiles differ too much
are no links; the others are verified by exact set intersection.  Nothing is
capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .components import connected
from .shingles import mix, shingle_sets

SINGLE = 256  # sets below this size use one feature per part
LEAST = 4  # smaller sets link with equal ones only
SINGLES = (2 * SINGLE.bit_length() - 4, 2 * SINGLE.bit_length() - 1)  # their instances: the band and the window above
LEAST_RANGE_BITS = 10
LOW_BYTES = 5  # of a signature that travel beside its range; a clash only adds a candidate
BROADCAST_CLASSES = 500_000
SALTS = 16  # copies of a table too large to broadcast that hot keys are spread over
BUCKETS = 256  # of a profile
MEMBERS = 4096  # of a component that one task compares at a time
ATTEMPTS = 8  # ways to deal the features to parts
INSTANCE = np.uint64(63)  # low bits of a signature: its instance


def instances(size: int, percent: int) -> list[tuple[int, int, bool]]:
    """(number, largest size, one feature a part) of the band and the windows that a size falls in."""
    out = []
    band = max(int(math.log2(size)), int(math.log2(SINGLE)) - 1)
    top = (2 << band) - 1
    out.append((2 * band, top, top < SINGLE))
    for border in (1 << band, 2 << band):  # windows around the band's two borders
        if border >= SINGLE and border * percent <= 100 * size and size * percent < 100 * border:
            out.append((2 * int(math.log2(border)) + 1, border * 100 // percent, border == SINGLE))
    return out


def most_diffs(size: int, top: int, percent: int) -> int:
    """Features in which a set of this size and a larger partner can differ."""
    partner = min(size * 100 // percent, top)
    return (size + partner) * (100 - percent) // (100 + percent)


def parts_of(hashes: np.ndarray, top: int, single: bool, percent: int, attempt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and contents of the non-empty parts that a set emits in one instance."""
    if single:
        return np.zeros(len(hashes), np.uint64), hashes
    slack = (1.5 + 24 / math.sqrt(top)) * (1 + attempt)
    share = (100 - percent) / percent  # k is at most this times the smaller size
    n = math.ceil(slack * (share * top + 1))
    m = min(n, math.ceil(slack * (share * len(hashes) + 1)))
    step = (1 << 64) // n
    bounds = np.searchsorted(hashes, (np.arange(m, dtype=np.uint64) * np.uint64(step)))
    end = len(hashes) if m == n else int(np.searchsorted(hashes, np.uint64(m * step)))
    sizes = np.diff(np.append(bounds, end))
    full = np.flatnonzero(sizes)
    if not len(full):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return full.astype(np.uint64), np.add.reduceat(mix(hashes[:end]), bounds[full])


def signatures(hashes: np.ndarray, percent: int, attempt: int = 0) -> list[tuple[int, int, np.ndarray]]:
    """(instance, bound k, signatures) of a set.

    A set with no more than k signatures is not covered; ``attempt`` deals the
    features in another way, the same for all sets of a job.
    """
    if attempt:
        hashes = np.sort(mix(hashes ^ mix(np.array([attempt], np.uint64))))
    out = []
    for number, top, single in instances(len(hashes), percent):
        # parts of one feature: a partner of at least this size holds all but k of the features
        k = len(hashes) * (100 - percent) // (100 + percent) if single else most_diffs(len(hashes), top, percent)
        parts, contents = parts_of(hashes, top, single, percent, attempt)
        spread = mix(mix(contents + parts * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(number))
        out.append((number, k, spread & ~INSTANCE | np.uint64(number)))
    return out


def class_id(hashes: np.ndarray) -> int:
    """63-bit id of a set."""
    total = np.add.reduce(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))
    return int(mix(np.array([total + np.uint64(len(hashes))]))[0] >> np.uint64(1))


def profile(hashes: np.ndarray) -> bytes:
    """Features by the first byte of their hash, at most 255 of each."""
    return np.minimum(np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def profiles(column: pa.Array) -> np.ndarray:
    """The rows' profiles as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16)


def near(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether profiles differ by no more than sets of these sizes together may."""
    return np.abs(a - b).sum(axis=-1, dtype=np.int64) * (100 + percent) <= sizes * (100 - percent)


def classes(docs: DataFrame, width: int, percent: int, attempt: int = 0) -> DataFrame:
    """doc_id, key, n_shingles, cid (null for an empty set), and how many parts the class can spare.

    ``spare_band`` and ``spare_window``: non-empty parts beyond k + 1 in the
    band and in the window around a border; negative if there are too few.
    ``profile`` is null for sets that link with equal ones only.
    """
    names = ["doc_id", "key", "n_shingles", "cid", "spare_band", "spare_window", "profile"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spare = np.zeros(len(batch), np.int64), np.zeros((2, len(batch)), np.int32)
            ids: list[int | None] = [None] * len(batch)
            counts: list[bytes | None] = [None] * len(batch)
            for row, hashes in shingle_sets(batch.column(1), width):
                sizes[row] = len(hashes)
                ids[row] = class_id(hashes) if len(hashes) else None
                counts[row] = profile(hashes) if len(hashes) >= LEAST else None
                for number, k, sigs in signatures(hashes, percent, attempt) if len(hashes) >= LEAST else ():
                    spare[number % 2, row] = len(sigs) - k - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes), pa.array(ids, pa.int64()), pa.array(spare[0]), pa.array(spare[1]), pa.array(counts, pa.binary())],
                names=names,
            )

    return docs.mapInArrow(run, "doc_id long, key long, n_shingles long, cid long, spare_band int, spare_window int, profile binary")


def packed_signatures(docs: DataFrame, width: int, percent: int, range_bits: int, block: int = 1 << 18, attempt: int = 0) -> DataFrame:
    """(range, pairs): signatures and classes packed as bytes, by range of the signature."""

    def emit(sigs: list[np.ndarray], cids: list[np.ndarray]) -> pa.RecordBatch:
        sig, cid = np.concatenate(sigs), np.concatenate(cids)
        order = np.argsort(sig, kind="stable")
        sig, cid = sig[order], cid[order]
        # copies of a set meet here first
        fresh = np.insert((sig[1:] != sig[:-1]) | (cid[1:] != cid[:-1]), 0, True)
        sig, cid = sig[fresh], cid[fresh].astype("<i8")
        slot = (sig >> np.uint64(64 - range_bits)).astype(np.int32)
        low = sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :LOW_BYTES]
        starts = np.flatnonzero(np.insert(slot[1:] != slot[:-1], 0, True))
        ends = np.append(starts[1:], len(sig))
        blobs = [low[a:z].tobytes() + cid[a:z].tobytes() for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(slot[starts]), pa.array(blobs, pa.binary())], names=["range", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, cids, n = [], [], 0
        for batch in batches:
            for _, hashes in shingle_sets(batch.column(0), width):
                if len(hashes) < LEAST:
                    continue
                cid = class_id(hashes)
                for _, _, found in signatures(hashes, percent, attempt):
                    sigs.append(found)
                    cids.append(np.full(len(found), cid))
                    n += len(found)
                if n >= block:
                    yield emit(sigs, cids)
                    sigs, cids, n = [], [], 0
        if sigs:
            yield emit(sigs, cids)

    return docs.select("text").mapInArrow(run, "range int, pairs binary")


def shared_signatures(packed: DataFrame, n_tasks: int) -> DataFrame:
    """(sig, cid, n) of every signature that n > 1 classes have; a task takes one range at a time."""

    def shared(slot: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        sigs, cids = [], []
        for blob in blobs:
            n = len(blob) // (LOW_BYTES + 8)
            low = np.zeros((n, 8), np.uint8)
            low[:, :LOW_BYTES] = np.frombuffer(blob, np.uint8, LOW_BYTES * n).reshape(n, LOW_BYTES)
            sigs.append(low.view("<u8").ravel() | np.uint64(slot) << np.uint64(8 * LOW_BYTES))
            cids.append(np.frombuffer(blob, "<i8", n, LOW_BYTES * n))
        sig, cid = np.concatenate(sigs), np.concatenate(cids)
        order = np.argsort(sig, kind="stable")
        ordered = sig[order]
        same = ordered[1:] == ordered[:-1]
        keep = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
        if not len(keep):
            return
        sig, cid = ordered[keep], cid[order[keep]]
        order = np.lexsort((cid, sig))
        sig, cid = sig[order], cid[order]
        fresh = np.insert((sig[1:] != sig[:-1]) | (cid[1:] != cid[:-1]), 0, True)
        sig, cid = sig[fresh], cid[fresh]
        first = np.flatnonzero(np.insert(sig[1:] != sig[:-1], 0, True))
        counts = np.diff(np.append(first, len(sig)))
        n = np.repeat(counts, counts)
        for lo in range(0, len(sig), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[part][n[part] > 1]) for x in (sig.view(np.int64), cid, n)], names=["sig", "cid", "n"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for slot, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if slot != at and held:
                    yield from shared(at, held)
                    held = []
                at = slot
                held.append(blob.as_py())
        if held:
            yield from shared(at, held)

    return packed.repartition(n_tasks, "range").sortWithinPartitions("range").mapInArrow(run, "sig long, cid long, n long")


def looked_up(rows: DataFrame, small: DataFrame, on: str, how: str = "left") -> DataFrame:
    """``rows`` joined with ``small``: sent to all tasks if it is known to be small, else joined with hot keys spread."""
    if small.count() <= BROADCAST_CLASSES:
        return rows.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    return spread.join(salted, [on, "_salt"], how).drop("_salt")


def sets_of(docs: DataFrame, members: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cid, hashes) of the wanted classes, from the text of one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, n = [], [], 0
            for _, hashes in shingle_sets(batch.column(0), width):
                ids.append(class_id(hashes))
                sets.append(hashes.view(np.int64))
                n += len(hashes)
                if n >= 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["cid", "hashes"])
                    ids, sets, n = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["cid", "hashes"])

    one = members.groupBy("cid").agg(F.min("key").alias("key")).join(wanted, "cid", "left_semi").select("key")
    texts = looked_up(docs, materialize(one, "wanted"), "key", "left_semi").select("text")
    # documents equal in id and text have one key
    return texts.mapInArrow(run, "cid long, hashes array<long>").dropDuplicates(["cid"])


def verified(docs: DataFrame, members: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by exact intersection."""
    wanted = pairs.select("a").union(pairs.select("b")).distinct().toDF("cid")
    sets = materialize(sets_of(docs, members, wanted, width), "sets")
    both = F.size(F.array_intersect("x", "y"))
    met = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return met.filter(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def likely(pairs: DataFrame, kinds: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose profiles are near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                sizes = batch.column(4).to_numpy() + batch.column(5).to_numpy()
                keep = near(profiles(batch.column(2)), profiles(batch.column(3)), sizes, percent)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

    sides = [kinds.select(F.col("cid").alias(c), F.col("profile").alias(f"p{c}"), F.col("size").alias(f"s{c}")) for c in "ab"]
    met = pairs.join(sides[0], "a").join(sides[1], "b")
    return met.select("a", "b", "pa", "pb", "sa", "sb").mapInArrow(run, "a long, b long")


def likely_members(visits: DataFrame, labels: DataFrame, kinds: DataFrame, percent: int) -> DataFrame:
    """(a, b): classes that visit a component, and its members near enough by profile.

    ``visits`` (cid, other), ``labels`` (cid, label) of the components with
    several classes.  Members are dealt to blocks by hash, and every block of a
    component meets its visitors, these in blocks as well.
    """
    about = kinds.select("cid", "size", "profile")
    parts = labels.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    guests = visits.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("shares"))
    grid = guests.join(parts.withColumnRenamed("label", "other"), "other", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    alone = grid.select(F.col("other").alias("cid"), F.col("other")).join(labels, "cid", "left_anti")
    hosts = labels.select("cid", F.col("label").alias("other")).unionByName(alone).join(grid, "other").join(about, "cid")
    hosts = hosts.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    hosts = hosts.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("other", "part", "share", "cid", "size", "profile")
    hosts = hosts.toDF("host", "host_part", "host_share", "id", "n", "counts")
    asking = visits.join(grid, "other").join(about, "cid")
    asking = asking.withColumn("share", F.pmod(F.xxhash64("cid"), F.col("shares")).cast("int"))
    asking = asking.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("other", "part", "share", "cid", "size", "profile")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if len(left) and len(right):
            ids, sizes, counts = right.column("id").to_numpy(), right.column("n").to_numpy(), profiles(right.column("counts"))
            for cid, size, count in zip(left.column("cid").to_numpy(), left.column("size").to_numpy(), profiles(left.column("profile")), strict=True):
                hit = ids[near(counts, count, sizes + size, percent)]
                a.append(np.minimum(hit, cid))
                b.append(np.maximum(hit, cid))
        none = [np.zeros(0, np.int64)]
        return pa.table({"a": np.concatenate(a or none), "b": np.concatenate(b or none)})

    both = asking.groupBy("other", "part", "share").cogroup(hosts.groupBy("host", "host_part", "host_share"))
    return both.applyInArrow(run, "a long, b long").filter("a != b").distinct()


def ranked(shared: DataFrame, kinds: DataFrame, percent: int) -> DataFrame:
    """``shared`` with what is known of its class: size, number of shared signatures, and whether it is a probe.

    The most common signatures are spared; those that no other class has are
    not among the rows and count as kept.  With parts of one feature a partner
    shares at least ``percent`` of a class's features, so classes that share
    fewer with all others together have none.
    """
    number = F.col("sig").bitwiseAND(int(INSTANCE))
    one = Window.partitionBy("cid", number)
    spared = F.when(number % 2 == 0, F.col("spare_band")).otherwise(F.col("spare_window"))
    rows = shared.join(kinds, "cid").withColumns(
        {
            "held": F.count(F.lit(1)).over(one),
            "common": F.sum("n").over(one) / F.col("size"),
            "spared": spared,
            "probe": F.row_number().over(one.orderBy(F.desc("n"), "sig")) > spared,
            "single": number.isin(*SINGLES),
        }
    )
    return rows.filter(f"NOT single OR 100 * held >= {percent} * size").select("sig", "cid", "size", "held", "common", "spared", "probe", "single")


def meeting(placed: DataFrame) -> DataFrame:
    """(cid, comp, size) of the classes that may have a partner in another component, and of the classes that may be it.

    Only signatures that several components have count for a class now.  One
    row of each signature and class; no pair is made.
    """
    mixed = placed.groupBy("sig").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).filter("first != last").select("sig")
    rows = materialize(placed.join(mixed, "sig", "left_semi"), "mixed")
    one = Window.partitionBy("cid", F.col("sig").bitwiseAND(int(INSTANCE)))
    asking = rows.withColumn("held", F.count(F.lit(1)).over(one)).filter("probe AND held > spared").select("sig").distinct()
    return rows.join(asking, "sig", "left_semi").select("cid", "comp", "size").distinct()


def limits(most: int, percent: int) -> list[int]:
    """Bounds of the levels of slack, up to the one that ``most`` falls in."""
    out = [100 + percent]
    while out[-1] < most:
        out.append(out[-1] * 7 // 5)
    return out


def held_signatures(hashes: np.ndarray, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures that a class is found by, and those that it looks for others by.

    ``hashes`` are the held features of a set of ``size`` features, sorted.
    """
    unit = 100 + percent
    slack = unit * len(hashes) - 2 * percent * size
    most = (100 - percent) * min(100 * size, unit * len(hashes) - percent * size) // percent  # slack of any partner
    mixed = mix(hashes)
    hosts, guests, below = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], -1
    for level, limit in enumerate(limits(most, percent)):
        is_host, below = below < slack <= limit, limit
        if slack > limit or slack + limit < 0:
            continue
        n = math.ceil(1.3 * (2 * limit // unit + 1)) + 2
        starts = np.searchsorted(hashes, np.arange(n, dtype=np.uint64) * np.uint64((1 << 64) // n))
        counts = np.diff(np.append(starts, len(hashes)))
        contents, full = np.zeros(n, np.uint64), np.flatnonzero(counts)
        contents[full] = np.add.reduceat(mixed, starts[full])
        sigs = mix(mix(contents + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(level))
        if is_host:
            hosts.append(sigs)
        wanted = (slack + min(limit, most)) // unit + 1
        guests.append(sigs[full[:wanted]] if len(full) >= wanted else sigs)
    return np.concatenate(hosts), np.concatenate(guests)


def visiting(sets: DataFrame, percent: int) -> DataFrame:
    """(cid, other): classes and the components they have to meet, by the features that several components have.

    ``sets`` (cid, hashes, comp, size).  A pair in two components shares held
    features only, so the held ones of both differ in no more than the sum of
    what each holds beyond its part of the least intersection: its slack.  The
    one with less slack visits.  Sets with like slack have one level, that cuts
    the features to more parts than a pair can differ in; the visitor has some
    non-empty part equal to its partner's, among as many as they can differ in
    and one more (with fewer, it looks for all parts, empty ones too).  Copies
    edited each in its own way that are far from their original have little
    slack, so few large parts, which hardly any others share.
    """
    features = sets.select("cid", "comp", "size", F.explode("hashes").alias("feature"))
    spread = features.groupBy("feature").agg(F.min("comp").alias("first"), F.max("comp").alias("last"))
    held = features.join(spread.filter("first != last").select("feature"), "feature").groupBy("cid")
    held = held.agg(F.first("comp").alias("comp"), F.first("size").alias("size"), F.collect_list("feature").alias("hashes"))
    names = ["sig", "cid", "comp", "size", "held", "host"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, comp, size, hashes in zip(*[c.to_pylist() for c in batch.columns[:3]], batch.column(3), strict=True):
                found = held_signatures(np.sort(hashes.values.to_numpy(zero_copy_only=False).view(np.uint64)), size, percent)
                sigs, n = np.concatenate(found).view(np.int64), sum(map(len, found))
                same = [pa.array(np.full(n, v)) for v in (cid, comp, size, len(hashes))]
                yield pa.RecordBatch.from_arrays([pa.array(sigs), *same, pa.array(np.arange(n) < len(found[0]))], names=names)

    held = held.filter(f"100 * size(hashes) >= {percent} * size").select("cid", "comp", "size", "hashes")
    rows = materialize(held.mapInArrow(run, "sig long, cid long, comp long, size long, held long, host boolean"), "held")
    hosts = rows.filter("host").groupBy("sig", F.col("comp").alias("other")).agg(F.min("size").alias("low"), F.max("size").alias("high"), F.max("held").alias("most"))
    asking = rows.filter("NOT host").drop("host").join(hosts, "sig").filter(
        f"comp != other AND 100 * high >= {percent} * size AND {percent} * low <= 100 * size AND {100 + percent} * least(held, most) >= {percent} * (size + low)"
    )
    return asking.select("cid", "other").distinct()


def candidate_links(docs: DataFrame, members: DataFrame, width: int, percent: int, n_tasks: int, attempt: int = 0) -> DataFrame:
    """Verified links (a, b) between classes that give all components."""
    range_bits = max(LEAST_RANGE_BITS, (4 * n_tasks).bit_length())
    packed = packed_signatures(docs, width, percent, range_bits, attempt=attempt)
    shared = materialize(shared_signatures(packed, n_tasks), "signatures")
    kinds = members.filter("profile IS NOT NULL").groupBy("cid").agg(
        F.first("n_shingles").alias("size"), F.first("spare_band").alias("spare_band"), F.first("spare_window").alias("spare_window"), F.first("profile").alias("profile")
    )
    kinds = materialize(kinds, "kinds")
    rows = materialize(ranked(shared, kinds.drop("profile"), percent), "ranked")
    fits = f"{percent} * greatest(x.size, y.size) <= 100 * least(x.size, y.size)"
    # with parts of one feature the intersection is at most what either class shares with others
    may = f"(NOT x.single OR {100 + percent} * least(x.held, y.held) >= {percent} * (x.size + y.size))"

    # the centre of a signature: of an original and its edited copies that is the original
    centre = rows.filter("probe").groupBy("sig").agg(F.max(F.struct("common", "cid", "size", "held")).alias("c"))
    centre = materialize(centre.select("sig", "c.cid", "c.size", "c.held"), "centres")
    stars = rows.filter("probe").alias("x").join(centre.alias("y"), "sig").filter(f"x.cid != y.cid AND {fits} AND {may}")
    stars = stars.select(F.col("y.cid").alias("a"), F.col("x.cid").alias("b")).distinct()
    stars = materialize(likely(stars, kinds, percent), "stars")
    links = materialize(verified(docs, members, stars, width, percent), "links")

    # all shared signatures, those that nobody probes too, by component
    labels = materialize(connected(links).withColumnRenamed("node", "cid"), "labels")
    placed = rows.join(labels, "cid", "left").select("sig", "cid", "size", F.coalesce("label", "cid").alias("comp"), "spared", "probe")
    involved = materialize(meeting(placed), "involved")
    if involved.isEmpty():
        return links
    sets = materialize(sets_of(docs, members, involved, width), "features")
    visits = materialize(visiting(sets.join(involved, "cid"), percent), "visits")
    if visits.isEmpty():
        return links
    rest = materialize(likely_members(visits, labels, kinds, percent), "rest")
    return links if rest.isEmpty() else links.union(verified(docs, members, rest, width, percent))


def _placed(source: DataFrame, width: int, percent: int, task_bytes: int) -> DataFrame:
    """members (doc_id, key, n_shingles, cid) with ``comp``, the class label of the component (null without words)."""
    for attempt in range(ATTEMPTS):
        members = materialize(classes(source, width, percent, attempt), "members")
        n, spare = members.agg(F.sum("n_shingles"), F.min(F.least("spare_band", "spare_window"))).first()
        if n is None or spare >= 0:
            break
    else:
        raise ValueError("a set has too few non-empty parts however its features are dealt")
    n = n or 0
    least = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_tasks = max(least, int(n * 0.65 * (LOW_BYTES + 8) / task_bytes) + 1)
    links = candidate_links(source, members.filter("cid IS NOT NULL"), width, percent, n_tasks, attempt)
    labels = materialize(connected(links).withColumnRenamed("node", "cid"), "labels")
    placed = looked_up(members.select("doc_id", "key", "n_shingles", "cid"), labels, "cid")
    return placed.withColumn("comp", F.coalesce("label", "cid")).drop("label")


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, task_bytes: int = 32 << 20
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Links are pairs of shingle sets with 100 * intersection >= percent * union;
    component_id is the smallest doc_id reachable by links (the own one for
    documents without words).  Null text counts as empty.  Rows with equal
    ids are separate documents; a null id is never the smallest, and a
    component of null ids only has a null component_id.  Other columns are
    ignored; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    placed = _placed(source, width, percent, task_bytes)
    several = placed.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    out = looked_up(placed, materialize(several.select("comp", "_first"), "smallest"), "comp")
    return out.select("doc_id", "n_shingles", F.coalesce("_first", "doc_id").alias("component_id"))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, task_bytes: int = 32 << 20
) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Documents without words all stay.  Of rows equal in id and text one stays;
    null ids sort last.  Columns keep their names and values, whatever they are
    called; an empty table gives no rows; null texts have no words.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = F.col(f"c{names.index(id_col)}").cast("long"), F.col(f"c{names.index(text_col)}")
    inner = inner.withColumns({"key": F.xxhash64(doc_id, text), "doc_id": F.coalesce(doc_id, F.lit(-(1 << 63)))})
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    placed = _placed(source, width, percent, task_bytes).filter("comp IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("key").alias("k"))
    several = placed.groupBy("comp").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = materialize(several.select("comp", F.col("first.i").alias("i"), F.col("first.k").alias("k")), "several")
    rows = looked_up(placed, several, "comp", "inner")
    gone = rows.filter(~(F.col("k") == F.col("key")) | ~F.col("doc_id").eqNullSafe(F.col("i")))
    gone = materialize(gone.select("key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id")).distinct(), "gone")
    again = materialize(placed.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key").distinct(), "again")
    left = inner.join(F.broadcast(gone) if gone.count() <= BROADCAST_CLASSES else gone, ["key", "doc_id"], "left_anti")
    if not again.isEmpty():
        repeated = left.join(again, "key", "left_semi").dropDuplicates(["key", "doc_id"])
        left = left.join(again, "key", "left_anti").unionByName(repeated)
    return left.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)
