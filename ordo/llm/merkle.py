"""Merkle manifest of a dataset: leaf digests, subtree and root, a proof per row, and its verification.

Rows of one group are leaves in the order of their ids; runs of ``ARITY``
consecutive nodes hash to a parent until one is left, the subroot; the
subroots, in the order of their groups, hash to the root likewise.

A group of any size is cut into blocks of ``ARITY ** LEVELS`` nodes, so no
task takes a whole group.  Within a block, level l lives on the rows whose
place is a multiple of ``ARITY ** l`` (each node on the row of its first leaf):
lag and lead columns at the fixed offsets 1 and 2 times ``ARITY ** l``, masked
by the node's slot and its run's length, are its siblings, and rows in slot 0
hash the parent.  All levels of a block share one sort.  What each block hashes
to are the nodes of the next round, smaller by that factor, and so on; on the
way back every row takes its block's path to the top.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ARITY = 3
LEVELS = 7
BLOCK = ARITY**LEVELS
ROWS_PER_TASK = 500_000
PATH = "array<struct<l:string,r:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' text, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value that cannot be taken for two: its bytes, a colon, itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def group_key(group: Column) -> Column:
    """The group as text that sorts null first, then by its UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("s"), group.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``at``, their place from 0 within ``g`` by ``order``, and ``size``, the rows of ``g``.

    Rows are dealt by ranges of (g, order) and counted per range, so that a
    large group is numbered by many tasks.
    """
    tasks = max(-(-rows.count() // ROWS_PER_TASK), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(tasks, "g", *order).sortWithinPartitions("g", *order)
    placed = materialize(dealt.withColumn("u", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("part", F.shiftright("u", 33))
    parts = placed.groupBy("g", "part").agg(F.min("u").alias("first"), F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("g")
    parts = parts.select(
        "g",
        "part",
        "first",
        F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(group).alias("size"),
    )
    return placed.join(parts, ["g", "part"]).withColumn("at", F.col("u") - F.col("first") + F.col("before")).drop("u", "part", "first", "before")


def _levels(nodes: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``nodes`` (g, at, size, h ...) with the siblings ``l*`` and ``r*`` of every level of their block and the block's hash ``top``.

    Of each level a node's columns stand on the row of its first leaf, null on
    the others.  Also the levels that each group has.
    """
    out = nodes.withColumn("block", F.expr(f"at div {BLOCK}")).withColumn("h0", F.col("h"))
    window = Window.partitionBy("g", "block").orderBy("at")
    live = []
    for level in range(LEVELS):
        step, h = ARITY**level, F.col(f"h{level}")
        count = F.expr(f"(size + {step - 1}) div {step}")
        index = F.expr(f"at div {step}")
        slot = index % ARITY
        run = F.least(F.lit(ARITY), count - index + slot)
        live.append(count > 1)
        near = {f"_{k}": F.lag(h, k * step).over(window) for k in range(1, ARITY)} | {f"{k}_": F.lead(h, k * step).over(window) for k in range(1, ARITY)}
        out = out.withColumns(near)
        here = F.col("at") % step == 0
        left = F.concat(*[F.when(slot >= k, F.col(f"_{k}")).otherwise("") for k in reversed(range(1, ARITY))])
        right = F.concat(*[F.when(slot + k < run, F.col(f"{k}_")).otherwise("") for k in range(1, ARITY)])
        out = out.withColumns({f"l{level}": F.when(here, left), f"r{level}": F.when(here, right)}).drop(*near)
        parent = F.when(live[-1], digest(h, F.col(f"r{level}"))).otherwise(h)
        out = out.withColumn(f"h{level + 1}", F.when(here & (slot == 0), parent)).drop(f"h{level}")
    return out.withColumnRenamed(f"h{LEVELS}", "top"), live


def parents(nodes: DataFrame, name: str) -> DataFrame:
    """(g, at, size, h): one node for each block of ``nodes``."""
    tops = _levels(nodes)[0].filter(F.col("at") % BLOCK == 0)
    return materialize(tops.select("g", F.col("block").alias("at"), F.expr(f"(size + {BLOCK - 1}) div {BLOCK}").alias("size"), F.col("top").alias("h")), name)


def with_path(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` with ``path``: their siblings level by level up to the top, through their block's path in ``above`` (g, at, path)."""
    found, live = _levels(nodes)
    down = Window.partitionBy("g", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    names = [f"{side}{level}" for level in range(LEVELS) for side in "lr"]
    found = found.withColumns({n: F.last(n, ignorenulls=True).over(down) for n in names})
    steps = [F.when(live[k], F.struct(F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(LEVELS)]
    found = found.withColumn("near", F.array_compact(F.array(*steps)).cast(PATH)).drop("top", *names)
    upper = above.select("g", F.col("at").alias("block"), F.col("path").alias("far"))
    return found.join(upper, ["g", "block"]).withColumn("path", F.concat("near", "far")).drop("near", "far", "block")


def rounds(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Nodes of every round, the last with one for each group."""
    out = [nodes]
    while (out[-1].agg(F.max("size")).first()[0] or 1) > 1:
        out.append(parents(out[-1], name))
    return out


def descend(levels: list[DataFrame], top: DataFrame, name: str) -> DataFrame:
    """(g, at, path ...) of the first round's nodes, from the paths of the last one's."""
    paths = top
    for nodes in reversed(levels[1:-1]):
        paths = materialize(with_path(nodes, paths).select("g", "at", "path"), name)
    return with_path(levels[0], paths) if len(levels) > 1 else levels[0].join(paths.select("g", "path"), "g")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings hash to."""
    return F.aggregate(path, leaf, lambda h, step: digest(step["l"], h, step["r"]))


def manifest(leaves: DataFrame, name: str = "manifest") -> tuple[DataFrame, DataFrame]:
    """Rows of ``leaves`` (g, o, h ...) with ``path``, ``subroot`` and ``root``; and the groups (g, h: subroot, path).

    ``g`` is a ``group_key``, ``o`` the order within it (null first; equal ones
    by their digests), ``h`` the leaf's digest.  No leaves, no rows.
    """
    rows = materialize(leaves.withColumn("tie", F.monotonically_increasing_id()), name)
    levels = rounds(numbered(rows, ["o", "h", "tie"], name), name)
    groups = levels[-1].select(F.lit("").alias("g"), F.col("g").alias("o"), "h")
    tops = rounds(numbered(groups, ["o"], name), name)
    root = tops[-1].select("h").first()
    root = None if root is None else root["h"]
    last = tops[-1].select("g", "at", F.array().cast(PATH).alias("path"))
    above = materialize(descend(tops, last, name).select(F.col("o").alias("g"), "h", "path"), name)
    top = above.select("g", F.lit(0).cast("long").alias("at"), "path")
    found = descend(levels, top, name).join(above.select("g", F.col("h").alias("subroot")), "g")
    return found.withColumn("root", F.lit(root).cast("string")), above


def document_leaf(docs: DataFrame, fields: Sequence[str], text_col: str, text: Column) -> Column:
    return digest(*[field(text if name == text_col else F.col(name)) for name in fields])


def manifest_documents(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Each document's proof is checked against a copy in which every second one
    (by the checksum of its id) has lost its line ends: ``folded_root`` is the
    root that the copy's leaf gives, ``verified`` whether it is the manifest's.
    Null fields are ``-`` in a leaf, so null and empty texts differ; a null id
    comes first in its source and its copy is untouched, a null source is a
    group of its own, before all others.  Rows with equal ids are leaves each,
    ordered by their digests.  Other columns are ignored; an empty table gives
    no rows.  Texts of any length are hashed whole, by one task each.
    """
    text = F.col(text_col)
    picked = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    bare = F.replace(text, F.lit("\n"), F.lit(""))
    leaf = document_leaf(docs, fields, text_col, text)
    altered = F.when(picked & text.contains("\n"), document_leaf(docs, fields, text_col, bare))
    leaves = docs.select(group_key(F.col(group_col)).alias("g"), F.col(id_col).alias("o"), leaf.alias("h"), altered.alias("altered"))
    found, _ = manifest(leaves)
    proof = digest(F.array_join(F.transform("path", lambda step: F.concat(step["l"], step["r"])), ""))
    out = found.select(
        F.col("o").alias("doc_id"),
        F.col("h").alias("leaf"),
        "subroot",
        "root",
        proof.alias("proof_sha256"),
        folded(F.coalesce("altered", "h"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
