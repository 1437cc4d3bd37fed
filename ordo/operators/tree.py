"""Hoeffding trees grown level by level from grouped statistics.

All leaves of a level are split in two aggregates over the table: the range of
every numeric feature at every leaf, then the target's statistics by leaf,
feature and candidate (ranges between equally spaced thresholds, or values of a
nominal feature).  Both are partial in every task, and their results are small:
leaves times features times candidates.  Merits of all candidates are
expressions over that table; only each leaf's best candidate of every feature
reaches the driver, where the Hoeffding bound decides whether the best may be
told from the second best, given the rows the leaf has seen.  The tree is a
table of nodes; rows find their leaf by an expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.criteria import CRITERIA, Criterion
from ..plans.rows import written
from .windows import _as_list

NODE, Y = "_ordo_node", "_ordo_y"


@dataclass
class Node:
    """A leaf, or a split: rows with ``feature`` at most (nominal: equal to) ``at`` go left, others right, nulls to ``null_left``."""

    depth: int
    stats: list[float]
    feature: str | None = None
    at: float | str | None = None
    left: int = -1
    right: int = -1
    null_left: bool = True
    merit: float | None = None


@dataclass
class Tree:
    numeric: list[str]
    nominal: list[str]
    labels: list | None  # None: regression
    centre: float = 0.0  # of the target, which moments are taken from
    nodes: list[Node] = field(default_factory=list)

    def leaf(self, node: int = 0) -> Column:
        """Number of the leaf a row falls in."""
        n = self.nodes[node]
        if n.feature is None:
            return F.lit(node)
        x = F.col(n.feature).cast("string" if n.feature in self.nominal else "double")
        hit = x == F.lit(n.at) if n.feature in self.nominal else F.when(~F.isnan(x), x) <= F.lit(n.at)
        # each branch stands in it once, so it grows with the number of nodes
        return F.when(F.coalesce(hit, F.lit(n.null_left)), self.leaf(n.left)).otherwise(self.leaf(n.right))

    def leaves(self) -> list[int]:
        return [i for i, n in enumerate(self.nodes) if n.feature is None]

    def table(self, spark) -> DataFrame:
        """(node, depth, feature, at, left, right, n, merit)"""
        rows = [
            (i, n.depth, n.feature, None if n.at is None else str(n.at), n.left, n.right, float(sum(n.stats) if self.labels is not None else n.stats[0]), n.merit)
            for i, n in enumerate(self.nodes)
        ]
        return spark.createDataFrame(rows, "node int, depth int, feature string, at string, left int, right int, n double, merit double")


def hoeffding_bound(value_range: float, delta: float, n: float) -> float:
    """How far a mean of n values can be from its expectation, but for a chance of ``delta``."""
    return math.sqrt(value_range * value_range * math.log(1.0 / delta) / (2.0 * n))


def candidates(rows: DataFrame, numeric: Sequence[str], nominal: Sequence[str], size: int, criterion: Criterion, n_splits: int = 10) -> DataFrame:
    """(node, feature, at, left, right, merit): all candidate splits of every node.

    ``rows`` has ``NODE`` and ``Y``, an array of ``size`` numbers whose sums
    are the statistics.  Nulls and NaN of a feature are in neither branch.
    """
    parts = []
    if numeric:
        ends = []
        for i, c in enumerate(numeric):
            x = F.col(c).cast("double")
            x = F.when(~F.isnan(x), x)
            ends += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        ranges = rows.groupBy(NODE).agg(*ends).withColumnRenamed(NODE, "_node")
        # as many rows as there are leaves to split
        met = rows.join(F.broadcast(ranges), F.col(NODE) == F.col("_node"))
        found = []
        for i, c in enumerate(numeric):
            x = F.col(c).cast("double")
            step = (F.col(f"hi{i}") - F.col(f"lo{i}")) / (n_splits + 1.0)
            over = F.lit(0)
            for k in range(n_splits):
                over = over + (x > F.col(f"lo{i}") + step * (k + 1)).cast("int")
            # a small aggregate each: rows are read once a feature, never multiplied
            ranged = met.select(NODE, Y, F.lit(i).alias("f"), F.when(~F.isnan(x), over).alias("bin"), F.col(f"lo{i}").alias("lo"), step.alias("step"))
            found.append(ranged.filter("bin IS NOT NULL").groupBy(NODE, "f", "bin", "lo", "step").agg(*[F.sum(F.col(Y)[j]).alias(f"p{j}") for j in range(size)]))
        bins = reduce(DataFrame.unionByName, found)
        whole = Window.partitionBy(NODE, "f")
        upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        left = F.array(*[F.sum(f"p{i}").over(upto) for i in range(size)])
        right = F.array(*[F.sum(f"p{i}").over(whole) - F.sum(f"p{i}").over(upto) for i in range(size)])
        names = F.array(*[F.lit(c) for c in numeric])
        # thresholds of the empty ranges that follow split as this one
        end = F.coalesce(F.lead("bin").over(whole.orderBy("bin")), F.lit(n_splits))
        splits = bins.select(NODE, "f", "bin", "lo", "step", left.alias("left"), right.alias("right"), end.alias("end"))
        splits = splits.filter(f"bin < {n_splits} AND step > 0").withColumn("k", F.explode(F.sequence("bin", F.col("end") - 1)))
        at = (F.col("lo") + F.col("step") * (F.col("k") + 1)).cast("string")
        parts.append(splits.select(NODE, F.get(names, F.col("f")).alias("feature"), at.alias("at"), "left", "right"))
    for c in nominal:
        values = rows.filter(F.col(c).isNotNull()).groupBy(NODE, F.col(c).cast("string").alias("at")).agg(F.array(*[F.sum(F.col(Y)[i]) for i in range(size)]).alias("left"))
        everything = values.groupBy(NODE).agg(F.array(*[F.sum(F.col("left")[i]) for i in range(size)]).alias("whole"))
        right = F.zip_with("whole", "left", lambda a, b: a - b)
        parts.append(values.join(everything, NODE).select(NODE, F.lit(c).alias("feature"), "at", "left", right.alias("right")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("merit", criterion.merit(F.col("left"), F.col("right")))


def _grow(
    rows: DataFrame, tree: Tree, size: int, criterion: Criterion, delta: float, tie: float, max_depth: int, max_leaves: int, n_splits: int, min_rows: float
) -> Tree:
    """Splits the leaves of one level after the other."""
    regression = tree.labels is None
    columns = [*tree.numeric, *tree.nominal]
    first = rows.agg(*[F.sum(F.col(Y)[i]) for i in range(size)]).first()
    tree.nodes.append(Node(0, [float(v or 0.0) for v in first]))
    weight = (lambda s: s[0]) if regression else sum
    active = [0]
    while active and tree.nodes[active[0]].depth < max_depth and len(tree.leaves()) < max_leaves:
        level = rows.withColumn(NODE, tree.leaf()).filter(F.col(NODE).isin(active)).select(NODE, Y, *columns)
        found = candidates(level, tree.numeric, tree.nominal, size, criterion, n_splits).filter("merit IS NOT NULL")
        best = F.row_number().over(Window.partitionBy(NODE, "feature").orderBy(F.desc("merit"), F.expr("try_cast(at AS double)"), "at"))
        found = found.withColumn("k", best).filter("k = 1").select(NODE, "feature", "at", "left", "right", "merit")
        by_node: dict[int, list] = {}
        for r in found.collect():  # leaves of the level times features
            by_node.setdefault(r[NODE], []).append(r)
        following = []
        for node in active:
            leaf = tree.nodes[node]
            n = weight(leaf.stats)
            order = sorted(by_node.get(node, []), key=lambda r: (-r["merit"], r["feature"]))
            pure = not regression and sum(v > 0 for v in leaf.stats) < 2
            if not order or pure or n < min_rows or len(tree.leaves()) >= max_leaves:
                continue
            top = order[0]
            second = order[1]["merit"] if len(order) > 1 else 0.0
            bound = hoeffding_bound(criterion.range_of(sum(v > 0 for v in leaf.stats) if not regression else 2), delta, n)
            nothing = 0.0
            if not regression and criterion is CRITERIA["gini"]:  # what no split is worth
                nothing = sum((v / n) ** 2 for v in leaf.stats)
            if top["merit"] <= nothing:
                continue
            second = max(second, nothing)
            if regression:
                clear = second / top["merit"] < 1 - bound
            else:
                clear = top["merit"] - second > bound
            if not clear and bound >= tie:
                continue
            left, right = list(top["left"]), list(top["right"])
            kind_nominal = top["feature"] in tree.nominal
            leaf.feature, leaf.at, leaf.merit = top["feature"], top["at"] if kind_nominal else float(top["at"]), top["merit"]
            leaf.null_left = weight(left) >= weight(right)
            leaf.left, leaf.right = len(tree.nodes), len(tree.nodes) + 1
            tree.nodes += [Node(leaf.depth + 1, left), Node(leaf.depth + 1, right)]
            following += [leaf.left, leaf.right]
        active = following
    return tree


def fit_classifier(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    criterion: str = "info_gain",
    delta: float = 1e-7,
    tie: float = 0.05,
    max_depth: int = 8,
    max_leaves: int = 256,
    n_splits: int = 10,
    min_rows: float = 200,
    max_labels: int = 200,
) -> Tree:
    """A classification tree; string and boolean features are nominal, others numeric.

    Rows with a null target are not learnt from.  A leaf is split if its best
    feature's merit exceeds that of the second (and of no split) by the
    Hoeffding bound, or the bound is below ``tie``.
    """
    features = _as_list(features)
    known = df.filter(F.col(target).isNotNull())
    labels = [r[0] for r in known.select(target).distinct().orderBy(target).limit(max_labels + 1).collect()]
    if len(labels) > max_labels:
        raise ValueError(f"{target} has more than {max_labels} labels")
    numeric, nominal = _kinds(df, features)
    hot = F.array(*[(F.col(target) == F.lit(v)).cast("double") for v in labels]) if labels else F.array().cast("array<double>")
    rows = written(_typed(known, numeric, nominal).withColumn(Y, hot).select(*features, Y), "tree")
    tree = Tree(numeric, nominal, labels)
    if not labels:
        tree.nodes.append(Node(0, []))
        return tree
    return _grow(rows, tree, len(labels), CRITERIA[criterion], delta, tie, max_depth, max_leaves, n_splits, min_rows)


def fit_regressor(
    df: DataFrame, features: Sequence[str], target: str, delta: float = 1e-7, tie: float = 0.05, max_depth: int = 8, max_leaves: int = 256, n_splits: int = 10, min_rows: float = 200
) -> Tree:
    """A regression tree by variance reduction; a leaf is split if the second best is less than the bound allows of the best."""
    features = _as_list(features)
    y = F.col(target).cast("double")
    known = df.filter(y.isNotNull() & ~F.isnan(y))
    centre = known.agg(F.avg(y)).first()[0] or 0.0
    numeric, nominal = _kinds(df, features)
    gap = y - F.lit(float(centre))
    rows = written(_typed(known, numeric, nominal, F.array(F.lit(1.0), gap, gap * gap).alias(Y)).select(*features, Y), "tree")
    return _grow(rows, Tree(numeric, nominal, None, centre), 3, CRITERIA["variance_reduction"], delta, tie, max_depth, max_leaves, n_splits, min_rows)


def _kinds(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    text = (T.StringType, T.BooleanType)
    nominal = [c for c in features if isinstance(df.schema[c].dataType, text)]
    return [c for c in features if c not in nominal], nominal


def _typed(df: DataFrame, numeric: Sequence[str], nominal: Sequence[str], *more: Column) -> DataFrame:
    """Features as doubles and strings, other columns as they are (``more`` is taken from the unchanged ones)."""
    kept = [F.col(c) for c in df.columns if c not in numeric and c not in nominal]
    return df.select(*kept, *[F.col(c).cast("double").alias(c) for c in numeric], *[F.col(c).cast("string").alias(c) for c in nominal], *more)


def predict(df: DataFrame, tree: Tree, name: str = "y_pred", proba: str | None = None, leaf: str | None = None) -> DataFrame:
    """``df`` with the leaf's majority class (ties: the first label) or mean; null from a tree that has seen nothing."""
    rows = df.withColumn("_ordo_leaf", tree.leaf())
    if tree.labels is not None:
        values = [tree.labels[max(range(len(n.stats)), key=lambda i: (n.stats[i], -i))] if any(n.stats) else None for n in tree.nodes]
    else:
        values = [tree.centre + n.stats[1] / n.stats[0] if n.stats[0] else None for n in tree.nodes]
    out = rows.withColumn(name, F.get(F.array(*[F.lit(v) for v in values]), F.col("_ordo_leaf")))
    if proba and tree.labels is not None:
        shares = [F.array(*[F.lit(v / sum(n.stats) if sum(n.stats) else None).cast("double") for v in n.stats]) for n in tree.nodes]
        out = out.withColumn(proba, F.get(F.array(*shares), F.col("_ordo_leaf")))
    return out.withColumnRenamed("_ordo_leaf", leaf) if leaf else out.drop("_ordo_leaf")
