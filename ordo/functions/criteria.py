"""Merits of a binary split, as expressions of the class counts or moments of its branches.

Class counts are arrays of doubles, one entry a class; moments are arrays
(n, sum, sum of squares) of the target.  A merit is null where a split is not
allowed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_BRANCH = 0.01  # share of the rows that both branches must exceed
MIN_SAMPLES = 5  # rows that both branches of a regression split must have


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda acc, n: acc + n)


def impurity(counts: Column) -> Column:
    """Gini impurity of class counts, 1 where there are none."""
    n = total(counts)
    return F.when(n == 0, 1.0).otherwise(F.aggregate(counts, F.lit(1.0), lambda acc, c: acc - (c / n) * (c / n)))


def entropy(counts: Column) -> Column:
    """Entropy of class counts in bits."""
    n = total(counts)
    spread = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc - F.when(c > 0, c * F.log2(c)).otherwise(0.0))
    return F.when(n > 0, (spread + n * F.log2(n)) / n).otherwise(0.0)


def wide_enough(left: Column, right: Column) -> Column:
    a, b = total(left), total(right)
    return (a > MIN_BRANCH * (a + b)) & (b > MIN_BRANCH * (a + b))


def gini(left: Column, right: Column) -> Column:
    a, b = total(left), total(right)
    return 1.0 - (a / (a + b) * impurity(left) + b / (a + b) * impurity(right))


def info_gain(left: Column, right: Column) -> Column:
    a, b = total(left), total(right)
    both = F.zip_with(left, right, lambda x, y: x + y)
    gain = entropy(both) - (a * entropy(left) + b * entropy(right)) / (a + b)
    return F.when(wide_enough(left, right), gain)


def hellinger(left: Column, right: Column) -> Column:
    """Distance of the branches' shares of the first two classes; 0 where either class is missing."""
    negative, positive = left[0] + right[0], left[1] + right[1]
    gap = [F.sqrt(side[0] / negative) - F.sqrt(side[1] / positive) for side in (left, right)]
    distance = F.sqrt(gap[0] * gap[0] + gap[1] * gap[1])
    return F.when(wide_enough(left, right), F.when((negative > 0) & (positive > 0), distance).otherwise(0.0))


def variance(moments: Column) -> Column:
    """Sample variance from (n, sum, sum of squares)."""
    n = moments[0]
    return F.when(n > 1, F.greatest((moments[2] - moments[1] * moments[1] / n) / (n - 1), F.lit(0.0))).otherwise(0.0)


def variance_reduction(left: Column, right: Column) -> Column:
    n = left[0] + right[0]
    both = F.zip_with(left, right, lambda x, y: x + y)
    gain = variance(both) - left[0] / n * variance(left) - right[0] / n * variance(right)
    return F.when((left[0] >= MIN_SAMPLES) & (right[0] >= MIN_SAMPLES), gain)


@dataclass(frozen=True)
class Criterion:
    """``merit(left, right)``, the range of its values for a number of classes, and what no split is worth."""

    merit: Callable[[Column, Column], Column]
    range_of: Callable[[int], float]
    of_moments: bool = False


CRITERIA: dict[str, Criterion] = {
    "gini": Criterion(gini, lambda k: 1.0),
    "info_gain": Criterion(info_gain, lambda k: math.log2(max(k, 2))),
    "hellinger": Criterion(hellinger, lambda k: math.log2(max(k, 2))),
    "variance_reduction": Criterion(variance_reduction, lambda k: 1.0, of_moments=True),
}
