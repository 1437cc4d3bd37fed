"""Loss functions as expressions: value, gradient by the prediction, and the link from a raw score.

Binary losses take a target of 0 / 1 or a boolean and a raw score; they fold
the target to -1 / 1 themselves.  Null in, null out.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Two = Callable[[Column, Column], Column]


def identity(score: Column) -> Column:
    return score


def sigmoid(score: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-score))


@dataclass(frozen=True)
class Loss:
    """``value(y, score)``, ``gradient(y, score)`` by the score, and ``mean(score)``, the prediction."""

    value: Two
    gradient: Two
    mean: Callable[[Column], Column] = identity


def side(y: Column) -> Column:
    """-1 for a target of 0 or false, else 1."""
    return F.when(y.cast("double") == 0, -1.0).when(y.isNotNull(), 1.0)


def absolute() -> Loss:
    return Loss(lambda y, p: F.abs(p - y), lambda y, p: F.when(p > y, 1.0).when(p <= y, -1.0))


def squared() -> Loss:
    return Loss(lambda y, p: (p - y) * (p - y), lambda y, p: 2.0 * (p - y))


def cauchy(c: float = 80.0) -> Loss:
    """The value is the absolute error; only the gradient fades with the size of the error."""
    return Loss(lambda y, p: F.abs(p - y), lambda y, p: (p - y) / (((p - y) / c) * ((p - y) / c) + 1.0))


def epsilon_insensitive(eps: float = 0.1) -> Loss:
    return Loss(
        lambda y, p: F.when((p - y).isNotNull(), F.greatest(F.abs(p - y) - eps, F.lit(0.0))),
        lambda y, p: F.when(p > y + eps, 1.0).when(p + eps < y, -1.0).when(p.isNotNull() & y.isNotNull(), 0.0),
    )


def quantile(alpha: float = 0.5) -> Loss:
    return Loss(lambda y, p: (alpha - (p < y).cast("double")) * (p - y), lambda y, p: (y < p).cast("double") - alpha)


def huber(epsilon: float = 0.1) -> Loss:
    small = lambda y, p: F.abs(p - y) <= epsilon
    return Loss(
        lambda y, p: F.when(small(y, p), 0.5 * (p - y) * (p - y)).otherwise(epsilon * F.abs(p - y) - 0.5 * epsilon * epsilon),
        lambda y, p: F.when(small(y, p), p - y).otherwise(epsilon * F.signum(p - y)),
    )


def poisson() -> Loss:
    return Loss(lambda y, p: F.exp(p) - y * p, lambda y, p: F.exp(p) - y, F.exp)


def hinge(threshold: float = 1.0) -> Loss:
    """A margin equal to the threshold still has a gradient, so that learning can start from zero weights."""

    def gradient(y: Column, p: Column) -> Column:
        return F.when(side(y) * p <= threshold, -side(y)).when(p.isNotNull() & y.isNotNull(), 0.0)

    return Loss(lambda y, p: F.when((side(y) * p).isNotNull(), F.greatest(threshold - side(y) * p, F.lit(0.0))), gradient, sigmoid)


def log(weight_pos: float = 1.0, weight_neg: float = 1.0) -> Loss:
    """Logistic loss; beyond a margin of 18 either way the limits are used."""

    def weight(y: Column) -> Column:
        return F.when(y.cast("double") == 0, weight_neg).otherwise(weight_pos)

    def value(y: Column, p: Column) -> Column:
        z = side(y) * p
        return weight(y) * F.when(z > 18, F.exp(-z)).when(z < -18, -z).otherwise(F.log(1.0 + F.exp(-z)))

    def gradient(y: Column, p: Column) -> Column:
        z = side(y) * p
        return weight(y) * -side(y) * F.when(z > 18, F.exp(-z)).when(z < -18, 1.0).otherwise(1.0 / (F.exp(z) + 1.0))

    return Loss(value, gradient, sigmoid)


def binary_focal(gamma: float = 2.0, beta: float = 1.0) -> Loss:
    share = lambda y, p: sigmoid(gamma * side(y) * p + beta)
    return Loss(lambda y, p: -F.log(share(y, p)) / gamma, lambda y, p: side(y) * (share(y, p) - 1.0), sigmoid)


#: name -> loss with the published default parameters
LOSSES: Mapping[str, Callable[..., Loss]] = {
    "absolute": absolute,
    "squared": squared,
    "cauchy": cauchy,
    "epsilon_insensitive": epsilon_insensitive,
    "quantile": quantile,
    "huber": huber,
    "poisson": poisson,
    "hinge": hinge,
    "log": log,
    "binary_focal": binary_focal,
}


def softmax(scores: Sequence[Column]) -> list[Column]:
    """Probabilities of raw scores, relative to the greatest."""
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    parts = [F.exp(s - top) for s in scores]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return [part / total for part in parts]


def cross_entropy(y: Column, labels: Sequence, proba: Sequence[Column], weights: Mapping | None = None) -> tuple[Column, list[Column]]:
    """(value, gradient by each label's score) of class probabilities, which are held at 1e-15 from 0 and 1."""
    weights = weights or {}
    value, gradient = F.lit(None).cast("double"), []
    for label, share in zip(labels, proba, strict=True):
        w, hit = float(weights.get(label, 1.0)), y == F.lit(label)
        p = F.least(F.greatest(share, F.lit(1e-15)), F.lit(1 - 1e-15))
        value = F.when(hit, -w * F.log(p)).otherwise(value)
        gradient.append(w * (p - hit.cast("double")))
    return F.when(value.isNull() & y.isNotNull(), 0.0).otherwise(value), gradient
