"""Linear models fitted by gradient steps over batches: regression, classification, one-class.

One step is one aggregate: every row's loss gradient is an expression of its
features and the current weights, and the sums of gradient times feature are
grouped partially in every task.  Only the weights, a number per feature (and
class), are on the driver, where the optimizer moves them.  The rows are
written once, by batch, so a step reads its own batch alone.  With ``path`` the
state is stored after every step in the shared folder, and a fit that was cut
off goes on from there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import losses as L
from ..plans.session import ensure_checkpoint_dir
from .windows import _as_list

BATCH = "_ordo_batch"


# ------------------------------------------------------------ optimizers


@dataclass
class Sgd:
    """Weights move against the gradient by ``lr``, a number or a function of the steps done."""

    lr: float | Callable[[int], float] = 0.01
    state: dict[str, list[float]] = field(default_factory=dict)

    def rate(self, step: int) -> float:
        return self.lr(step) if callable(self.lr) else self.lr

    def _held(self, name: str, like: np.ndarray) -> np.ndarray:
        return np.array(self.state.get(name, np.zeros_like(like)), float).reshape(like.shape)

    def _keep(self, name: str, value: np.ndarray) -> np.ndarray:
        self.state[name] = value.ravel().tolist()
        return value

    def move(self, weights: np.ndarray, gradient: np.ndarray, step: int) -> np.ndarray:
        return weights - self.rate(step) * gradient


@dataclass
class Momentum(Sgd):
    """A running direction: ``rho`` of the last one plus the new gradient's step."""

    rho: float = 0.9

    def move(self, weights, gradient, step):
        return weights - self._keep("v", self.rho * self._held("v", gradient) + self.rate(step) * gradient)


@dataclass
class AdaGrad(Sgd):
    """Each weight's rate falls with the squares of its gradients so far."""

    eps: float = 1e-8

    def move(self, weights, gradient, step):
        seen = self._keep("g2", self._held("g2", gradient) + gradient * gradient)
        return weights - self.rate(step) / np.sqrt(seen + self.eps) * gradient


@dataclass
class Adam(Sgd):
    """Moving averages of gradients and their squares, corrected for their start at zero."""

    lr: float | Callable[[int], float] = 0.1
    beta_1: float = 0.9
    beta_2: float = 0.999
    eps: float = 1e-8

    def move(self, weights, gradient, step):
        m = self._keep("m", self.beta_1 * self._held("m", gradient) + (1 - self.beta_1) * gradient)
        v = self._keep("v", self.beta_2 * self._held("v", gradient) + (1 - self.beta_2) * gradient * gradient)
        mean, spread = m / (1 - self.beta_1 ** (step + 1)), v / (1 - self.beta_2 ** (step + 1))
        return weights - self.rate(step) * mean / (np.sqrt(spread) + self.eps)


# ------------------------------------------------------------ models


@dataclass
class Model:
    """Weights (outputs, features), an intercept for each output, and the steps done."""

    features: list[str]
    weights: np.ndarray
    intercepts: np.ndarray
    labels: list | None = None
    steps: int = 0

    def scores(self) -> list[Column]:
        """Raw score of every output."""
        out = []
        for w, b in zip(self.weights.tolist(), self.intercepts.tolist(), strict=True):
            total = F.lit(b)
            for name, value in zip(self.features, w, strict=True):
                total = total + F.lit(value) * F.col(name).cast("double")
            out.append(total)
        return out


def _known(df: DataFrame, columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
        if dict(df.dtypes)[c] in ("double", "float"):
            out = out & ~F.isnan(c)
    return out


def _batches(df: DataFrame, columns: Sequence[str], batch: str | None) -> tuple[DataFrame, list[int]]:
    """The rows that can be learnt from, written by batch, and the numbers of the batches."""
    spark = df.sparkSession
    rows = df.filter(_known(df, columns)).select(*columns, (F.col(batch).cast("long") if batch else F.lit(0).cast("long")).alias(BATCH))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ordo-batches-{uuid.uuid4().hex}"
    rows.write.partitionBy(BATCH).parquet(path)
    held = spark.read.schema(rows.schema).parquet(path)
    return held, [r[0] for r in held.select(BATCH).distinct().orderBy(F.col(BATCH).asc_nulls_first()).collect()]


def _stored(spark, path: str) -> dict | None:
    """The state that an earlier fit stored last."""
    try:
        found = spark.read.json(f"{path}/*", schema="step long, state string")
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    last = found.orderBy(F.desc("step")).first()
    return None if last is None else json.loads(last["state"])


def _store(spark, path: str, step: int, state: dict) -> None:
    spark.createDataFrame([(step, json.dumps(state))], "step long, state string").coalesce(1).write.mode("overwrite").json(f"{path}/{step:09d}")


def _fit(df, features, target, gradients, n_outputs, optimizer, intercept_lr, intercepts, l2, clip, epochs, batch, weight, path, intercept_extra=0.0, labels=None, on_step=None) -> Model:
    """Gradient steps over all batches, ``epochs`` times; ``gradients(y, scores)`` gives each output's loss gradient."""
    spark = df.sparkSession
    features = _as_list(features)
    columns = [*features, *([target] if target else []), *([weight] if weight else [])]
    held, numbers = _batches(df, list(dict.fromkeys(columns)), batch)
    model = Model(features, np.zeros((n_outputs, len(features))), np.array(intercepts, float), labels)
    done = _stored(spark, path) if path else None
    if done:
        model = Model(features, np.array(done["weights"]), np.array(done["intercepts"]), labels, done["steps"])
        optimizer.state = done["optimizer"]
    for step in range(model.steps, epochs * len(numbers)):
        y = F.col(target) if target else None
        slopes = gradients(y, model.scores())
        slopes = [F.col(weight).cast("double") * s if weight else s for s in slopes]
        slopes = [F.least(F.greatest(s, F.lit(-clip)), F.lit(clip)) for s in slopes]
        rows = held.filter(F.col(BATCH).eqNullSafe(F.lit(numbers[step % len(numbers)])))
        rows = rows.select(*features, *[s.alias(f"_ordo_s{i}") for i, s in enumerate(slopes)])
        means = [F.avg(F.col(f"_ordo_s{i}") * F.col(f).cast("double")) for i in range(n_outputs) for f in features]
        found = rows.agg(*[F.avg(f"_ordo_s{i}") for i in range(n_outputs)], *means).first()
        slope = np.array(found[:n_outputs], float)
        gradient = np.array(found[n_outputs:], float).reshape(model.weights.shape) + l2 * model.weights
        model.intercepts = model.intercepts - (intercept_lr * slope + intercept_extra)
        model.weights = optimizer.move(model.weights, gradient, step)
        model.steps = step + 1
        if path:
            _store(spark, path, step, {"weights": model.weights.tolist(), "intercepts": model.intercepts.tolist(), "steps": step + 1, "optimizer": optimizer.state})
        if on_step:
            on_step(model)
    return model


def fit(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    loss: L.Loss | None = None,
    optimizer: Sgd | None = None,
    intercept_lr: float = 0.01,
    intercept: float = 0.0,
    l2: float = 0.0,
    clip: float = 1e12,
    epochs: int = 1,
    batch: str | None = None,
    weight: str | None = None,
    path: str | None = None,
    on_step: Callable[[Model], None] | None = None,
) -> Model:
    """A linear model of one output under any loss (squared: linear regression; log: logistic regression).

    ``batch``: a column that numbers the batches, taken in ascending order
    (null first); without it every step reads all rows.  Rows with a null or
    NaN feature, target or weight are not learnt from; without rows the weights
    stay zero.  ``path``: folder of the steps' states.
    """
    loss = loss or L.squared()
    return _fit(df, features, target, lambda y, s: [loss.gradient(y, s[0])], 1, optimizer or Sgd(), intercept_lr, [intercept], l2, clip, epochs, batch, weight, path, on_step=on_step)


def fit_perceptron(df: DataFrame, features: Sequence[str], target: str, l2: float = 0.0, epochs: int = 1, batch: str | None = None, **more) -> Model:
    """Hinge loss with threshold 0 and full steps."""
    return fit(df, features, target, L.hinge(0.0), Sgd(1.0), 1.0, l2=l2, epochs=epochs, batch=batch, **more)


def fit_softmax(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    labels: Sequence | None = None,
    optimizer: Sgd | None = None,
    l2: float = 0.0,
    class_weight: dict | None = None,
    epochs: int = 1,
    batch: str | None = None,
    path: str | None = None,
    max_labels: int = 1000,
    on_step: Callable[[Model], None] | None = None,
) -> Model:
    """Softmax regression, without intercepts; labels in ascending order, by default those that occur (at most ``max_labels``)."""
    if labels is None:
        labels = [r[0] for r in df.filter(F.col(target).isNotNull()).select(target).distinct().orderBy(target).limit(max_labels + 1).collect()]
        if len(labels) > max_labels:
            raise ValueError(f"{target} has more than {max_labels} labels")
    labels = list(labels)

    def gradients(y: Column, scores: list[Column]) -> list[Column]:
        return L.cross_entropy(y, labels, L.softmax(scores), class_weight)[1]

    return _fit(df, features, target, gradients, len(labels), optimizer or Sgd(), 0.0, [0.0] * len(labels), l2, 1e12, epochs, batch, None, path, labels=labels, on_step=on_step)


def fit_one_class(
    df: DataFrame,
    features: Sequence[str],
    nu: float = 0.1,
    optimizer: Sgd | None = None,
    intercept_lr: float = 0.01,
    epochs: int = 1,
    batch: str | None = None,
    path: str | None = None,
    on_step: Callable[[Model], None] | None = None,
) -> Model:
    """One-class support vector machine: hinge loss of the constant target 1, an intercept from 1 on that also falls by ``nu``."""
    loss = L.hinge()
    return _fit(df, features, None, lambda _, s: [loss.gradient(F.lit(1.0), s[0])], 1, optimizer or Sgd(), intercept_lr, [1.0], nu / 2, 1e12, epochs, batch, None, path,
                intercept_extra=intercept_lr * nu, on_step=on_step)


def predict(df: DataFrame, model: Model, loss: L.Loss | None = None, name: str = "y_pred") -> DataFrame:
    """``df`` with the loss's mean of the raw score; null where a feature is."""
    return df.withColumn(name, (loss or L.squared()).mean(model.scores()[0]))


def predict_label(df: DataFrame, model: Model, name: str = "y_pred", proba: str = "y_proba") -> DataFrame:
    """``df`` with the label of a softmax model's greatest score (ties: the first label) and all labels' probabilities."""
    shares = L.softmax(model.scores())
    out = df.withColumn(proba, F.array(*shares))
    labels = F.array(*[F.lit(v) for v in model.labels])
    best = F.array_position(F.col(proba), F.array_max(proba))
    return out.withColumn(name, F.get(labels, best.cast("int") - 1))


def anomaly_score(df: DataFrame, model: Model, name: str = "svm_score") -> DataFrame:
    """``df`` with the weights' part of a one-class model's score; the lower, the more anomalous."""
    return df.withColumn(name, model.scores()[0] - F.lit(float(model.intercepts[0])))
