"""Combining the predictions of several models: votes, expert weights, the best one so far, bags.

Models come as columns of predictions made before a row's target was known.
What a model has earned is a running sum or mean of its losses over the rows
before, split over tasks like all running statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import losses as L
from ..functions.stats import Stat
from .imbalance import draw, poisson
from .windows import _as_list, running


def voting(df: DataFrame, predictions: Sequence[str], name: str = "y_pred") -> DataFrame:
    """``df`` with the label that most models predict; ties go to the smaller label, nulls do not vote."""
    votes = F.array_compact(F.array(*predictions))
    labels = F.array_sort(F.array_distinct(votes))
    counted = F.transform(labels, lambda v: F.struct(F.size(F.filter(votes, lambda x: x == v)).alias("n"), v.alias("label")))
    return df.withColumn(name, _most(counted))


def soft_voting(df: DataFrame, probabilities: Sequence[str], name: str = "y_pred") -> DataFrame:
    """``df`` with the label of the greatest summed probability, from maps of label to probability."""
    maps = F.filter(F.array(*probabilities), lambda m: m.isNotNull())
    labels = F.array_sort(F.array_distinct(F.flatten(F.transform(maps, F.map_keys))))

    def total(label: Column) -> Column:
        return F.aggregate(maps, F.lit(0.0), lambda acc, m: acc + F.coalesce(F.try_element_at(m, label), F.lit(0.0)))

    return df.withColumn(name, _most(F.transform(labels, lambda v: F.struct(total(v).alias("n"), v.alias("label")))))


def _most(counted: Column) -> Column:
    """Label of the greatest count, the first among equals; null of nothing."""
    start = F.get(counted, F.lit(0))
    return F.aggregate(counted, start, lambda best, c: F.when(c["n"] > best["n"], c).otherwise(best))["label"]


def _losses(predictions: Sequence[str], y: str, loss: L.Loss) -> dict[str, Column]:
    return {f"_ordo_l{i}": loss.value(F.col(y).cast("double"), F.col(p).cast("double")) for i, p in enumerate(predictions)}


def expert_weighting(
    df: DataFrame,
    predictions: Sequence[str],
    y: str,
    order: Sequence[str] | str,
    by: Sequence[str] | str | None = None,
    loss: L.Loss | None = None,
    learning_rate: float = 0.5,
    name: str = "y_pred",
) -> DataFrame:
    """``df`` with the mean of the predictions weighted by exp(-rate * loss so far).

    Losses are those of the rows before, squared errors by default, taken
    relative to the least so that no weight vanishes.  A null prediction has no
    weight in its row and costs nothing; without any the result is null.
    """
    cost = _losses(predictions, y, loss or L.squared())
    rows = running(df.withColumns(cost), {f"{c}_s": Stat.of("sum", c) for c in cost}, by=by, order=order, lagged=True)
    here = [F.when(F.col(p).isNotNull(), F.col(f"{c}_s")) for p, c in zip(predictions, cost, strict=True)]
    least = F.array_min(F.array(*here))
    over, under = F.lit(0.0), F.lit(0.0)
    for p, c in zip(predictions, here, strict=True):
        w = F.coalesce(F.exp(-learning_rate * (c - least)), F.lit(0.0))
        over, under = over + w * F.coalesce(F.col(p).cast("double"), F.lit(0.0)), under + w
    return rows.withColumn(name, F.try_divide(over, under)).drop(*cost, *[f"{c}_s" for c in cost])


def greedy_selection(
    df: DataFrame,
    predictions: Sequence[str],
    y: str,
    order: Sequence[str] | str,
    by: Sequence[str] | str | None = None,
    loss: L.Loss | None = None,
    name: str = "y_pred",
    model: str = "model",
) -> DataFrame:
    """``df`` with the prediction of the model of the least mean loss over the rows before, and which one it is.

    Absolute errors by default; ties, and the first row, go to the model named
    first.  A model without scored predictions stands behind those with some.
    """
    cost = _losses(predictions, y, loss or L.absolute())
    outs = {f"{c}_s": Stat.of("sum", c) for c in cost}
    flags = {f"{c}_k": F.col(c).isNotNull().cast("double") for c in cost}
    rows = df.withColumns(cost).withColumns(flags)
    rows = running(rows, outs | {f"{c}_n": Stat.of("sum", f"{c}_k") for c in cost}, by=by, order=order, lagged=True)
    means = F.array(*[F.coalesce(F.try_divide(F.col(f"{c}_s"), F.col(f"{c}_n")), F.lit(float("inf"))) for c in cost])
    best = (F.array_position(means, F.array_min(means)) - 1).cast("int")
    out = rows.withColumns({model: F.get(F.array(*[F.lit(p) for p in predictions]), best), name: F.get(F.array(*predictions), best)})
    extra = [f"{c}{s}" for c in cost for s in ("", "_s", "_k", "_n")]
    return out.drop(*extra)


def bags(df: DataFrame, n_models: int, key: str, rate: float = 1.0, seed: int = 0, model: str = "model", weight: str = "weight") -> DataFrame:
    """``df`` once for each model that draws the row, with how often it does: Poisson numbers of the row's key.

    A grouped fit by ``model`` with ``weight`` is a bag of models in one pass.
    """
    if n_models < 1:
        raise ValueError("at least one model")
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_models - 1))).alias(model))
    u = draw(F.col(key).cast("long") * n_models + F.col(model), seed)
    return rows.withColumn(weight, poisson(F.lit(float(rate)), u)).filter(F.col(weight) > 0)


def rank_items(df: DataFrame, user: Sequence[str] | str, item: str, score: str, k: int | None = None, name: str = "rank") -> DataFrame:
    """``df`` with each item's rank for its user by falling score, ties by item; only the first ``k`` if given."""
    place = F.row_number().over(Window.partitionBy(*_as_list(user)).orderBy(F.desc_nulls_last(score), item))
    out = df.withColumn(name, place)
    return out if k is None else out.filter(F.col(name) <= k)
