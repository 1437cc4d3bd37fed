"""Fitted distributions, Gaussian naive Bayes, differencing, label combinations.

Fits are grouped aggregates (partial and final); densities are expressions
over the joined parameters.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import Stat
from .compose import categories_of
from .windows import _as_list, lagged, time_rolling

MAX_CLASSES = 10_000  # classes times folds up to which a fitted model is sent to all tasks


def gaussian_fit(df: DataFrame, x: str, by=None) -> DataFrame:
    """(by..., n, mu, sigma2): count, mean and sample variance (0 below two values)."""
    by = _as_list(by)
    return df.groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mu"), F.coalesce(F.nullif(F.var_samp(x), F.lit(float("nan"))), F.lit(0.0)).alias("sigma2")
    )


def gaussian_pdf(x: Column, mu: Column, sigma2: Column) -> Column:
    """Density of a normal distribution; 0 where its variance is 0, null where x is."""
    density = F.exp(-(x - mu) * (x - mu) / (2 * sigma2)) / F.sqrt(2 * math.pi * sigma2)
    return F.when(x.isNull(), F.lit(None)).when(sigma2 > 0, density).otherwise(F.lit(0.0))


def gaussian_density(df: DataFrame, x: str, by, name: str = "pdf") -> DataFrame:
    """Every row's density under the distribution of its key."""
    by = _as_list(by)
    fit = gaussian_fit(df, x, by).withColumnsRenamed({"mu": "_ordo_mu", "sigma2": "_ordo_s2"}).drop("n")
    out = df.join(fit, by)
    return out.withColumn(name, gaussian_pdf(F.col(x), F.col("_ordo_mu"), F.col("_ordo_s2"))).drop("_ordo_mu", "_ordo_s2")


def multinomial_pmf(df: DataFrame, x: str, by=None) -> DataFrame:
    """(by..., x, n, pmf): share of each value among its key's values; null values do not count."""
    by = _as_list(by)
    counts = df.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_ordo_total"))
    both = counts.join(totals, by) if by else counts.crossJoin(totals)  # one row without a key
    return both.withColumn("pmf", F.col("n") / F.col("_ordo_total")).drop("_ordo_total")


def time_rolling_share(df: DataFrame, x: str, period_us: int, time_col: str, by=None, name: str = "share") -> DataFrame:
    """``df`` with the share that each row's value has among the key's values later than ``period_us`` before it.

    Rows of one time see each other; a null value has no share and counts
    nowhere.
    """
    by = _as_list(by)
    rows = df.withColumn("_ordo_one", F.when(F.col(x).isNotNull(), 1.0))
    rows = time_rolling(rows, {"_ordo_all": Stat.of("sum", "_ordo_one")}, period_us, time_col, by)
    rows = time_rolling(rows, {"_ordo_own": Stat.of("sum", "_ordo_one")}, period_us, time_col, [*by, x])
    share = F.when(F.col(x).isNotNull(), F.col("_ordo_own") / F.col("_ordo_all"))
    return rows.withColumn(name, share).drop("_ordo_one", "_ordo_all", "_ordo_own")


def gaussian_nb_fit(df: DataFrame, features: Sequence[str], y: str, fold: str | None = None) -> DataFrame:
    """One row per class: y, n, and (mu, sigma2) of every feature.  Rows without a class do not count.

    With ``fold``, an integer column: one row per class and fold, fitted on the
    rows of all other folds.  Each fold is summed up once; the sums of the
    others are merged in a table of classes times folds.
    """
    known = df.filter(F.col(y).isNotNull())
    if fold is None:
        aggs = [F.count(F.lit(1)).alias("n")]
        for f in features:
            var = F.coalesce(F.nullif(F.var_samp(f), F.lit(float("nan"))), F.lit(0.0))
            aggs.append(F.struct(F.avg(f).alias("mu"), var.alias("sigma2")).alias(f))
        return known.groupBy(y).agg(*aggs)
    folds = categories_of(df, fold)
    parts = [F.count(F.lit(1)).alias("n")]
    for f in features:
        parts.append(F.struct(F.count(f).alias("k"), F.avg(f).alias("m"), (F.var_pop(f) * F.count(f)).alias("q")).alias(f))
    parts = known.groupBy(y, F.col(fold).alias("_ordo_own")).agg(*parts)
    grid = parts.withColumn(fold, F.explode(F.array(*[F.lit(v) for v in folds]))).filter(f"_ordo_own <> {fold}")
    # means of the merged parts first, then the spread of the parts around them
    over = Window.partitionBy(y, fold)
    grid = grid.withColumns({f"_ordo_mu{i}": F.try_divide(F.sum(F.col(f)["k"] * F.col(f)["m"]).over(over), F.sum(F.col(f)["k"]).over(over)) for i, f in enumerate(features)})
    aggs = [F.sum("n").alias("n")]
    for i, f in enumerate(features):
        gap = F.col(f)["m"] - F.col(f"_ordo_mu{i}")
        spread = F.sum(F.col(f)["q"] + F.col(f)["k"] * gap * gap) / (F.sum(F.col(f)["k"]) - 1)
        var = F.when(F.sum(F.col(f)["k"]) > 1, spread).otherwise(0.0)
        aggs.append(F.struct(F.first(f"_ordo_mu{i}").alias("mu"), var.alias("sigma2")).alias(f))
    return grid.groupBy(y, fold).agg(*aggs)


def gaussian_nb_predict(df: DataFrame, model: DataFrame, features: Sequence[str], y: str, fold: str | None = None) -> DataFrame:
    """``df`` with y_pred and score, the greatest joint log-likelihood.

    ln prior + the sum of ln(1e-9 + density) over the features a row has; a
    null feature adds nothing.  The classes (of the row's fold) travel as one
    row; with ``fold``, a row of a fold without a model has no prediction.
    """
    total = F.aggregate("_ordo_classes", F.lit(0).cast("bigint"), lambda acc, c: acc + c["n"])
    keys = [fold] if fold else []
    classes = model.groupBy(*keys).agg(F.collect_list(F.struct(y, "n", *features)).alias("_ordo_classes"))
    classes = classes.withColumn("_ordo_total", total)

    def score(c: Column) -> Column:
        out = F.log(c["n"] / F.col("_ordo_total"))
        for f in features:
            density = gaussian_pdf(F.col(f), c[f]["mu"], c[f]["sigma2"])
            out = out + F.coalesce(F.log(F.lit(1e-9) + density), F.lit(0.0))
        return F.struct(out.alias("score"), c[y].alias("label"))

    best = F.array_max(F.transform("_ordo_classes", score))
    if model.count() <= MAX_CLASSES:
        classes = F.broadcast(classes)
    out = (df.join(classes, fold, "left") if fold else df.crossJoin(classes)).withColumn("_ordo_best", best)
    out = out.withColumns({"y_pred": F.col("_ordo_best.label"), "score": F.col("_ordo_best.score")})
    return out.drop("_ordo_classes", "_ordo_total", "_ordo_best")


def difference_weights(steps: Sequence[tuple[int, int]]) -> dict[int, int]:
    """Weights by lag of the product of (1 - B^m)^d over all (d, m), lag 0 included."""
    weights = {0: 1}
    for d, m in steps:
        for _ in range(d):
            shifted = {lag + m: -w for lag, w in weights.items()}
            weights = {lag: weights.get(lag, 0) + shifted.get(lag, 0) for lag in weights | shifted}
    return {lag: w for lag, w in sorted(weights.items()) if w}


def difference(df: DataFrame, y: str, by, order, steps: Sequence[tuple[int, int]] = ((1, 1),), name: str | None = None) -> DataFrame:
    """Differences of a series, for (order d, season m) steps; lags before the start are skipped."""
    weights = difference_weights(steps)
    back = {f"_ordo_lag{lag}": (F.col(y), lag, None) for lag in weights if lag}
    out = F.lit(0.0)
    for lag, weight in weights.items():
        out = out + (F.coalesce(f"_ordo_lag{lag}", F.lit(0.0)) if lag else F.col(y)) * F.lit(float(weight))
    return lagged(df, back, by, order).withColumn(name or f"{y}_diff", out).drop(*back)


def label_powerset(df: DataFrame, labels: Sequence[str], name: str = "combination") -> tuple[DataFrame, DataFrame]:
    """(``df`` with a class number per combination of labels, the combinations with their numbers).

    The combinations are numbered from 0 in the order of the label columns;
    null is a value of its own, before all others.
    """
    # at most as many rows as label combinations occur
    found = df.select(*labels).distinct()
    codes = found.withColumn(name, F.row_number().over(Window.orderBy(*[F.col(c).asc_nulls_first() for c in labels])) - 1)
    renamed = codes.select(*[F.col(c).alias(f"_ordo_{c}") for c in labels], name)
    same = None
    for c in labels:
        one = F.col(c).eqNullSafe(F.col(f"_ordo_{c}"))
        same = one if same is None else same & one
    return df.join(renamed, same).drop(*[f"_ordo_{c}" for c in labels]), codes
