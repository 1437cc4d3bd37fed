"""Forecasts of many series: Holt-Winters smoothing and autoregression with seasonal lags.

A series is a recurrence, so its rows pass through one task in order, but not
together: rows are dealt by series, sorted within tasks, and read batch by
batch with one small state at a time.  ``streaming.forecast`` keeps the same
states in a stream.

A forecast belongs to the row that it is made before: with the values up to
the row's own excluded, ``yhat`` for horizon h is set against the value h rows
after it (``evaluate.horizon_eval``).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import _as_list


class HoltWinters:
    """Smoothed level, trend and season of one series, with additive or multiplicative seasons.

    The first ``max(2, seasonality)`` values start the parts: their mean, their
    mean step, and each value's share of the mean.  Without ``beta`` the trend
    stays 0, without ``seasonality`` there is no season.
    """

    def __init__(self, alpha: float, beta: float | None = None, gamma: float | None = None, seasonality: int = 0, multiplicative: bool = False):
        self.alpha, self.beta, self.gamma = alpha, beta or 0.0, gamma or 0.0
        self.seasonality, self.multiplicative = seasonality, multiplicative
        self.with_trend = beta is not None
        self.first: list[float] = []
        self.level = self.trend = 0.0
        self.season: deque[float] = deque(maxlen=max(seasonality, 1))  # the oldest comes next
        self.ready = False

    def learn(self, y: float, x: Sequence[float] = ()) -> None:
        if not self.ready:
            self.first.append(y)
            n = len(self.first)
            if n < max(2, self.seasonality):
                return
            self.level = sum(self.first) / n
            self.trend = (self.first[-1] - self.first[0]) / (n - 1) if self.with_trend else 0.0
            if self.seasonality:
                self.season.extend(v / self.level if self.level else 0.0 for v in self.first)
            self.ready, self.first = True, []
            return
        level, trend = self.level, self.trend
        seasonal = self.season[0] if self.seasonality else (1.0 if self.multiplicative else 0.0)
        if self.multiplicative:
            own = y / seasonal if seasonal else 0.0
        else:
            own = y - seasonal
        self.level = self.alpha * own + (1 - self.alpha) * (level + trend)
        self.trend = self.beta * (self.level - level) + (1 - self.beta) * trend if self.with_trend else 0.0
        if self.seasonality:
            base = level + trend
            share = (y / base if base else 0.0) if self.multiplicative else y - base
            self.season.append(self.gamma * share + (1 - self.gamma) * seasonal)

    def forecast(self, horizon: int, xs: Sequence[Sequence[float]] = ()) -> list[float] | None:
        if not self.ready:
            return None
        out = []
        for h in range(horizon):
            value = self.level + (h + 1) * self.trend
            if self.seasonality:
                part = self.season[h % self.seasonality]
                value = value * part if self.multiplicative else value + part
            out.append(value)
        return out


def lag_weights(d: int, m: int = 1) -> dict[int, int]:
    """Weight of the value ``lag`` rows back in ``(1 - B ** m) ** d``, without lag 0."""
    weights = {0: 1}
    for _ in range(d):
        shifted = {lag + m: -w for lag, w in weights.items()}
        weights = {lag: weights.get(lag, 0) + shifted.get(lag, 0) for lag in weights | shifted}
    return {lag: w for lag, w in weights.items() if lag and w}


class Snarimax:
    """Seasonal autoregression on differences, past errors and outside features, fitted value by value.

    Features are lags of the differenced series and of the errors, and whatever
    ``x`` a row brings; each is standardised by the running mean and variance
    of all that was asked or learnt, and a linear model moves against the
    gradient of its squared error.
    Seasonal lags are ``m, 2 m, ...`` up to ``(m - 1) * order``.  Both kinds of
    differences take steps of one row, as published.
    """

    def __init__(self, p: int, d: int, q: int, m: int = 1, sp: int = 0, sd: int = 0, sq: int = 0, lr: float = 0.01, intercept_lr: float = 0.01, intercept: float = 0.0):
        self.back = lag_weights(d + sd)
        self.y_lags = [*range(p), *range(m - 1, (m - 1) * sp, m)]
        self.e_lags = [*range(q), *range(m - 1, (m - 1) * sq, m)]
        self.y_names = [*(f"y{t}" for t in range(p)), *(f"sy{t}" for t in range(m - 1, (m - 1) * sp, m))]
        self.e_names = [*(f"e{t}" for t in range(q)), *(f"se{t}" for t in range(m - 1, (m - 1) * sq, m))]
        self.ys: deque[float] = deque(maxlen=max(p, m * sp))
        self.errors: deque[float] = deque(maxlen=max(p, m * sq))
        self.lr, self.intercept_lr, self.intercept = lr, intercept_lr, intercept
        self.weights: dict[str, float] = {}
        self.scale: dict[str, tuple[int, float, float]] = {}

    def _features(self, x: Sequence[float], ys: Sequence[float], errors: Sequence[float]) -> dict[str, float]:
        out = {f"x{i}": float(v) for i, v in enumerate(x)}
        out |= {n: ys[t] for n, t in zip(self.y_names, self.y_lags, strict=True) if t < len(ys)}
        return out | {n: errors[t] for n, t in zip(self.e_names, self.e_lags, strict=True) if t < len(errors)}

    def _scaled(self, features: dict[str, float]) -> dict[str, float]:
        out = {}
        for name, v in features.items():
            _, mean, var = self.scale.get(name, (0, 0.0, 0.0))
            out[name] = (v - mean) / var**0.5 if var else 0.0
        return out

    def _seen(self, features: dict[str, float]) -> None:
        for name, v in features.items():
            n, mean, var = self.scale.get(name, (0, 0.0, 0.0))
            new = mean + (v - mean) / (n + 1)
            self.scale[name] = (n + 1, new, var + ((v - mean) * (v - new) - var) / (n + 1))

    def _predict(self, scaled: dict[str, float]) -> float:
        return self.intercept + sum(self.weights.get(n, 0.0) * v for n, v in scaled.items())

    def _change(self, ys: Sequence[float]) -> float:
        return sum(w * ys[lag - 1] for lag, w in self.back.items() if lag <= len(ys))

    def learn(self, y: float, x: Sequence[float] = ()) -> None:
        target = y + self._change(self.ys)
        features = self._features(x, self.ys, self.errors)
        self._seen(features)
        scaled = self._scaled(features)
        guess = self._predict(scaled)
        slope = 2.0 * (guess - target)
        self.intercept -= self.intercept_lr * slope
        for n, v in scaled.items():
            self.weights[n] = self.weights.get(n, 0.0) - self.lr * slope * v
        self.ys.appendleft(target)
        self.errors.appendleft(target - guess)

    def forecast(self, horizon: int, xs: Sequence[Sequence[float]] = ()) -> list[float]:
        ys, errors = deque(self.ys, self.ys.maxlen), deque(self.errors, self.errors.maxlen)
        out = []
        for h in range(horizon):
            features = self._features(xs[h] if h < len(xs) else (), ys, errors)
            self._seen(features)
            guess = self._predict(self._scaled(features))
            out.append(guess - self._change(ys))
            ys.appendleft(guess)
            errors.appendleft(0.0)
        return out


def scan(model, frame: pd.DataFrame, y: str, horizon: int, features: Sequence[str] = ()) -> list[list[float] | None]:
    """A forecast before each row, which the model then learns; a row without a value is not learnt from.

    Outside features are those of the row itself, for all horizons.
    """
    out = []
    values = frame[y].tolist()
    inputs = frame[list(features)].to_numpy(dtype=float).tolist() if features else [()] * len(values)
    for value, x in zip(values, inputs, strict=True):
        out.append(model.forecast(horizon, [x] * horizon if features else ()))
        if value is not None and value == value:
            model.learn(float(value), x)
    return out


def forecast(
    df: DataFrame,
    make: Callable[[], HoltWinters | Snarimax],
    y: str,
    series: Sequence[str] | str,
    order: Sequence[str] | str,
    horizon: int = 1,
    features: Sequence[str] = (),
    name: str = "forecast",
) -> DataFrame:
    """``df`` with an array of ``horizon`` forecasts made before each row, null while the model is not ready.

    ``make`` gives a fresh model for each series.  Rows with a null or NaN
    value get a forecast and leave the model as it is.
    """
    series, order, features = _as_list(series), _as_list(order), _as_list(list(features))
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    rows = df.repartition(*series).sortWithinPartitions(*series, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, model = None, None
        for frame in batches:
            if not len(frame):
                continue
            keys = list(zip(*(frame[c].where(frame[c].notna(), None).tolist() for c in series), strict=True)) if series else [()] * len(frame)
            starts = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
            found = []
            for a, z in zip(starts[:-1], starts[1:], strict=True):
                if model is None or keys[a] != held:
                    held, model = keys[a], make()
                found += scan(model, frame.iloc[a:z], y, horizon, features)
            yield frame.assign(**{name: pd.Series(found, index=frame.index, dtype=object)})

    return rows.mapInPandas(run, schema)


def long_form(df: DataFrame, name: str = "forecast") -> DataFrame:
    """One row for each horizon: ``h`` from 1 and ``yhat``."""
    out = df.select("*", F.posexplode(name).alias("h", "yhat")).drop(name)
    return out.withColumn("h", F.col("h") + 1)
