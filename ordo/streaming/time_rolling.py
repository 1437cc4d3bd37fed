"""Metrics and distributions over a period of a stream, late rows included, as keyed state."""

from __future__ import annotations

import bisect
import math
import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.windows import _as_list

TERMS = {
    "mae": lambda y, p: abs(y - p),
    "mse": lambda y, p: (y - p) ** 2,
    "rmse": lambda y, p: (y - p) ** 2,
    "accuracy": lambda y, p: float(y == p),
}


class Period:
    """Values of the last ``period`` microseconds, in order of time.

    A row later than all before moves the period on and drops what lies
    before it; a late row is put in its place and goes when the period next
    moves on.
    """

    def __init__(self, period: int):
        self.period, self.latest = period, -math.inf
        self.rows: list[tuple[int, object]] = []

    def add(self, t: int, value) -> None:
        bisect.insort_left(self.rows, (t, value), key=lambda r: r[0])
        if t > self.latest:
            self.latest = t
            gone = bisect.bisect_right(self.rows, t - self.period, key=lambda r: r[0])
            del self.rows[:gone]


def _over_stream(sdf: DataFrame, by: Sequence[str], time_col: str, period_us: int, watermark: str, columns: Sequence[str], field: T.StructField, step) -> DataFrame:
    """Every row of the stream with ``step(period, row)`` after it was added; idle keys are forgotten when the watermark has passed their period."""
    keep = list(dict.fromkeys([*by, time_col, *columns]))
    t = "_ordo_t"
    rows = sdf.select(*keep).withColumn(t, F.col(time_col).cast("timestamp")).withWatermark(t, watermark)
    schema = T.StructType([*[sdf.schema[c] for c in keep], field])

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = pickle.loads(state.get[0]) if state.exists else Period(period_us)
        frame = pd.concat(list(parts), ignore_index=True)
        times = frame[t].astype("datetime64[us]").astype("int64").tolist()
        found = [step(held, time, row) for time, row in zip(times, frame[list(columns)].itertuples(index=False), strict=True)]
        state.update((pickle.dumps(held),))
        end = int(held.latest + period_us) // 1000 + 1
        if end > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(end)
        else:
            state.remove()
        yield frame[keep].assign(**{field.name: found})

    return rows.groupBy(*by).applyInPandasWithState(run, schema, "period binary", "append", GroupStateTimeout.EventTimeTimeout)


def time_rolling_metric_stream(
    sdf: DataFrame, metric: str, y_true: str, y_pred: str, by: Sequence[str] | str, time_col: str, period_us: int, watermark: str, name: str | None = None
) -> DataFrame:
    """Every row with the metric over its key's last ``period_us``, rows taken as they come, in append mode.

    A row later than the watermark is dropped by Spark or, if it comes in
    time, counts at its place.  In order of time the values are those of
    ``metrics.time_rolling_metric`` where no two rows share a time.
    """
    term = TERMS[metric]

    def step(held: Period, t: int, row: tuple) -> float:
        y, p = row
        known = y is not None and p is not None and y == y and p == p
        held.add(t, term(y, p) if known else None)
        seen = [v for _, v in held.rows if v is not None]
        mean = math.fsum(seen) / len(seen) if seen else 0.0
        return math.sqrt(mean) if metric == "rmse" else mean

    return _over_stream(sdf, _as_list(by), time_col, period_us, watermark, [y_true, y_pred], T.StructField(name or metric, T.DoubleType()), step)


def time_rolling_share_stream(sdf: DataFrame, x: str, by: Sequence[str] | str, time_col: str, period_us: int, watermark: str, name: str = "share") -> DataFrame:
    """Every row with the share of its value among its key's values of the last ``period_us``, in append mode."""

    def step(held: Period, t: int, row: tuple) -> float | None:
        held.add(t, row[0])
        seen = [v for _, v in held.rows if v is not None]
        return sum(v == row[0] for v in seen) / len(seen) if row[0] is not None and seen else None

    return _over_stream(sdf, _as_list(by), time_col, period_us, watermark, [x], T.StructField(name, T.DoubleType()), step)
