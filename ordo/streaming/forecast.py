"""Forecasts over a stream: the batch models as keyed state."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.forecast import scan
from ..operators.windows import _as_list


def forecast_stream(
    sdf: DataFrame,
    make: Callable,
    y: str,
    series: Sequence[str] | str,
    order: Sequence[str] | str,
    horizon: int = 1,
    features: Sequence[str] = (),
    name: str = "forecast",
) -> DataFrame:
    """Forecasts made before every row of a stream, in append mode.

    Rows of a series are taken in order within a trigger, triggers as they
    come; its state is its model.  Fed the same rows in order, the forecasts
    equal those of the batch form.
    """
    series, order, features = _as_list(series), _as_list(order), list(features)
    keep = list(dict.fromkeys([*series, *order, y, *features]))
    schema = T.StructType([*[sdf.schema[c] for c in keep], T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        model = pickle.loads(state.get[0]) if state.exists else make()
        rows = pd.concat(list(parts)).sort_values(order, kind="stable", ignore_index=True)
        found = scan(model, rows, y, horizon, features)
        state.update((pickle.dumps(model),))
        yield rows[keep].assign(**{name: pd.Series(found, dtype=object)})

    return sdf.select(*keep).groupBy(*series).applyInPandasWithState(run, schema, "model binary", "append", GroupStateTimeout.NoTimeout)
