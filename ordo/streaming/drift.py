"""Drift detectors over a stream: the batch detectors as keyed state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.drift import DETECTORS, FLAGS, with_flags
from ..operators.windows import _as_list


def detect_drift_stream(sdf: DataFrame, value: str, by: Sequence[str] | str, order: Sequence[str] | str,
                        detector: str = "page_hinkley", **params) -> DataFrame:
    """Flags of every row of a stream, in append mode.

    Rows of one key are taken in order within a trigger, triggers as they come.
    The state of a key is its detector: a few numbers (ADWIN: O(log rows)
    buckets, KSWIN: one window).  Fed the same rows in order, the flags equal
    those of the batch form.
    """
    by, order = _as_list(by), _as_list(order)
    cls = DETECTORS[detector]
    keep = [*by, *[c for c in order if c not in by]]
    schema = T.StructType([sdf.schema[c] for c in keep] + FLAGS)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        det = pickle.loads(state.get[0]) if state.exists else cls(**params)
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        out = with_flags(rows[keep], det.scan(rows[value].to_numpy(dtype=float)))
        state.update((pickle.dumps(det),))
        yield out

    rows = sdf.select(*dict.fromkeys([*keep, value]))
    return rows.groupBy(*by).applyInPandasWithState(run, schema, "detector binary", "append", GroupStateTimeout.NoTimeout)
