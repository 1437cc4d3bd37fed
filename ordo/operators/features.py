"""Keyed feature aggregates computed as of every row.

``agg`` is the unsupervised form: the statistic of ``on`` within its group,
including the current row.  ``target_agg`` is the supervised form over the
target: it only sees rows strictly before the current one, so a feature
never leaks its own label.  ``agg_state`` / ``target_agg_state`` return the
final per-group table (what a model would hold after the whole stream).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.stats import Stat
from .windows import _as_list, grouped, running


def feature_name(on: str, how: str, by: Sequence[str]) -> str:
    by = _as_list(by)
    if not by:
        return f"{on}_{how}"
    return f"{on}_{how}_by_{'_and_'.join(by)}"


def agg(
    df: DataFrame,
    on: str,
    how: str,
    by: Sequence[str] | str | None,
    order: Sequence[str] | str,
    name: str | None = None,
    **params,
) -> DataFrame:
    """Running statistic of ``on`` per group, current row included."""
    by = _as_list(by)
    out = name or feature_name(on, how, by)
    return running(df, {out: Stat.of(how, on, **params)}, by=by, order=order)


def target_agg(
    df: DataFrame,
    target: str,
    how: str,
    by: Sequence[str] | str | None,
    order: Sequence[str] | str,
    name: str | None = None,
    **params,
) -> DataFrame:
    """Running statistic of the target per group over *earlier* rows only.

    Before a group has any labelled row the statistic's empty value is used
    (0.0 for mean), matching a freshly created aggregate.
    """
    by = _as_list(by)
    out = name or feature_name(target, how, by)
    return running(df, {out: Stat.of(how, target, **params)}, by=by, order=order, lagged=True)


def agg_state(df: DataFrame, on: str, how: str, by: Sequence[str] | str | None, **params) -> DataFrame:
    """Final value per group: one partial+final hash aggregate."""
    by = _as_list(by)
    return grouped(df, {feature_name(on, how, by): Stat.of(how, on, **params)}, by=by)
