"""Projection and composition: plain column algebra over one plan.

A pipeline is ``DataFrame.transform`` chaining; Catalyst sees one plan and
prunes/pushes through every step.  Feature "dicts" are columns; sparse or
dynamic features are ``map<string,double>`` columns.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def select(df: DataFrame, *keys: str) -> DataFrame:
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise KeyError(missing)
    return df.select(*keys)


def discard(df: DataFrame, *keys: str) -> DataFrame:
    return df.drop(*keys)


def select_type(df: DataFrame, *types: type[T.DataType]) -> DataFrame:
    """Keep columns whose Spark type is one of ``types`` (e.g. NumericType)."""
    return df.select(*[f.name for f in df.schema.fields if isinstance(f.dataType, tuple(types))])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def prefix(df: DataFrame, p: str, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols) if cols is not None else df.columns
    return df.select(*[F.col(c).alias(p + c) if c in cols else F.col(c) for c in df.columns])


def suffix(df: DataFrame, s: str, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols) if cols is not None else df.columns
    return df.select(*[F.col(c).alias(c + s) if c in cols else F.col(c) for c in df.columns])


def func_transform(df: DataFrame, fn: Callable[[DataFrame], Mapping[str, Column]]) -> DataFrame:
    """User function returning new/replaced columns as Column expressions
    (JVM-side).  For opaque Python logic wrap it in a pandas_udf first."""
    return df.withColumns(dict(fn(df)))


def union_features(df: DataFrame, keep: Sequence[str], *steps: Callable[[DataFrame], Mapping[str, Column]]) -> DataFrame:
    """Run several transformers on the same row side by side; on a name clash
    the first transformer's column wins."""
    out: dict[str, Column] = {}
    for step in steps:
        for name, col in step(df).items():
            out.setdefault(name, col)
    return df.select(*keep, *[c.alias(n) for n, c in out.items()])


def product_features(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Cartesian product of two feature groups: ``a*b`` = a·b."""
    return df.withColumns({f"{a}*{b}": F.col(a) * F.col(b) for a in left for b in right})


def pipeline(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df


def grouper_name(by: Sequence[str]) -> Column:
    """Group key as the values joined by ``_``."""
    return F.concat_ws("_", *[F.col(c).cast("string") for c in by])


def polynomial(df: DataFrame, cols: Sequence[str], degree: int = 2, interaction_only: bool = False,
               include_bias: bool = False, bias_name: str = "bias") -> DataFrame:
    """All monomials of degree 1..degree; names are sorted factors joined by ``*``."""
    names = sorted(cols)
    out: dict[str, Column] = {}
    for d in range(1, degree + 1):
        combos = itertools.combinations(names, d) if interaction_only else itertools.combinations_with_replacement(names, d)
        for combo in combos:
            expr = F.lit(1.0)
            for c in combo:
                expr = expr * F.col(c)
            out["*".join(combo)] = expr
    if include_bias:
        out[bias_name] = F.lit(1)
    return df.withColumns(out)


def one_hot_map(df: DataFrame, cols: Sequence[str], name: str = "one_hot") -> DataFrame:
    """Sparse one-hot: map ``{col}_{value}`` -> 1 (array columns set several)."""
    parts = []
    for c in cols:
        dtype = df.schema[c].dataType
        if isinstance(dtype, T.ArrayType):
            parts.append(F.transform(F.col(c), lambda v, c=c: F.concat(F.lit(f"{c}_"), v.cast("string"))))
        else:
            parts.append(F.when(F.col(c).isNotNull(), F.array(F.concat(F.lit(f"{c}_"), F.col(c).cast("string"))))
                         .otherwise(F.array().cast("array<string>")))
    keys = F.array_distinct(F.flatten(F.array(*parts)))
    return df.withColumn(name, F.map_from_arrays(keys, F.transform(keys, lambda _: F.lit(1))))


def categories_of(df: DataFrame, col: str, most: int = 1000) -> list:
    """The values of a column in ascending order; an error if there are more than ``most``."""
    found = [r[0] for r in df.filter(F.col(col).isNotNull()).select(col).distinct().orderBy(col).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} values; use one_hot_map")
    return found


def one_hot_dense(df: DataFrame, col: str, categories: Iterable | None = None, order: Sequence[str] | None = None,
                  by: Sequence[str] | None = None) -> DataFrame:
    """Dense one-hot over a known category list, by default all values of the column.

    With ``order`` the running semantics apply: a category's column is 0 once
    the category has been seen earlier in the stream (per ``by`` key if
    given), NULL (absent) before.  "Seen so far" is a running max of an
    indicator, a mergeable statistic, so the key-less stream is split into
    order blocks rather than run in one task.
    """
    from ..functions.stats import Stat
    from .windows import running

    cats = categories_of(df, col) if categories is None else list(categories)
    if order is None:
        return df.withColumns({f"{col}_{v}": (F.col(col) == F.lit(v)).cast("int") for v in cats})
    ind = {f"_ordo_i_{i}": (F.col(col) == F.lit(v)).cast("double") for i, v in enumerate(cats)}
    d = df.withColumns(ind)
    d = running(d, {f"_ordo_s_{i}": Stat.of("max", f"_ordo_i_{i}") for i in range(len(cats))}, by=by, order=order)
    out = {f"{col}_{v}": F.when(F.col(col) == F.lit(v), F.lit(1)).when(F.col(f"_ordo_s_{i}") > 0, F.lit(0))
           for i, v in enumerate(cats)}
    return d.withColumns(out).drop(*ind, *[f"_ordo_s_{i}" for i in range(len(cats))])


def feature_hash(df: DataFrame, cols: Sequence[str], n_features: int = 1_048_576, seed: int = 0,
                 name: str = "hashed") -> DataFrame:
    """Hashing trick into ``map<long,double>``: numeric features hash their
    name and add their value; strings hash ``name=value`` and add 1;
    colliding features add up.  Uses Spark's xxhash64 (native, no UDF)."""
    entries = []
    for c in cols:
        dtype = df.schema[c].dataType
        if isinstance(dtype, T.StringType):
            key = F.pmod(F.xxhash64(F.concat(F.lit(f"{c}="), F.col(c)), F.lit(seed)), F.lit(n_features))
            val = F.lit(1.0)
        else:
            key = F.pmod(F.xxhash64(F.lit(c), F.lit(seed)), F.lit(n_features))
            val = F.col(c).cast("double")
        entries.append(F.when(F.col(c).isNotNull(), F.struct(key.alias("k"), val.alias("v"))))
    arr = F.array_sort(F.filter(F.array(*entries), lambda e: e.isNotNull()))
    empty = F.array().cast("array<struct<k:bigint,v:double>>")

    def fold(acc, e):
        last = F.try_element_at(acc, F.lit(-1))
        same = (F.size(acc) > 0) & (last["k"] == e["k"])
        merged = F.struct(e["k"].alias("k"), (last["v"] + e["v"]).alias("v"))
        return F.when(same, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(merged))).otherwise(
            F.concat(acc, F.array(e)))

    summed = F.aggregate(arr, empty, fold)
    return df.withColumn(name, F.map_from_entries(summed))


# RBF random features --------------------------------------------------------
# Random draws come from integer arithmetic both Spark and SQL engines share,
# so the features are reproducible and checkable: u(k) = ((A*k + C) mod M)/M.
_LCG_A, _LCG_C, _LCG_M = 1103515245, 12345, 2147483648


def _uniform(k: Column) -> Column:
    return ((F.lit(_LCG_A) * k + F.lit(_LCG_C)) % F.lit(_LCG_M) + F.lit(0.5)) / F.lit(float(_LCG_M))


def rbf_weights(spark, features: Sequence[str], n_components: int, gamma: float = 1.0, seed: int = 0) -> DataFrame:
    """Table (feature, j, w, b): w ~ sqrt(2 gamma)·N(0,1) by Box-Muller, b ~ U(0, 2π)."""
    rows = [(i, f, j) for i, f in enumerate(features) for j in range(n_components)]
    t = spark.createDataFrame(rows, "fi int, feature string, j int")
    k = (F.lit(seed) * 1_000_003 + F.col("fi") * 10_007 + F.col("j")).cast("long")
    u1, u2, u3 = _uniform(3 * k), _uniform(3 * k + 1), _uniform(3 * k + 2)
    normal = F.sqrt(-2.0 * F.log(u1)) * F.cos(2 * math.pi * u2)
    return t.select("feature", "j", (math.sqrt(2 * gamma) * normal).alias("w"), (2 * math.pi * u3).alias("b"))


def rbf_features(df: DataFrame, id_cols: Sequence[str], features: Sequence[str], n_components: int = 100,
                 gamma: float = 1.0, seed: int = 0) -> DataFrame:
    """Long table (ids, feature, j, value = cos(x·w + b)); the weight table has
    n_features x n_components rows, a fixed size, so it is broadcast."""
    w = rbf_weights(df.sparkSession, features, n_components, gamma, seed)
    melted = df.select(*id_cols, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("_f"))
    melted = melted.select(*id_cols, "_f.feature", "_f.x")
    out = melted.join(F.broadcast(w), "feature")
    return out.select(*id_cols, "feature", "j", F.cos(F.col("x") * F.col("w") + F.col("b")).alias("value"))
