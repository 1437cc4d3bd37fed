"""Split merits and Hoeffding trees over all line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.criteria import CRITERIA
from ..operators import tree as TR
from ..queries import Q6, T, q6, query

_NUMERIC, _CLASSES = ["l_quantity", "l_discount", "l_tax"], "ANR"


def _ent(c: str) -> str:
    n = " + ".join(f"{c}{v}" for v in _CLASSES)
    spread = " + ".join(f"CASE WHEN {c}{v} > 0 THEN {c}{v} * log2({c}{v}) ELSE 0 END" for v in _CLASSES)
    return f"(CASE WHEN {n} > 0 THEN (({n}) * log2({n}) - ({spread})) / ({n}) ELSE 0 END)"


def _gini(c: str) -> str:
    n = " + ".join(f"{c}{v}" for v in _CLASSES)
    return f"(CASE WHEN {n} = 0 THEN 1 ELSE 1 - ({' + '.join(f'pow({c}{v} / ({n}), 2)' for v in _CLASSES)}) END)"


def _counts(cond: str, c: str) -> str:
    return ", ".join(f"CAST(count(*) FILTER (WHERE ({cond}) AND l_returnflag = '{v}') AS DOUBLE) AS {c}{v}" for v in _CLASSES)


_SPLITS = " UNION ALL ".join(
    [
        f"SELECT '{f}' AS feature, k, any_value(lo + (hi - lo) / 11.0 * k) AS threshold, {_counts(f'{f} <= lo + (hi - lo) / 11.0 * k', 'lc_')}, {_counts(f'{f} > lo + (hi - lo) / 11.0 * k', 'rc_')} "
        f"FROM lineitem, (SELECT CAST(min({f}) AS DOUBLE) AS lo, CAST(max({f}) AS DOUBLE) AS hi FROM lineitem), (SELECT unnest(range(1, 11)) AS k) GROUP BY k"
        for f in _NUMERIC
    ]
)
_LEFT, _RIGHT = (" + ".join(f"{c}{v}" for v in _CLASSES) for c in ("lc_", "rc_"))
_BOTH = _ent("b")


@query(
    "split_criteria",
    sql=f"""
WITH s AS ({_SPLITS}), t AS (SELECT *, {", ".join(f"lc_{v} + rc_{v} AS b{v}" for v in _CLASSES)}, {_LEFT} AS ln, {_RIGHT} AS rn FROM s)
SELECT feature, {Q6("threshold")} AS threshold, ln AS n_left,
  {Q6(f"1 - (ln / (ln + rn) * {_gini('lc_')} + rn / (ln + rn) * {_gini('rc_')})")} AS gini,
  CASE WHEN ln > 0.01 * (ln + rn) AND rn > 0.01 * (ln + rn) THEN {Q6(f"{_BOTH} - (ln * {_ent('lc_')} + rn * {_ent('rc_')}) / (ln + rn)")} END AS info_gain
FROM t
""",
)
def split_criteria(spark, sf):
    """Gini and information gain of all candidate splits of three features by return flag."""
    li = T(spark, sf, "lineitem")
    hot = F.array(*[(F.col("l_returnflag") == v).cast("double") for v in _CLASSES])
    rows = li.select(F.lit(0).alias(TR.NODE), hot.alias(TR.Y), *_NUMERIC)
    found = TR.candidates(rows, _NUMERIC, [], 3, CRITERIA["info_gain"])
    n_left = F.aggregate("left", F.lit(0.0), lambda a, v: a + v)
    gini = CRITERIA["gini"].merit(F.col("left"), F.col("right"))
    return found.select("feature", q6(F.col("at").cast("double")).alias("threshold"), n_left.alias("n_left"), q6(gini).alias("gini"), q6("merit").alias("info_gain"))


@query(
    "split_variance_reduction",
    sql=f"""
SELECT l_linestatus AS status, count(*)::DOUBLE AS n_left,
  {Q6("(SELECT var_samp(l_extendedprice / 1000) FROM lineitem) - count(*) / (SELECT count(*)::DOUBLE FROM lineitem) * var_samp(l_extendedprice / 1000) - (SELECT count(*)::DOUBLE FROM lineitem o WHERE o.l_linestatus <> l.l_linestatus) / (SELECT count(*)::DOUBLE FROM lineitem) * (SELECT var_samp(l_extendedprice / 1000) FROM lineitem o WHERE o.l_linestatus <> l.l_linestatus)")} AS merit
FROM lineitem l GROUP BY l_linestatus
""",
)
def split_variance_reduction(spark, sf):
    """How much each value of the line status, split off, lowers the variance of the price in thousands."""
    y = F.col("l_extendedprice") / 1000
    rows = T(spark, sf, "lineitem").select(F.lit(0).alias(TR.NODE), F.array(F.lit(1.0), y, y * y).alias(TR.Y), "l_linestatus")
    found = TR.candidates(rows, [], ["l_linestatus"], 3, CRITERIA["variance_reduction"])
    return found.select(F.col("at").alias("status"), F.col("left")[0].alias("n_left"), q6("merit").alias("merit"))


@query("hoeffding_tree_classifier")
def hoeffding_tree_classifier(spark, sf):
    """Class and leaf of every line item from a tree of its quantity, price, discount, tax and status, grown over all of them."""
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_returnflag")
    tree = TR.fit_classifier(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"], "l_returnflag", max_depth=5)
    return TR.predict(li, tree, leaf="leaf").select("l_orderkey", "l_linenumber", "y_pred", "leaf")


@query("hoeffding_tree_regressor")
def hoeffding_tree_regressor(spark, sf):
    """Price of every line item from a tree of its quantity, discount, tax and status."""
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus")
    tree = TR.fit_regressor(li, ["l_quantity", "l_discount", "l_tax", "l_linestatus"], "l_extendedprice", max_depth=5)
    return TR.predict(li, tree).select("l_orderkey", "l_linenumber", q6("y_pred").alias("y_pred"))
