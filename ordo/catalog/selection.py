"""Feature selection on lineitem numeric columns."""

from __future__ import annotations

from ..operators import selection as S
from ..queries import Q6, T, q6, query

_F = ["l_quantity", "l_discount", "l_tax"]


@query(
    "variance_threshold",
    sql="SELECT feature, n, " + Q6("var") + " AS var FROM ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, count({f}) AS n, var_samp({f}) AS var FROM lineitem" for f in _F)
    + ") WHERE n < 2 OR coalesce(var, 0.0) > 0.001",
)
def variance_threshold(spark, sf):
    """Keep features whose sample variance exceeds 0.001."""
    li = T(spark, sf, "lineitem").select(*_F)
    out = S.variance_threshold(li, _F, threshold=0.001)
    return out.select("feature", "n", q6("var").alias("var"))


@query(
    "select_k_best",
    sql="SELECT feature, " + Q6("score") + " AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, "
    "feature) AS rank FROM (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CASE WHEN var_pop({f}) > 0 AND var_pop(l_extendedprice) > 0 THEN "
        f"covar_pop({f}, l_extendedprice) / sqrt(var_pop({f}) * var_pop(l_extendedprice)) ELSE 0.0 END AS score "
        "FROM lineitem" for f in _F) + ")) WHERE rank <= 2",
)
def select_k_best(spark, sf):
    """The two features most correlated with the extended price."""
    li = T(spark, sf, "lineitem").select(*_F, "l_extendedprice")
    out = S.select_k_best(li, _F, "l_extendedprice", k=2)
    return out.select("feature", q6("score").alias("score"), "rank")
