"""Counting learners and baseline predictors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import learners as L, text as X
from ..queries import Q6, T, q6, query

_TOK = f"regexp_extract_all(lower(text), '{TX.TOKEN_PATTERN}')"


_FOLDS = 3
_COUNTS = f"""
WITH b AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS n FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY 1, 2),
l AS (SELECT b.*, d.lang AS y, d.doc_id % {_FOLDS} AS fold FROM b JOIN documents d USING (doc_id)),
fs AS (SELECT DISTINCT fold FROM l),
p AS (SELECT fs.fold, term, y, sum(n) AS n, CAST(count(*) AS DOUBLE) AS d FROM l JOIN fs ON fs.fold <> l.fold GROUP BY 1, 2, 3),
t AS (SELECT fold, term, sum(n) AS t FROM p GROUP BY 1, 2),
z AS (SELECT fold, count(*) AS v, sum(t) AS t FROM t GROUP BY 1),
c AS (SELECT fs.fold, lang AS y, CAST(count(*) AS DOUBLE) AS docs FROM documents d JOIN fs ON fs.fold <> d.doc_id % {_FOLDS} GROUP BY 1, 2),
k AS (SELECT c.*, ln(docs / sum(docs) OVER (PARTITION BY c.fold)) AS prior, z.v, z.t, (SELECT sum(n) FROM p WHERE p.fold = c.fold AND p.y = c.y) AS n_c FROM c JOIN z USING (fold))"""
_BEST = f"""
SELECT doc_id, arg_max(y, score) AS y_pred, {Q6("max(score)")} AS score,
  {Q6("1 / sum(exp(score - top))")} AS proba FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM s) GROUP BY doc_id"""
_NB_SQL = {
    "multinomial": """,
s AS (SELECT l.doc_id, k.y, any_value(prior) + sum(l.n * ln((coalesce(p.n, 0) + 1) / (k.n_c + k.v))) AS score
      FROM l JOIN k ON k.fold = l.fold LEFT JOIN p ON p.fold = l.fold AND p.term = l.term AND p.y = k.y GROUP BY 1, 2)""",
    "bernoulli": """,
g AS (SELECT t.fold, t.term, k.y, (coalesce(p.d, 0) + 1) / (k.docs + 2) AS q FROM t JOIN k ON k.fold = t.fold
      LEFT JOIN p ON p.fold = t.fold AND p.term = t.term AND p.y = k.y),
a AS (SELECT fold, y, sum(ln(1e-9 + (1 - q))) AS absent FROM g GROUP BY 1, 2),
w AS (SELECT l.doc_id, g.y, sum(ln(1e-9 + q) - ln(1e-9 + (1 - q))) AS won FROM l JOIN g ON g.fold = l.fold AND g.term = l.term GROUP BY 1, 2),
s AS (SELECT d.doc_id, k.y, k.prior + a.absent + coalesce(won, 0) AS score FROM (SELECT DISTINCT doc_id, fold FROM l) d JOIN k ON k.fold = d.fold
      JOIN a ON a.fold = k.fold AND a.y = k.y LEFT JOIN w ON w.doc_id = d.doc_id AND w.y = k.y)""",
    "complement": """,
s AS (SELECT l.doc_id, k.y, sum(-l.n * ln((coalesce(t.t, 0) - coalesce(p.n, 0) + 1) / (k.t + k.v - k.n_c))) AS score
      FROM l JOIN k ON k.fold = l.fold LEFT JOIN t ON t.fold = l.fold AND t.term = l.term
      LEFT JOIN p ON p.fold = l.fold AND p.term = l.term AND p.y = k.y GROUP BY 1, 2)""",
}


def _naive_bayes(spark, sf, kind):
    docs = T(spark, sf, "documents").select("doc_id", "text", "lang", (F.col("doc_id") % _FOLDS).alias("fold"))
    bow = X.bag_of_words(docs, "doc_id", "text")
    pred = L.naive_bayes(bow, docs, "doc_id", "lang", kind, fold="fold")
    return pred.select("doc_id", "y_pred", q6("score").alias("score"), q6("proba").alias("proba"))


@query("naive_bayes_multinomial", headline=True, sql=_COUNTS + _NB_SQL["multinomial"] + _BEST)
def naive_bayes_multinomial(spark, sf):
    """Language of every document by multinomial naive Bayes over all terms, fitted on the other two thirds of the documents."""
    return _naive_bayes(spark, sf, "multinomial")


@query("naive_bayes_bernoulli", sql=_COUNTS + _NB_SQL["bernoulli"] + _BEST)
def naive_bayes_bernoulli(spark, sf):
    """The same with terms that are there or not."""
    return _naive_bayes(spark, sf, "bernoulli")


@query("naive_bayes_complement", sql=_COUNTS + _NB_SQL["complement"] + _BEST)
def naive_bayes_complement(spark, sf):
    """The same from the counts of all other classes."""
    return _naive_bayes(spark, sf, "complement")


@query(
    "baseline_predictors",
    sql="""
SELECT o_orderkey, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS last_status
FROM orders
""",
)
def baseline_predictors(spark, sf):
    """No-change classifier: each customer's previous order status."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    out = L.no_change(o, "o_orderstatus", "o_custkey", ["o_orderdate", "o_orderkey"], name="last_status")
    return out.select("o_orderkey", "last_status")
