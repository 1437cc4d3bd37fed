"""Classification, regression, clustering and score-curve metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, metrics as M
from ..queries import Q6, T, q6, query

# multi-class task on lineitem: y = return flag, prediction = rule on quantity
_PRED_SQL = "CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END"


def _li_pred(spark, sf):
    li = T(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_linestatus")
    pred = F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "N").otherwise("R")
    return li.withColumn("pred", pred)


_CT = f"""
cm AS (SELECT l_returnflag AS t, {_PRED_SQL} AS p, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2),
r AS (SELECT t AS cls, sum(w) AS row_sum, sum(CASE WHEN t = p THEN w ELSE 0 END) AS tp FROM cm GROUP BY 1),
c AS (SELECT p AS cls, sum(w) AS col_sum FROM cm GROUP BY 1),
ct0 AS (SELECT coalesce(r.cls, c.cls) AS cls, coalesce(row_sum, 0.0) AS row_sum, coalesce(col_sum, 0.0) AS col_sum,
               coalesce(tp, 0.0) AS tp FROM r FULL OUTER JOIN c ON r.cls = c.cls),
ct AS (SELECT *, col_sum - tp AS fp, row_sum - tp AS fn,
         CASE WHEN col_sum > 0 THEN tp / col_sum ELSE 0.0 END AS prec,
         CASE WHEN row_sum > 0 THEN tp / row_sum ELSE 0.0 END AS rec
       FROM ct0 WHERE row_sum <> 0 OR col_sum <> 0),
ct2 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1,
          CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0.0 END AS jac FROM ct),
a AS (SELECT sum(row_sum) AS total, sum(tp) AS tp, count(*) AS k, sum(col_sum) AS pred_total,
        sum(prec) AS sp, sum(rec) AS sr, sum(f1) AS sf, sum(jac) AS sj,
        sum(row_sum * prec) AS wp, sum(row_sum * rec) AS wr, sum(row_sum * f1) AS wf, sum(row_sum * jac) AS wj,
        sum(fp) AS fp, sum(fn) AS fn, min(rec) AS min_r, sum(CASE WHEN rec > 0 THEN ln(rec) END) AS lnr,
        sum(row_sum * col_sum) AS pe_num FROM ct2)
"""

_MC_COLS = {
    "accuracy": "tp / total",
    "balanced_accuracy": "sr / k",
    "macro_precision": "sp / k",
    "micro_precision": "tp / pred_total",
    "weighted_precision": "wp / total",
    "macro_recall": "sr / k",
    "micro_recall": "tp / pred_total",
    "weighted_recall": "wr / total",
    "macro_fbeta": "sf / k",
    "micro_fbeta": "CASE WHEN tp > 0 THEN 2 * (tp / pred_total) * (tp / pred_total) / (2 * tp / pred_total) ELSE 0.0 END",
    "weighted_fbeta": "wf / total",
    "macro_jaccard": "sj / k",
    "micro_jaccard": "tp / (tp + fp + fn)",
    "weighted_jaccard": "wj / total",
    "geometric_mean": "CASE WHEN min_r > 0 THEN exp(lnr / k) ELSE 0.0 END",
    "cohen_kappa": "(tp / total - pe_num / (total * total)) / (1 - pe_num / (total * total))",
}


@query(
    "multiclass_metrics",
    headline=True,
    sql=f"WITH {_CT} SELECT " + ", ".join(f"{Q6(e)} AS {n}" for n, e in _MC_COLS.items()) + " FROM a",
)
def multiclass_metrics(spark, sf):
    """Accuracy, balanced accuracy, macro/micro/weighted P/R/F1/Jaccard, G-mean, kappa."""
    out = M.multiclass_metrics(_li_pred(spark, sf), "l_returnflag", "pred")
    return out.select(*[q6(c).alias(c) for c in _MC_COLS])


@query(
    "classification_report",
    sql=f"WITH {_CT} SELECT cls, row_sum AS support, {Q6('prec')} AS precision, {Q6('rec')} AS recall, "
    f"{Q6('f1')} AS fbeta, {Q6('jac')} AS jaccard FROM ct2",
)
def classification_report(spark, sf):
    """Per-class precision / recall / F1 / Jaccard / support."""
    li = _li_pred(spark, sf)
    ct = M.per_class(M.class_table(M.confusion_matrix(li, "l_returnflag", "pred")))
    return ct.select("cls", F.col("row_sum").alias("support"), *[q6(c).alias(c) for c in
                                                                  ("precision", "recall", "fbeta", "jaccard")])


@query(
    "confusion_matrix_by_status",
    sql=f"SELECT l_linestatus, l_returnflag AS y_true, {_PRED_SQL} AS y_pred, count(*)::DOUBLE AS w, count(*) AS n "
    "FROM lineitem GROUP BY ALL",
)
def confusion_matrix_by_status(spark, sf):
    return M.confusion_matrix(_li_pred(spark, sf), "l_returnflag", "pred", by="l_linestatus")


_BIN = """(SELECT d.doc_id, l.quality, d.n_chars / (d.n_chars + 3000.0) AS score,
          CASE WHEN d.n_chars / (d.n_chars + 3000.0) > 0.5 THEN 1 ELSE 0 END AS pred
   FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _binary(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", "n_chars")
    lab = T(spark, sf, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id")
    score = F.col("n_chars") / (F.col("n_chars") + 3000.0)
    return j.withColumn("score", score).withColumn("pred", (score > 0.5).cast("int"))


@query(
    "binary_metrics",
    sql=f"""
WITH b AS {_BIN},
c AS (SELECT sum(CASE WHEN quality = 1 AND pred = 1 THEN 1.0 ELSE 0.0 END) AS tp,
             sum(CASE WHEN quality <> 1 AND pred = 1 THEN 1.0 ELSE 0.0 END) AS fp,
             sum(CASE WHEN quality = 1 AND pred <> 1 THEN 1.0 ELSE 0.0 END) AS fn,
             sum(CASE WHEN quality = pred THEN 1.0 ELSE 0.0 END) AS diag FROM b),
d AS (SELECT *, diag - tp AS tn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM c),
e AS (SELECT *, tp + tn + fp + fn AS nn FROM d)
SELECT {Q6("p")} AS precision, {Q6("r")} AS recall,
  {Q6("CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END")} AS fbeta,
  {Q6("CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0.0 END")} AS jaccard,
  {Q6("CASE WHEN ((tp + fp) / nn) * ((tp + fn) / nn) * (1 - (tp + fn) / nn) * (1 - (tp + fp) / nn) > 0 THEN "
      "(tp / nn - ((tp + fn) / nn) * ((tp + fp) / nn)) / sqrt(((tp + fp) / nn) * ((tp + fn) / nn) * "
      "(1 - (tp + fn) / nn) * (1 - (tp + fp) / nn)) ELSE 0.0 END")} AS mcc
FROM e
""",
)
def binary_metrics(spark, sf):
    """Binary P/R/F1/Jaccard/MCC: document quality vs a length rule."""
    out = M.binary_metrics(_binary(spark, sf), "quality", "pred", pos_val="1")
    return out.select(*[q6(c).alias(c) for c in ("precision", "recall", "fbeta", "jaccard", "mcc")])


@query(
    "score_curves",
    headline=True,
    sql=f"""
WITH b AS {_BIN},
g AS (SELECT score AS thr, count(*) FILTER (WHERE quality = 1)::DOUBLE AS pos,
             count(*) FILTER (WHERE quality <> 1)::DOUBLE AS neg FROM b GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY thr DESC ROWS UNBOUNDED PRECEDING) AS tps,
             sum(neg) OVER (ORDER BY thr DESC ROWS UNBOUNDED PRECEDING) AS fps,
             sum(pos) OVER () AS P, sum(neg) OVER () AS Nn FROM g),
d AS (SELECT *, CASE WHEN tps + fps > 0 THEN tps / (tps + fps) ELSE 0.0 END AS prec,
             CASE WHEN (tps - pos) + (fps - neg) > 0 THEN (tps - pos) / ((tps - pos) + (fps - neg)) ELSE 1.0 END AS pprec,
             tps / P AS rec, (tps - pos) / P AS prec_rec FROM c),
e AS (SELECT *, (rec - prec_rec) * (prec + pprec) / 2 AS pr_t, (fps / Nn - (fps - neg) / Nn) * (rec + prec_rec) / 2 AS roc_t,
             CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM d),
best AS (SELECT f1, prec, rec, thr FROM e ORDER BY f1 DESC, thr ASC LIMIT 1)
SELECT {Q6("(SELECT sum(pr_t) FROM e)")} AS pr_auc, {Q6("(SELECT sum(roc_t) FROM e)")} AS roc_auc,
  {Q6("best.f1")} AS max_f1, {Q6("best.prec")} AS max_f1_precision, {Q6("best.rec")} AS max_f1_recall,
  {Q6("best.thr")} AS max_f1_threshold
FROM best
""",
)
def score_curves(spark, sf):
    """Exact PR-AUC, ROC-AUC and max F1 (with its precision, recall, threshold)."""
    out = M.curve_metrics(_binary(spark, sf), "quality", "score")
    return out.select(*[q6(c).alias(c) for c in out.columns])


@query(
    "roc_auc_binned_logloss",
    sql=f"""
WITH b AS {_BIN},
t AS (SELECT i, CASE WHEN i = 0 THEN -1e-7 WHEN i = 9 THEN 1.0 + 1e-7 ELSE i / 9.0 END AS th FROM range(10) r(i)),
c AS (SELECT t.i, count(*) FILTER (WHERE quality = 1 AND score > th)::DOUBLE AS tp,
        count(*) FILTER (WHERE quality <> 1 AND score > th)::DOUBLE AS fp,
        count(*) FILTER (WHERE quality = 1 AND NOT score > th)::DOUBLE AS fn,
        count(*) FILTER (WHERE quality <> 1 AND NOT score > th)::DOUBLE AS tn
      FROM t, b GROUP BY t.i),
r AS (SELECT i, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS tpr,
        CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END AS fpr FROM c),
s AS (SELECT i, (fpr - lag(fpr) OVER (ORDER BY i)) * (tpr + lag(tpr) OVER (ORDER BY i)) / 2 AS term FROM r)
SELECT {Q6("-(SELECT sum(term) FROM s)")} AS roc_auc,
  {Q6("(SELECT avg(CASE WHEN quality = 1 THEN -ln(least(greatest(score, 1e-15), 1 - 1e-15)) "
      "ELSE -ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)) END) FROM b)")} AS log_loss
""",
)
def roc_auc_binned_logloss(spark, sf):
    """Ten-threshold ROC AUC and binary log loss of the length score."""
    b = _binary(spark, sf)
    roc = M.roc_auc_binned(b, "quality", "score", n_thresholds=10).withColumn("_k", F.lit(0))
    ll = M.log_loss(b, "quality", "score").withColumn("_k", F.lit(0))
    return roc.join(ll, "_k").select(q6("roc_auc").alias("roc_auc"), q6("log_loss").alias("log_loss"))


@query(
    "regression_metrics",
    sql=f"""
WITH p AS (SELECT o_totalprice / 1000.0 AS y,
             coalesce(avg(o_totalprice / 1000.0) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS yhat FROM orders)
SELECT {Q6("avg(abs(y - yhat))")} AS mae, {Q6("avg((y - yhat) * (y - yhat))")} AS mse,
  {Q6("sqrt(avg((y - yhat) * (y - yhat)))")} AS rmse,
  {Q6("sqrt(avg(pow(ln(1 + y) - ln(1 + yhat), 2)))")} AS rmsle,
  {Q6("100 * avg(CASE WHEN abs(y) + abs(yhat) = 0 THEN 0.0 ELSE 2.0 * abs(y - yhat) / (abs(y) + abs(yhat)) END)")} AS smape,
  {Q6("1 - sum((y - yhat) * (y - yhat)) / ((count(y) - 1) * var_samp(y))")} AS r2
FROM p
""",
)
def regression_metrics(spark, sf):
    """Prequential regression scores of the lagged per-customer mean forecaster."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                      (F.col("o_totalprice") / 1000.0).alias("y"))
    o = features.target_agg(o, "y", "mean", "o_custkey", ["o_orderdate", "o_orderkey"], name="yhat")
    out = M.regression_metrics(o, "y", "yhat")
    return out.select(*[q6(c).alias(c) for c in ("mae", "mse", "rmse", "rmsle", "smape", "r2")])


_CL_PRED = "list_position(embedding, list_max(embedding))"


@query(
    "clustering_metrics",
    sql=f"""
WITH cm AS (SELECT CAST(label AS VARCHAR) AS t, CAST({_CL_PRED} AS VARCHAR) AS p, count(*)::DOUBLE AS nij
            FROM embeddings GROUP BY 1, 2),
r AS (SELECT t, sum(nij) AS a FROM cm GROUP BY t), c AS (SELECT p, sum(nij) AS b FROM cm GROUP BY p),
cells AS (SELECT cm.*, r.a, c.b FROM cm JOIN r USING (t) JOIN c USING (p)),
tot AS (SELECT (SELECT sum(a) FROM r) AS N, (SELECT sum(a * a) FROM r) AS sa2, (SELECT sum(a * ln(a)) FROM r) AS alna,
          (SELECT count(*) FROM r) AS kc, (SELECT sum(b * b) FROM c) AS sb2, (SELECT sum(b * ln(b)) FROM c) AS blnb,
          (SELECT count(*) FROM c) AS kk),
ca AS (SELECT sum(nij * nij) AS s2, sum(nij * b) AS fp_raw, sum(nij * a) AS fn_raw,
          sum(nij * (ln(nij) - ln(a * b))) AS mi_raw, sum(nij * ln(nij)) AS nlnn FROM cells),
x AS (SELECT *, s2 - N AS tp, fp_raw - s2 AS fp, fn_raw - s2 AS fn, mi_raw / N + ln(N) AS mi,
        ln(N) - alna / N AS ht, ln(N) - blnb / N AS hp, ln(N) - nlnn / N AS hj FROM ca, tot),
y AS (SELECT *, N * N - (fp + fn) - s2 AS tn,
        CASE WHEN ht = 0 THEN 1.0 ELSE 1 - (hj - hp) / ht END AS hom,
        CASE WHEN hp = 0 THEN 1.0 ELSE 1 - (hj - ht) / hp END AS com FROM x)
SELECT {Q6("(tp + tn) / (N * (N - 1))")} AS rand,
  {Q6("2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))")} AS adjusted_rand,
  {Q6("mi")} AS mutual_info,
  {Q6("CASE WHEN kc = 1 AND kk = 1 THEN 1.0 ELSE mi / greatest((ht + hp) / 2, 2.220446049250313e-16) END")}
    AS normalized_mutual_info,
  {Q6("hom")} AS homogeneity, {Q6("com")} AS completeness,
  {Q6("CASE WHEN hom + com > 0 THEN 2 * hom * com / (hom + com) ELSE 0.0 END")} AS v_measure,
  {Q6("sqrt(tp / (sa2 - N)) * sqrt(tp / (sb2 - N))")} AS fowlkes_mallows
FROM y
""",
)
def clustering_metrics(spark, sf):
    """Rand / ARI / MI / NMI / homogeneity / completeness / V / Fowlkes-Mallows of the greatest component as a cluster."""
    e = T(spark, sf, "embeddings").select("label", "embedding")
    pred = F.array_position("embedding", F.array_max("embedding"))
    out = M.clustering_metrics(e.withColumn("pred", pred), "label", "pred")
    return out.select(*[q6(c).alias(c) for c in out.columns])


@query(
    "running_rolling_accuracy",
    sql=f"""
WITH p AS (SELECT *, CASE WHEN l_returnflag = {_PRED_SQL} THEN 1.0 ELSE 0.0 END AS ok FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax,
  {Q6("avg(ok) OVER (PARTITION BY l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, "
      "l_quantity, l_extendedprice, l_discount, l_tax ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")} AS accuracy,
  {Q6("avg(ok) OVER (PARTITION BY l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, "
      "l_quantity, l_extendedprice, l_discount, l_tax ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")} AS rolling_accuracy
FROM p
""",
)
def running_rolling_accuracy(spark, sf):
    """Accuracy as of every row and over the last 100 rows, per line status."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax"]
    li = T(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", *order)
    li = li.withColumn("pred", F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "N").otherwise("R"))
    li = M.running_metric_counts(li, "l_returnflag", "pred", order, by="l_linestatus")
    li = M.rolling_accuracy(li, "l_returnflag", "pred", order, 100, by="l_linestatus")
    return li.select(*order, q6("accuracy").alias("accuracy"), q6("rolling_accuracy").alias("rolling_accuracy"))


@query(
    "summarise_runs",
    sql=f"""
SELECT o_orderpriority, {Q6("avg(o_totalprice / 1000.0)")} AS price,
  {Q6("stddev_samp(o_totalprice / 1000.0)")} AS price_std FROM orders GROUP BY 1
""",
)
def summarise_runs(spark, sf):
    """Mean and std of a metric column per group (experiment summary)."""
    o = T(spark, sf, "orders").select("o_orderpriority", (F.col("o_totalprice") / 1000.0).alias("price"))
    out = M.summarise_runs(o, ["o_orderpriority"], ["price"])
    return out.select("o_orderpriority", q6("price").alias("price"), q6("price_std").alias("price_std"))
