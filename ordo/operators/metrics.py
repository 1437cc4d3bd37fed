"""Evaluation metrics as aggregates.

Label metrics share one state: the confusion matrix, a partial+final hash
aggregate ``groupBy(y_true, y_pred).sum(w)`` whose size is classes², never
rows.  Every metric is then arithmetic over that matrix, done in Spark on
the tiny table (per ``by`` group when given).  Conventions kept from the
reference semantics: classes are labels with a non-zero row or column sum;
empty per-class terms count as 0 but still divide by the number of classes;
divisions by zero give 0.0 unless stated.

Score curves (PR/ROC, max F1) aggregate by distinct score first and then
take cumulative sums over scores with the blocked running helper, so no
single task sees all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import Stat
from ..plans.session import cut_lineage
from .windows import _as_list, rolling, running, time_rolling


def _div(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


# ---------------------------------------------------------------- matrix

def confusion_matrix(df: DataFrame, y_true: str, y_pred: str, weight: str | None = None, by=None) -> DataFrame:
    """(by..., y_true, y_pred, w, n): weighted and plain counts per cell."""
    by = _as_list(by)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return (df.select(*by, F.col(y_true).cast("string").alias("y_true"), F.col(y_pred).cast("string").alias("y_pred"),
                      w.alias("_w"))
            .groupBy(*by, "y_true", "y_pred").agg(F.sum("_w").alias("w"), F.count(F.lit(1)).alias("n")))


def class_table(cm: DataFrame, by=None) -> DataFrame:
    """Per class: support (row sum), predicted (column sum), tp, fp, fn."""
    by = _as_list(by)
    rows = cm.groupBy(*by, F.col("y_true").alias("cls")).agg(
        F.sum("w").alias("row_sum"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("w"))).alias("tp"),
        F.sum("n").alias("row_n"))
    cols = cm.groupBy(*by, F.col("y_pred").alias("cls")).agg(F.sum("w").alias("col_sum"), F.sum("n").alias("col_n"))
    t = rows.join(cols, [*by, "cls"], "full_outer")
    t = t.select(*by, "cls", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("row_sum", "col_sum", "tp")],
                 *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("row_n", "col_n")])
    t = t.filter((F.col("row_sum") != 0) | (F.col("col_sum") != 0))
    return t.withColumn("fp", F.col("col_sum") - F.col("tp")).withColumn("fn", F.col("row_sum") - F.col("tp"))


def _fbeta(p: Column, r: Column, beta: float) -> Column:
    b2 = beta * beta
    return _div((1 + b2) * p * r, b2 * p + r)


def per_class(ct: DataFrame, beta: float = 1.0) -> DataFrame:
    """Per-class precision, recall, F-beta, Jaccard (the classification report body)."""
    p = _div(F.col("tp"), F.col("col_sum"))
    r = _div(F.col("tp"), F.col("row_sum"))
    return ct.withColumns({
        "precision": p, "recall": r, "fbeta": _fbeta(p, r, beta),
        "jaccard": _div(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")),
    })


def multiclass_metrics(df: DataFrame, y_true: str, y_pred: str, weight: str | None = None, by=None,
                       beta: float = 1.0) -> DataFrame:
    """Accuracy, balanced accuracy, macro/micro/weighted precision, recall,
    F-beta, Jaccard, geometric mean, Cohen's kappa: one row per group."""
    by = _as_list(by)
    ct = per_class(class_table(confusion_matrix(df, y_true, y_pred, weight, by), by), beta)
    tot_w = F.sum("row_sum")
    tot_n = F.sum("row_n")
    k = F.count(F.lit(1))
    agg = ct.groupBy(*by).agg(
        tot_w.alias("total"), F.sum("tp").alias("tp"), k.alias("k"), tot_n.alias("n"),
        F.sum("col_sum").alias("pred_total"),
        F.sum("precision").alias("sp"), F.sum("recall").alias("sr"), F.sum("fbeta").alias("sf"),
        F.sum("jaccard").alias("sj"),
        F.sum(F.col("row_sum") * F.col("precision")).alias("wp"), F.sum(F.col("row_sum") * F.col("recall")).alias("wr"),
        F.sum(F.col("row_sum") * F.col("fbeta")).alias("wf"), F.sum(F.col("row_sum") * F.col("jaccard")).alias("wj"),
        F.sum(F.col("fp")).alias("fp"), F.sum(F.col("fn")).alias("fn"),
        F.min("recall").alias("min_r"), F.sum(F.log(F.when(F.col("recall") > 0, F.col("recall")))).alias("lnr"),
        F.sum(F.col("row_sum") * F.col("col_sum")).alias("pe_num"),
    )
    micro_p = _div(F.col("tp"), F.col("pred_total"))
    n = F.col("n").cast("double")
    p0 = _div(F.col("tp"), n)
    pe = _div(F.col("pe_num"), n * n)
    return agg.select(
        *by,
        _div(F.col("tp"), F.col("total")).alias("accuracy"),
        _div(F.col("sr"), F.col("k")).alias("balanced_accuracy"),
        _div(F.col("sp"), F.col("k")).alias("macro_precision"),
        micro_p.alias("micro_precision"),
        _div(F.col("wp"), F.col("total")).alias("weighted_precision"),
        _div(F.col("sr"), F.col("k")).alias("macro_recall"),
        micro_p.alias("micro_recall"),
        _div(F.col("wr"), F.col("total")).alias("weighted_recall"),
        _div(F.col("sf"), F.col("k")).alias("macro_fbeta"),
        _fbeta(micro_p, micro_p, beta).alias("micro_fbeta"),
        _div(F.col("wf"), F.col("total")).alias("weighted_fbeta"),
        _div(F.col("sj"), F.col("k")).alias("macro_jaccard"),
        _div(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")).alias("micro_jaccard"),
        _div(F.col("wj"), F.col("total")).alias("weighted_jaccard"),
        F.when(F.col("min_r") > 0, F.exp(F.col("lnr") / F.col("k"))).otherwise(F.lit(0.0)).alias("geometric_mean"),
        _div(p0 - pe, 1 - pe).alias("cohen_kappa"),
    )


def binary_metrics(df: DataFrame, y_true: str, y_pred: str, pos_val="1", weight: str | None = None, by=None,
                   beta: float = 1.0) -> DataFrame:
    """Precision, recall, F-beta, Jaccard and MCC for the positive label.

    True negatives follow the confusion-matrix rule sum(diagonal) - tp."""
    by = _as_list(by)
    cm = confusion_matrix(df, y_true, y_pred, weight, by)
    pos = F.lit(str(pos_val))
    agg = cm.groupBy(*by).agg(
        F.sum(F.when((F.col("y_true") == pos) & (F.col("y_pred") == pos), F.col("w"))).alias("tp"),
        F.sum(F.when((F.col("y_true") != pos) & (F.col("y_pred") == pos), F.col("w"))).alias("fp"),
        F.sum(F.when((F.col("y_true") == pos) & (F.col("y_pred") != pos), F.col("w"))).alias("fn"),
        F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("w"))).alias("diag"),
    )
    agg = agg.select(*by, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("tp", "fp", "fn", "diag")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    tn = F.col("diag") - tp
    p = _div(tp, tp + fp)
    r = _div(tp, tp + fn)
    margins = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    mcc = _div(tp * tn - fp * fn, F.sqrt(margins))
    return agg.select(*by, p.alias("precision"), r.alias("recall"), _fbeta(p, r, beta).alias("fbeta"),
                      _div(tp, tp + fp + fn).alias("jaccard"), mcc.alias("mcc"))


def clustering_metrics(df: DataFrame, y_true: str, y_pred: str, by=None, beta: float = 1.0) -> DataFrame:
    """Rand, adjusted Rand, mutual information (natural log), normalised MI
    (arithmetic mean), homogeneity, completeness, V-beta, Fowlkes-Mallows."""
    by, keyless = _group_keys(by)
    if keyless:
        df = df.withColumn("_g", F.lit(0))
    cm = confusion_matrix(df, y_true, y_pred, None, by).select(*by, "y_true", "y_pred", F.col("w").alias("nij"))
    rows = cm.groupBy(*by, "y_true").agg(F.sum("nij").alias("a"))
    cols = cm.groupBy(*by, "y_pred").agg(F.sum("nij").alias("b"))
    cells = cm.join(rows, [*by, "y_true"]).join(cols, [*by, "y_pred"])
    tot = rows.groupBy(*by).agg(F.sum("a").alias("N"), F.sum(F.col("a") * F.col("a")).alias("sa2"),
                                F.sum(F.col("a") * F.log(F.col("a"))).alias("alna"), F.count(F.lit(1)).alias("kc"))
    tot = tot.join(cols.groupBy(*by).agg(F.sum(F.col("b") * F.col("b")).alias("sb2"),
                                         F.sum(F.col("b") * F.log(F.col("b"))).alias("blnb"),
                                         F.count(F.lit(1)).alias("kk")), by, "inner")
    cell_agg = cells.groupBy(*by).agg(
        F.sum(F.col("nij") * F.col("nij")).alias("s2"),
        F.sum(F.col("nij") * (F.log(F.col("nij")) - F.log(F.col("a") * F.col("b")))).alias("mi_raw"),
        F.sum(F.col("nij") * F.log(F.col("nij"))).alias("nlnn"),
    )
    t = cell_agg.join(tot, by, "inner")
    N = F.col("N")
    # pairs of rows: all of them, those in one true class, in one cluster, in both
    pairs = N * (N - 1) / 2
    in_class, in_cluster, in_both = ((F.col(c) - N) / 2 for c in ("sa2", "sb2", "s2"))
    rand = _div(pairs - in_class - in_cluster + 2 * in_both, pairs, 1.0)
    chance = in_class * in_cluster
    ari = _div(pairs * in_both - chance, pairs * (in_class + in_cluster) / 2 - chance, 1.0)
    mi = F.col("mi_raw") / N + F.log(N)
    h_true = F.log(N) - F.col("alna") / N
    h_pred = F.log(N) - F.col("blnb") / N
    # conditional entropies H(C|K) = H(C,K) - H(K), H(C,K) = ln N - sum nij ln nij / N
    h_joint = F.log(N) - F.col("nlnn") / N
    hom = F.when(h_true == 0, F.lit(1.0)).otherwise(1 - (h_joint - h_pred) / h_true)
    com = F.when(h_pred == 0, F.lit(1.0)).otherwise(1 - (h_joint - h_true) / h_pred)
    vb = _div((1 + beta) * hom * com, beta * hom + com)
    one_each = ((F.col("kc") == 1) & (F.col("kk") == 1))
    nmi = F.when(one_each, F.lit(1.0)).otherwise(mi / F.greatest((h_true + h_pred) / 2, F.lit(2.220446049250313e-16)))
    fm = F.sqrt(_div(in_both, in_class)) * F.sqrt(_div(in_both, in_cluster))
    out = t.select(*by, rand.alias("rand"), ari.alias("adjusted_rand"), mi.alias("mutual_info"),
                   nmi.alias("normalized_mutual_info"), hom.alias("homogeneity"), com.alias("completeness"),
                   vb.alias("v_measure"), fm.alias("fowlkes_mallows"))
    return out.drop("_g") if keyless else out


def _group_keys(by) -> tuple[list[str], bool]:
    """Group columns; a constant key stands in when there are none, so
    one-row totals are joined on a key instead of a cartesian product."""
    by = _as_list(by)
    return (by, False) if by else (["_g"], True)


def regression_metrics(df: DataFrame, y_true: str, y_pred: str, by=None) -> DataFrame:
    """MAE, MSE, RMSE, RMSLE, SMAPE (percent) and R² in one aggregate pass."""
    by = _as_list(by)
    y, p = F.col(y_true).cast("double"), F.col(y_pred).cast("double")
    den = F.abs(y) + F.abs(p)
    smape_term = F.when(den == 0, F.lit(0.0)).otherwise(2.0 * F.abs(y - p) / den)
    agg = [
        F.avg(F.abs(y - p)).alias("mae"),
        F.avg((y - p) * (y - p)).alias("mse"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        F.sqrt(F.avg(F.pow(F.log1p(y) - F.log1p(p), 2))).alias("rmsle"),
        (100 * F.avg(smape_term)).alias("smape"),
        F.sum((y - p) * (y - p)).alias("_ssr"),
        F.var_samp(y).alias("_vy"),
        F.count(y).alias("_n"),
    ]
    g = df.groupBy(*by).agg(*agg) if by else df.agg(*agg)
    r2 = F.when(F.col("_n") > 1, F.when((F.col("_n") - 1) * F.col("_vy") == 0, F.lit(0.0))
                .otherwise(1 - F.col("_ssr") / ((F.col("_n") - 1) * F.col("_vy")))).otherwise(F.lit(0.0))
    return g.withColumn("r2", r2).drop("_ssr", "_vy", "_n")


def log_loss(df: DataFrame, y_true: str, p_true: str, by=None) -> DataFrame:
    """Binary log loss: mean -ln p of the true class, p clamped to [1e-15, 1-1e-15]."""
    by = _as_list(by)
    p = F.least(F.greatest(F.col(p_true).cast("double"), F.lit(1e-15)), F.lit(1 - 1e-15))
    y = F.col(y_true).cast("boolean")
    term = F.when(y, -F.log(p)).otherwise(-F.log(1 - p))
    return (df.groupBy(*by) if by else df.groupBy()).agg(F.avg(term).alias("log_loss"))


def cross_entropy(df: DataFrame, y_true: str, proba_map: str, by=None) -> DataFrame:
    """Multi-class: mean -ln p(true class) from a probability map, clamped."""
    by = _as_list(by)
    p = F.coalesce(F.element_at(F.col(proba_map), F.col(y_true).cast("string")), F.lit(0.0))
    p = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    return (df.groupBy(*by) if by else df.groupBy()).agg(F.avg(-F.log(p)).alias("cross_entropy"))


def roc_auc_binned(df: DataFrame, y_true: str, score: str, n_thresholds: int = 10, by=None) -> DataFrame:
    """ROC AUC by trapezoids between ``n_thresholds`` even thresholds over [0, 1].

    The end thresholds lie 1e-7 outside, so that 0 and 1 fall inside.  Each
    row's bin is the number of thresholds below its score; one aggregate counts
    positives and negatives per bin, and the area adds up each bin's negatives
    times the positives above it, half of its own included.  Rows without a
    score or label are passed over; 0 without positives or negatives.
    """
    by, keyless = _group_keys(by)
    if keyless:
        df = df.withColumn("_g", F.lit(0))
    steps = n_thresholds - 1
    s, y = F.col(score).cast("double"), F.col(y_true).cast("boolean")
    # thresholds strictly inside (0, 1) below the score; the division decides at the borders
    inner = F.least(F.greatest(F.ceil(s * steps) - 1, F.lit(0)), F.lit(steps - 1))
    inner = (inner - ((inner > 0) & ~(s > inner / steps)).cast("int")
             + ((inner < steps - 1) & (s > (inner + 1) / steps)).cast("int"))
    place = F.when(F.isnan(s), n_thresholds).otherwise((s > -1e-7).cast("int") + inner + (s > 1 + 1e-7).cast("int"))
    bins = (df.filter(s.isNotNull() & y.isNotNull()).groupBy(*by, place.cast("int").alias("_bin"))
            .agg(F.count(F.when(y, 1)).alias("_pos"), F.count(F.when(~y, 1)).alias("_neg")))
    # at most n_thresholds + 1 rows a key from here on
    above = F.coalesce(F.sum("_pos").over(Window.partitionBy(*by).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.col("_bin").between(1, steps)
    out = bins.withColumn("_above", above).groupBy(*by).agg(
        F.sum(F.when(inside, F.col("_neg") * (F.col("_above") + F.col("_pos") / 2)).otherwise(0.0)).alias("_area"),
        F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    area = _div(F.col("_area"), F.col("_p").cast("double") * F.col("_n"))
    if keyless:  # one row also for an empty table
        return out.agg(F.coalesce(F.max(area), F.lit(0.0)).alias("roc_auc"))
    return out.select(*by, area.alias("roc_auc"))


def score_curve_points(df: DataFrame, y_true: str, score: str, by=None, checkpoint: bool = False) -> DataFrame:
    """One row per distinct score (descending threshold) with cumulative
    true/false positives at ``score >= threshold``."""
    by = _as_list(by)
    y = F.col(y_true).cast("boolean")
    g = df.groupBy(*by, F.col(score).cast("double").alias("thr")).agg(
        F.count(F.when(y, 1)).cast("double").alias("pos"), F.count(F.when(~y, 1)).cast("double").alias("neg"))
    g = g.withColumn("_desc", -F.col("thr"))
    if checkpoint:
        # the score table feeds the block planning jobs and the final job;
        # a reliable checkpoint keeps an expensive scorer from re-running
        g = cut_lineage(g)
    g = running(g, {"tps": Stat.of("sum", "pos"), "fps": Stat.of("sum", "neg")}, by=by, order="_desc")
    return g.drop("_desc")


def curve_metrics(df: DataFrame, y_true: str, score: str, by=None, checkpoint: bool = False) -> DataFrame:
    """Exact PR-AUC (trapezoid over recall, precision), ROC-AUC and the
    maximum F1 with its precision, recall and threshold."""
    by, keyless = _group_keys(by)
    if keyless:
        df = df.withColumn("_g", F.lit(0))
    pts = score_curve_points(df, y_true, score, by, checkpoint)
    tot = pts.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("Nn"))
    # one row per group: bounded by the number of groups, joined on the key
    pts = pts.join(tot, by, "inner")
    tps, fps = F.col("tps"), F.col("fps")
    prev_tp, prev_fp = tps - F.col("pos"), fps - F.col("neg")
    prec = _div(tps, tps + fps)
    prev_prec = F.when(prev_tp + prev_fp > 0, prev_tp / (prev_tp + prev_fp)).otherwise(F.lit(1.0))
    rec = _div(tps, F.col("P"))
    prev_rec = _div(prev_tp, F.col("P"))
    pr_term = (rec - prev_rec) * (prec + prev_prec) / 2
    roc_term = (_div(fps, F.col("Nn")) - _div(prev_fp, F.col("Nn"))) * (rec + prev_rec) / 2
    f1 = _div(2 * prec * rec, prec + rec)
    pts = pts.withColumns({"_pr": pr_term, "_roc": roc_term, "_f1": f1, "_p": prec, "_r": rec})
    best = F.struct(F.col("_f1"), (-F.col("thr")).alias("t"), F.col("_p"), F.col("_r"), F.col("thr"))
    out = pts.groupBy(*by).agg(F.sum("_pr").alias("pr_auc"), F.sum("_roc").alias("roc_auc"), F.max(best).alias("_b"))
    out = out.select(*by, "pr_auc", "roc_auc", F.col("_b._f1").alias("max_f1"),
                     F.col("_b._p").alias("max_f1_precision"), F.col("_b._r").alias("max_f1_recall"),
                     F.col("_b.thr").alias("max_f1_threshold"))
    return out.drop("_g") if keyless else out


def summarise_runs(df: DataFrame, group: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample std of every metric per experiment group (``_std`` suffix)."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(m), F.stddev_samp(m).alias(f"{m}_std")]
    return df.groupBy(*group).agg(*aggs)


def running_metric_counts(df: DataFrame, y_true: str, y_pred: str, order, by=None) -> DataFrame:
    """Running accuracy as of every row (mergeable sums; hot keys split)."""
    d = df.withColumn("_ordo_ok", (F.col(y_true) == F.col(y_pred)).cast("double"))
    d = running(d, {"accuracy": Stat.of("mean", "_ordo_ok")}, by=by, order=order)
    return d.drop("_ordo_ok")


#: Metrics that are formulas of means or sums of per-row terms: (terms of y and p, formula of their totals).
#: Binary ones count the class ``positive``.
_PLAIN = {
    "mae": lambda y, p: F.abs(y - p),
    "mse": lambda y, p: (y - p) * (y - p),
    "rmse": lambda y, p: (y - p) * (y - p),
    "smape": lambda y, p: F.when((y == 0) & (p == 0), 0.0).otherwise(200.0 * F.abs(y - p) / (F.abs(y) + F.abs(p))),
}
_BINARY = {
    "precision": lambda tp, fp, fn: _div(tp, tp + fp),
    "recall": lambda tp, fp, fn: _div(tp, tp + fn),
    "f1": lambda tp, fp, fn: _div(2 * tp, 2 * tp + fp + fn),
    "jaccard": lambda tp, fp, fn: _div(tp, tp + fp + fn),
}


def window_metric(df: DataFrame, metric: str, y_true: str, y_pred: str, frame, positive=True, name: str | None = None) -> DataFrame:
    """``df`` with a metric over a frame of rows up to each.

    ``frame(df, outputs)`` appends statistics of columns: ``running``,
    ``rolling`` or ``time_rolling`` with their other arguments given.  Rows
    with a null target or prediction do not count; the metric is 0 before any.
    """
    name = name or metric
    y, p = F.col(y_true), F.col(y_pred)
    known = y.isNotNull() & p.isNotNull()
    if metric == "accuracy" or metric in _PLAIN:
        term = (y == p).cast("double") if metric == "accuracy" else _PLAIN[metric](y.cast("double"), p.cast("double"))
        out = frame(df.withColumn("_ordo_e", F.when(known, term)), {name: Stat.of("mean", "_ordo_e")}).drop("_ordo_e")
        return out.withColumn(name, F.sqrt(name)) if metric == "rmse" else out
    if metric not in _BINARY:
        raise ValueError(f"unknown metric {metric}")
    hit, said = y == F.lit(positive), p == F.lit(positive)
    cells = {"_ordo_tp": hit & said, "_ordo_fp": ~hit & said, "_ordo_fn": hit & ~said}
    rows = df.withColumns({n: F.when(known, c.cast("double")).otherwise(0.0) for n, c in cells.items()})
    out = frame(rows, {f"{n}_s": Stat.of("sum", n) for n in cells})
    return out.withColumn(name, _BINARY[metric](*[F.col(f"{n}_s") for n in cells])).drop(*cells, *[f"{n}_s" for n in cells])


def rolling_metric(df: DataFrame, metric: str, y_true: str, y_pred: str, order, window: int, by=None, **more) -> DataFrame:
    """A metric over the last ``window`` rows of the key."""
    return window_metric(df, metric, y_true, y_pred, lambda d, outs: rolling(d, outs, window=window, by=by, order=order), **more)


def time_rolling_metric(df: DataFrame, metric: str, y_true: str, y_pred: str, time_col: str, period_us: int, by=None, **more) -> DataFrame:
    """A metric over the key's rows later than ``period_us`` before each; rows of one time see each other."""
    return window_metric(df, metric, y_true, y_pred, lambda d, outs: time_rolling(d, outs, period_us, time_col, by), **more)


def rolling_accuracy(df: DataFrame, y_true: str, y_pred: str, order, window: int, by=None) -> DataFrame:
    return rolling_metric(df, "accuracy", y_true, y_pred, order, window, by, name="rolling_accuracy")


__all__ = [
    "confusion_matrix", "class_table", "per_class", "multiclass_metrics", "binary_metrics", "clustering_metrics",
    "regression_metrics", "log_loss", "cross_entropy", "roc_auc_binned", "curve_metrics", "summarise_runs",
    "running_metric_counts", "window_metric", "rolling_metric",
    "time_rolling_metric", "rolling_accuracy",
]
