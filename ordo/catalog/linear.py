"""Losses and linear models, each step of a fit an aggregate over all rows of its batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import losses as L
from ..operators import glm as G
from ..queries import Q6, T, q6, query

_Y, _P = "(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)", "((l_quantity - 25) / 5)"
_S = f"(2 * {_Y} - 1)"
_Z = f"({_S} * {_P})"
_FOCAL = f"(1 / (1 + exp(-(2 * {_Z} + 1))))"
#: name -> SQL of (value, gradient)
_LOSS_SQL = {
    "absolute": (f"abs({_P} - {_Y})", f"CASE WHEN {_P} > {_Y} THEN 1 ELSE -1 END"),
    "squared": (f"({_P} - {_Y}) * ({_P} - {_Y})", f"2 * ({_P} - {_Y})"),
    "cauchy": (f"abs({_P} - {_Y})", f"({_P} - {_Y}) / (pow(({_P} - {_Y}) / 80, 2) + 1)"),
    "epsilon_insensitive": (f"greatest(abs({_P} - {_Y}) - 0.1, 0)", f"CASE WHEN {_P} > {_Y} + 0.1 THEN 1 WHEN {_P} + 0.1 < {_Y} THEN -1 ELSE 0 END"),
    "quantile": (f"(0.5 - CASE WHEN {_P} < {_Y} THEN 1 ELSE 0 END) * ({_P} - {_Y})", f"CASE WHEN {_Y} < {_P} THEN 1 ELSE 0 END - 0.5"),
    "huber": (
        f"CASE WHEN abs({_P} - {_Y}) <= 0.1 THEN 0.5 * pow({_P} - {_Y}, 2) ELSE 0.1 * abs({_P} - {_Y}) - 0.005 END",
        f"CASE WHEN abs({_P} - {_Y}) <= 0.1 THEN {_P} - {_Y} ELSE 0.1 * sign({_P} - {_Y}) END",
    ),
    "poisson": (f"exp({_P}) - {_Y} * {_P}", f"exp({_P}) - {_Y}"),
    "hinge": (f"greatest(1 - {_Z}, 0)", f"CASE WHEN {_Z} <= 1 THEN -{_S} ELSE 0 END"),
    "log": (f"ln(1 + exp(-{_Z}))", f"-{_S} / (exp({_Z}) + 1)"),
    "binary_focal": (f"-ln({_FOCAL}) / 2", f"{_S} * ({_FOCAL} - 1)"),
}


@query(
    "loss_functions",
    sql="SELECT l_returnflag, l_quantity, "
    + ", ".join(f"{Q6(f'sum({v})')} AS {n}_value, {Q6(f'sum({g})')} AS {n}_gradient" for n, (v, g) in _LOSS_SQL.items())
    + " FROM lineitem GROUP BY 1, 2",
)
def loss_functions(spark, sf):
    """Value and gradient of every loss, summed by return flag and quantity."""
    li = T(spark, sf, "lineitem").select("l_returnflag", "l_quantity")
    y, p = (F.col("l_returnflag") == "R").cast("double"), (F.col("l_quantity") - 25) / 5
    out = {}
    for name, make in L.LOSSES.items():
        loss = make()
        out[f"{name}_value"], out[f"{name}_gradient"] = loss.value(y, p), loss.gradient(y, p)
    return li.groupBy("l_returnflag", "l_quantity").agg(*[q6(F.sum(c)).alias(n) for n, c in out.items()])


_X = ["x1", "x2", "x3"]
_ROWS = """r AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) AS batch, l_quantity / 50 AS x1, l_discount * 10 AS x2, l_tax * 10 AS x3,
  l_extendedprice / 50000 AS price, CASE WHEN l_quantity > 30 AND l_discount > 0.03 THEN 1 ELSE 0 END AS big, l_returnflag AS flag FROM lineitem)"""


def _rows(spark, sf):
    return T(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_linenumber").cast("long").alias("batch"),
        (F.col("l_quantity") / 50).alias("x1"),
        (F.col("l_discount") * 10).alias("x2"),
        (F.col("l_tax") * 10).alias("x3"),
        (F.col("l_extendedprice") / 50000).alias("price"),
        ((F.col("l_quantity") > 30) & (F.col("l_discount") > 0.03)).cast("int").alias("big"),
        F.col("l_returnflag").alias("flag"),
    )


def _steps(slope: str, lr: float, intercept_lr: float, epochs: int, l2: float = 0.0, intercept: float = 0.0, extra: float = 0.0) -> str:
    """CTEs m0, m1, ... of the weights after each step; ``slope`` is the loss gradient by the score ``p``."""
    out = [f"m0 AS (SELECT {intercept}::DOUBLE AS b, " + ", ".join(f"0.0::DOUBLE AS w{i}" for i in range(1, 4)) + ")"]
    for step in range(epochs * 7):
        w = ", ".join(f"any_value(w{i}) - {lr} * (avg(g * x{i}) + {l2} * any_value(w{i})) AS w{i}" for i in range(1, 4))
        out.append(
            f"m{step + 1} AS (SELECT any_value(b) - ({intercept_lr} * avg(g) + {extra}) AS b, {w} FROM (SELECT *, {slope} AS g FROM "
            f"(SELECT r.*, m.*, b + w1 * x1 + w2 * x2 + w3 * x3 AS p FROM r, m{step} m WHERE batch = {step % 7 + 1})))"
        )
    return ",\n".join(out)


def _model_sql(slope: str, mean: str, epochs: int, **how) -> str:
    return f"""WITH {_ROWS},
{_steps(slope, epochs=epochs, **how)}
SELECT l_orderkey, l_linenumber, {Q6(mean)} AS y_pred FROM (SELECT r.*, b, b + w1 * x1 + w2 * x2 + w3 * x3 AS p FROM r, m{epochs * 7})"""


@query("linear_regression", sql=_model_sql("2 * (p - price)", "p", 3, lr=0.05, intercept_lr=0.02, l2=0.01))
def linear_regression(spark, sf):
    """Price from quantity, discount and tax: three epochs over seven batches, squared loss, shrunk weights."""
    rows = _rows(spark, sf)
    model = G.fit(rows, _X, "price", L.squared(), G.Sgd(0.05), 0.02, l2=0.01, epochs=3, batch="batch")
    return G.predict(rows, model).select("l_orderkey", "l_linenumber", q6("y_pred").alias("y_pred"))


@query("logistic_regression", sql=_model_sql("-(2 * big - 1) / (exp((2 * big - 1) * p) + 1)", "1 / (1 + exp(-p))", 3, lr=0.5, intercept_lr=0.1))
def logistic_regression(spark, sf):
    """Probability of a large discounted item: three epochs over seven batches, log loss."""
    rows = _rows(spark, sf)
    model = G.fit(rows, _X, "big", L.log(), G.Sgd(0.5), 0.1, epochs=3, batch="batch")
    return G.predict(rows, model, L.log()).select("l_orderkey", "l_linenumber", q6("y_pred").alias("y_pred"))


@query("perceptron", sql=_model_sql("CASE WHEN (2 * big - 1) * p <= 0 THEN -(2 * big - 1) ELSE 0 END", "p", 2, lr=1, intercept_lr=1))
def perceptron(spark, sf):
    """Raw score of a large discounted item: two epochs of full steps over seven batches."""
    rows = _rows(spark, sf)
    model = G.fit_perceptron(rows, _X, "big", epochs=2, batch="batch")
    return G.predict(rows, model).select("l_orderkey", "l_linenumber", q6("y_pred").alias("y_pred"))


@query("one_class_svm", sql=_model_sql("CASE WHEN p <= 1 THEN -1 ELSE 0 END", "p - b", 2, lr=0.1, intercept_lr=0.01, l2=0.1, intercept=1.0, extra=0.002))
def one_class_svm(spark, sf):
    """One-class score of every line item: two epochs over seven batches, nu 0.2."""
    rows = _rows(spark, sf)
    model = G.fit_one_class(rows, _X, nu=0.2, optimizer=G.Sgd(0.1), epochs=2, batch="batch")
    return G.anomaly_score(rows, model).select("l_orderkey", "l_linenumber", q6("svm_score").alias("y_pred"))


def _softmax_sql(epochs: int = 2, lr: float = 0.5) -> str:
    names = "ANR"
    out = ["m0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS {c}{i}" for c in names for i in range(1, 4)) + ")"]
    score = {c: f"({c}1 * x1 + {c}2 * x2 + {c}3 * x3)" for c in names}
    for step in range(epochs * 7):
        w = ", ".join(f"any_value({c}{i}) - {lr} * avg((p{c} - CASE WHEN flag = '{c}' THEN 1 ELSE 0 END) * x{i}) AS {c}{i}" for c in names for i in range(1, 4))
        share = ", ".join(f"exp(s{c}) / (exp(sA) + exp(sN) + exp(sR)) AS p{c}" for c in names)
        raw = ", ".join(f"{score[c]} AS s{c}" for c in names)
        out.append(f"m{step + 1} AS (SELECT {w} FROM (SELECT *, {share} FROM (SELECT r.*, m.*, {raw} FROM r, m{step} m WHERE batch = {step % 7 + 1})))")
    raw = ", ".join(f"{score[c]} AS s{c}" for c in names)
    return f"""WITH {_ROWS},
{", ".join(out)}
SELECT l_orderkey, l_linenumber, CASE WHEN sA >= sN AND sA >= sR THEN 'A' WHEN sN >= sR THEN 'N' ELSE 'R' END AS y_pred,
  {Q6("exp(greatest(sA, sN, sR)) / (exp(sA) + exp(sN) + exp(sR))")} AS proba FROM (SELECT r.*, {raw} FROM r, m{epochs * 7})"""


@query("softmax_regression", sql=_softmax_sql())
def softmax_regression(spark, sf):
    """Return flag from quantity, discount and tax: two epochs over seven batches."""
    rows = _rows(spark, sf)
    model = G.fit_softmax(rows, _X, "flag", optimizer=G.Sgd(0.5), epochs=2, batch="batch")
    out = G.predict_label(rows, model)
    return out.select("l_orderkey", "l_linenumber", "y_pred", q6(F.array_max("y_proba")).alias("proba"))
