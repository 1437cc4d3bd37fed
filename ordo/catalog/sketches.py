"""Skylines, histograms and sliding Fourier coefficients."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sketches as S
from ..operators.skyline import skyline
from ..queries import Q6, T, q6, query


@query(
    "skyline",
    sql="""
WITH c AS (SELECT DISTINCT l_extendedprice, l_quantity, l_discount FROM lineitem),
f AS (SELECT * FROM c a WHERE NOT EXISTS (
  SELECT 1 FROM c b WHERE b.l_extendedprice <= a.l_extendedprice AND b.l_quantity >= a.l_quantity AND b.l_discount >= a.l_discount
    AND (b.l_extendedprice < a.l_extendedprice OR b.l_quantity > a.l_quantity OR b.l_discount > a.l_discount)))
SELECT l.l_orderkey, l.l_partkey, l.l_extendedprice, l.l_quantity, l.l_discount
FROM lineitem l JOIN f USING (l_extendedprice, l_quantity, l_discount)
""",
)
def skyline_lineitem(spark, sf):
    """Line items that no other beats in price, quantity and discount together."""
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity", "l_discount")
    return skyline(li, minimize="l_extendedprice", maximize=["l_quantity", "l_discount"])


@query(
    "skyline_by_customer",
    sql="""
SELECT o_orderkey, o_custkey FROM orders a WHERE NOT EXISTS (
  SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_totalprice >= a.o_totalprice AND b.o_orderdate >= a.o_orderdate
    AND (b.o_totalprice > a.o_totalprice OR b.o_orderdate > a.o_orderdate))
""",
)
def skyline_by_customer(spark, sf):
    """Each customer's orders with none both dearer and later."""
    o = T(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return skyline(o, maximize=["o_totalprice", "o_orderdate"], by="o_custkey").select("o_orderkey", "o_custkey")


@query(
    "histogram_bins",
    sql="""
SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS lft, CAST(l_quantity AS DOUBLE) AS rgt, CAST(count(*) AS DOUBLE) AS n, 0.0 AS slack,
  CAST(sum(count(*)) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY l_returnflag) AS DOUBLE) AS cdf
FROM lineitem GROUP BY l_returnflag, l_quantity
""",
)
def histogram_bins(spark, sf):
    """Adaptive histogram of the quantity by return flag (exact: fewer values than bins), with the distribution function at each bin."""
    h = S.histogram(T(spark, sf, "lineitem").select("l_returnflag", "l_quantity"), "l_quantity", "l_returnflag")
    rows = h.select("*", F.explode("bins").alias("b"))
    return rows.select("l_returnflag", F.col("b.left").alias("lft"), F.col("b.right").alias("rgt"), F.col("b.n").alias("n"), "slack",
                       S.cdf(F.col("bins"), F.col("n"), F.col("b.right")).alias("cdf"))


@query("histogram_adaptive")
def histogram_adaptive(spark, sf):
    """Adaptive 64-bin histogram of prices by ship mode of return flag, its median and the bound of its error."""
    h = S.histogram(T(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice", "l_returnflag", max_bins=64)
    return h.select("l_returnflag", "n", F.size("bins").alias("bins"), "slack", S.quantile(F.col("bins"), F.col("n"), 0.5).alias("median"))


@query(
    "histogram_equi_width",
    sql=f"""
WITH e AS (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1),
w AS (SELECT l.l_returnflag, lo, (hi - lo) / 50 AS w, CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin
      FROM lineitem l JOIN e USING (l_returnflag))
SELECT l_returnflag, bin, {Q6("lo + bin * w")} AS lft, {Q6("lo + (bin + 1) * w")} AS rgt, count(*) AS n FROM w GROUP BY l_returnflag, bin, lo, w
""",
)
def histogram_equi_width(spark, sf):
    """Exact counts of prices in 50 ranges of equal width by return flag."""
    h = S.equi_width(T(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice", 50, "l_returnflag")
    return h.select("l_returnflag", "bin", q6("left").alias("lft"), q6("right").alias("rgt"), "n")


_N = 8
_DFT = ", ".join(
    part
    for k in range(_N // 2 + 1)
    for part in (
        f"CASE WHEN p >= {_N - 1} THEN {Q6(f'c{k} * cos(2 * pi() * ((p + 1) * {k} % {_N}) / {_N}) + s{k} * sin(2 * pi() * ((p + 1) * {k} % {_N}) / {_N})')} END AS re_{k}",
        f"CASE WHEN p >= {_N - 1} THEN {Q6(f'c{k} * sin(2 * pi() * ((p + 1) * {k} % {_N}) / {_N}) - s{k} * cos(2 * pi() * ((p + 1) * {k} % {_N}) / {_N})')} END AS im_{k}",
    )
)
_SUMS = ", ".join(
    f"sum(value * {f}(2 * pi() * (p * {k} % {_N}) / {_N})) OVER w AS {c}{k}" for k in range(_N // 2 + 1) for f, c in (("cos", "c"), ("sin", "s"))
)


@query(
    "sliding_dft",
    sql=f"""
WITH r AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS p FROM events),
t AS (SELECT event_id, p, {_SUMS} FROM r WINDOW w AS (PARTITION BY event_type ORDER BY p ROWS {_N - 1} PRECEDING))
SELECT event_id, {_DFT} FROM t
""",
)
def sliding_dft(spark, sf):
    """Fourier coefficients of the last 8 values of each event type."""
    e = T(spark, sf, "events").select("event_id", "event_type", "value")
    found = S.sliding_dft(e, "value", _N, "event_type", "event_id", range(_N // 2 + 1))
    return found.select("event_id", *[q6(f"{part}_{k}").alias(f"{part}_{k}") for k in range(_N // 2 + 1) for part in ("re", "im")])
