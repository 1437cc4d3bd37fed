"""Resampling towards a class distribution, and by rarity of a numeric target, over all events."""

from __future__ import annotations

from ..operators import imbalance as I
from ..queries import T, query

_WISHED = {"click": 0.1, "error": 0.5, "purchase": 0.2, "signup": 0.1, "view": 0.1}


def _draw(key: str, seed: int = 0) -> str:
    """SQL twin of ``imbalance.draw``."""
    h = f"(({key} + {1_000_003 * (seed + 1)}) & 4294967295)"
    for _ in range(2):
        h = f"((xor({h}, {h} >> 16) * 73244475) & 4294967295)"
    return f"((CAST(xor({h}, {h} >> 16) AS DOUBLE) + 0.5) / 4294967296)"


_COUNTS = ", ".join(f"{f}::DOUBLE / nullif(count(*) FILTER (WHERE event_type = '{c}') OVER o, 0) AS r_{c}" for c, f in _WISHED.items())
_OWN = "CASE " + " ".join(f"WHEN event_type = '{c}' THEN r_{c}" for c in _WISHED) + " END"
_RATES = f"""WITH c AS (SELECT *, count(*) OVER o AS seen, {_COUNTS} FROM events WINDOW o AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT event_id, event_type, value, seen, {_OWN} AS own, greatest({", ".join(f"r_{c}" for c in _WISHED)}) AS high, least({", ".join(f"r_{c}" for c in _WISHED)}) AS low FROM c)"""


def _poisson_sql(rate: str, key: str, seed: int, rest: str) -> str:
    """Rows with ``n``, how many values of the distribution function lie below the row's draw."""
    return f"""w AS (SELECT {rest}, {rate} AS rate, {_draw(key, seed)} AS u FROM r),
k AS (SELECT {rest}, rate, u, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT))) AS k FROM w),
p AS (SELECT {rest}, u, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY event_id ORDER BY k) AS cdf FROM k),
n AS (SELECT {rest}, count(*) FILTER (WHERE cdf < u) AS n FROM p GROUP BY ALL)"""


def _events(spark, sf):
    return T(spark, sf, "events").select("event_id", "event_type", "value")


@query("undersample", sql=f"{_RATES} SELECT event_id, event_type, value FROM r WHERE {_draw('event_id')} < own / high")
def undersample(spark, sf):
    """Events thinned out class by class until half of them are errors."""
    return I.undersample(_events(spark, sf), "event_type", _WISHED, "event_id", "event_id")


@query(
    "oversample",
    sql=f"""{_RATES}, {_poisson_sql('own / low', 'event_id', 0, 'event_id, event_type, value, own, low')}
SELECT event_id, event_type, value, CAST(unnest(range(1, CASE WHEN own <= low THEN 2 ELSE n + 1 END)) AS INTEGER) AS copy FROM n""",
)
def oversample(spark, sf):
    """Events repeated class by class until half of them are errors."""
    return I.oversample(_events(spark, sf), "event_type", _WISHED, "event_id", "event_id")


@query(
    "resample",
    sql=f"""{_RATES}, {_poisson_sql('0.5 * own * seen', 'event_id', 3, 'event_id, event_type, value')}
SELECT event_id, event_type, value, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM n""",
)
def resample(spark, sf):
    """About half as many events, half of them errors."""
    return I.resample(_events(spark, sf), "event_type", _WISHED, "event_id", "event_id", rate=0.5, seed=3)


_DEV = """WITH s AS (SELECT event_id, user_id, value, avg(value) OVER w AS m, coalesce(stddev_samp(value) OVER w, 0) AS sd FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, coalesce(abs(value - m) / nullif(sd, 0), 0) AS t FROM s)"""


@query(
    "chebyshev_oversample",
    sql=f"{_DEV} SELECT event_id, user_id, value, CAST(unnest(range(1, CASE WHEN sd > 0 THEN CAST(ceil(t) AS BIGINT) + 1 ELSE 2 END)) AS INTEGER) AS copy FROM t",
)
def chebyshev_oversample(spark, sf):
    """Events repeated by how far their value lies from the user's mean so far."""
    e = T(spark, sf, "events").select("event_id", "user_id", "value")
    return I.chebyshev_oversample(e, "value", "event_id", "user_id")


@query("chebyshev_undersample", sql=f"{_DEV} SELECT event_id, user_id, value FROM t WHERE sd <= 0 OR (t > 1 AND {_draw('event_id', 5)} >= 1 / (t * t))")
def chebyshev_undersample(spark, sf):
    """Events whose value is rare for the user, by Chebyshev's bound."""
    e = T(spark, sf, "events").select("event_id", "user_id", "value")
    return I.chebyshev_undersample(e, "value", "event_id", "event_id", "user_id", seed=5)
