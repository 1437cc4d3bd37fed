"""Quality rules judged per document and per host.

Each document is measured inside its own row with array functions (no
shuffle of words).  Rule failures are then summed per host, the failure rates
are shrunk towards the corpus with a beta prior fitted to the host rates by
moments, and a host whose shrunken rate of any rule is above ``host_limit``
loses all its documents.  Verdicts are joined back to the documents.

Only the narrow measures are shuffled, with map-side sums, so a host with a
third of all rows costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, total

SPACE = r"[\x20\x09-\x0D]"
BROADCAST_HOSTS = 50_000
SALTS = 32

#: Host-level rules: a condition on the measures of one document.
RULES: dict[str, str] = {
    "too_short": "n_words < 50",
    "repeats_itself": "100 * n_repeat_words > 50 * n_words",
    "odd_word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)",
    "many_symbols": "5 * n_symbols > n_words",
    "repeats_lines": "10 * n_dup_lines > 3 * n_lines",
}


def words_of(text: Column) -> Column:
    """Maximal runs of characters that are not white space."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more in the array.

    Windows are compared by a 64-bit hash; places of repeated windows are
    sorted, and each adds the words that the one before has not covered.
    """

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            placed,
            lambda p: F.filter(
                p,
                lambda x, i: F.get(p, i - 1)["h"].eqNullSafe(x["h"]) | F.get(p, i + 1)["h"].eqNullSafe(x["h"]),
            ),
        )
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        steps = let(
            places,
            lambda at: F.transform(at, lambda x, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), x - F.get(at, i - 1)))),
        )
        return total(steps)

    def measured(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )
        some = let(
            windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("bigint"))
        )
        return F.when(F.size(w) < 4, F.lit(0).cast("bigint")).otherwise(some)

    return let(words, measured)


def measures(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """doc_id, host and the counts that the rules use."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("_text"))
    lines = let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")),
    )
    counted = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("repeat")
        ),
    )
    symbols = F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
    return source.select("doc_id", "host", counted.alias("w"), symbols.alias("s"), lines.alias("l")).select(
        "doc_id",
        "host",
        F.col("w.n").cast("long").alias("n_words"),
        F.col("w.chars").cast("long").alias("word_chars"),
        F.col("s").cast("long").alias("n_symbols"),
        F.col("l.dup").cast("long").alias("n_dup_lines"),
        F.col("w.repeat").cast("long").alias("n_repeat_words"),
        F.col("l.n").cast("long").alias("n_lines"),
    )


def host_rates(measured: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Per host: documents, failures and the shrunken failure rate of each rule."""
    fails = [F.sum(F.expr(rule).cast("int")).alias(f"fail_{name}") for name, rule in rules.items()]
    hosts = measured.filter("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("n"), *fails)
    rate = {name: F.col(f"fail_{name}") / F.col("n") for name in rules}
    # two numbers a rule: the moments of the host rates
    moments = hosts.agg(
        *[F.avg(r).alias(f"m_{k}") for k, r in rate.items()], *[F.var_pop(r).alias(f"v_{k}") for k, r in rate.items()]
    ).first()
    shrunk = []
    for name in rules:
        mean, var = moments[f"m_{name}"] or 0.0, moments[f"v_{name}"] or 0.0
        strength = min(max(mean * (1 - mean) / max(var, 1e-12) - 1, 1.0), 1e6)
        shrunk.append(((F.col(f"fail_{name}") + mean * strength) / (F.col("n") + strength)).alias(f"rate_{name}"))
    return hosts.select("*", *shrunk)


def judge_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    host_limit: float = 0.8,
    rules: dict[str, str] | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_words, the four measures, base_failed, kept.

    ``base_failed``: under 50 words, or over half of the words in repeated
    3-word windows.  ``kept`` is false for those and for documents of failed
    hosts.  Null text counts as none (0 words: fails); a null host has no
    verdict of its own.  Repeated rows and null ids stay; other columns are
    ignored; an empty table gives no rows.
    """
    rules = RULES if rules is None else rules
    measured = materialize(measures(docs, id_col, text_col, host_col), "quality")
    rates = host_rates(measured, rules)
    worst = F.greatest(*[F.col(f"rate_{name}") for name in rules], F.lit(0.0))
    failed = materialize(rates.filter(worst > host_limit).select("host", F.lit(True).alias("host_failed")), "hosts")
    if failed.count() <= BROADCAST_HOSTS:
        judged = measured.join(F.broadcast(failed), "host", "left")
    else:  # too many to send around: join by host and a salt of the document
        salted = failed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = measured.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        judged = spread.join(salted, ["host", "_salt"], "left")
    base_failed = F.expr(f"({RULES['too_short']}) OR ({RULES['repeats_itself']})")
    host_failed = F.coalesce(F.col("host_failed"), F.lit(False))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & ~host_failed).alias("kept"),
    )


def oracle_sql(host_limit: float = 0.8) -> str:
    """The rows of :func:`judge_documents` with its defaults, in DuckDB SQL over ``documents``."""
    names = list(RULES)
    fails = ", ".join(f"CAST(count(*) FILTER (WHERE {rule}) AS DOUBLE) AS {name}" for name, rule in RULES.items())
    moments = ", ".join(f"avg({k} / n) AS m_{k}, var_pop({k} / n) AS v_{k}" for k in names)
    strengths = ", ".join(f"least(greatest(m_{k} * (1 - m_{k}) / greatest(v_{k}, 1e-12) - 1, 1.0), 1e6) AS s_{k}" for k in names)
    worst = ", ".join(f"({k} + m_{k} * s_{k}) / (n + s_{k})" for k in names)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
s AS (SELECT rid, doc_id, host, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
      FROM d),
p AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM s),
g AS (SELECT rid, i, x || ' ' || lead(x, 1) OVER a || ' ' || lead(x, 2) OVER a AS gram FROM p
      WINDOW a AS (PARTITION BY rid ORDER BY i)),
f AS (SELECT rid, i, gram IS NOT NULL AND count(*) OVER (PARTITION BY rid, gram) > 1 AS twice FROM g),
c AS (SELECT rid, twice OR coalesce(lag(twice, 1) OVER a, false) OR coalesce(lag(twice, 2) OVER a, false) AS covered FROM f
      WINDOW a AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, count(*) FILTER (WHERE covered) AS n_repeat_words FROM c GROUP BY rid),
m AS (SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines
      FROM s LEFT JOIN r USING (rid)),
h AS (SELECT host, count(*) AS n, {fails} FROM m WHERE host IS NOT NULL GROUP BY host),
mo AS (SELECT {moments} FROM h),
st AS (SELECT *, {strengths} FROM mo),
bad AS (SELECT host, true AS host_failed FROM h, st WHERE greatest({worst}, 0.0) > {host_limit}),
j AS (SELECT m.*, ({RULES['too_short']}) OR ({RULES['repeats_itself']}) AS base_failed, coalesce(host_failed, false) AS host_failed
      FROM m LEFT JOIN bad USING (host))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT host_failed AS kept
FROM j
"""
