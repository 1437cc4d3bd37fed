"""Tokenising, n-grams, bag of words and TF-IDF over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import text as X
from ..queries import Q6, T, q6, query

_TOK = f"regexp_extract_all(lower(text), '{TX.TOKEN_PATTERN}')"


@query(
    "bag_of_words",
    headline=True,
    sql=f"""
SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY 1, 2
""",
)
def bag_of_words(spark, sf):
    """Term counts per document over whole texts."""
    return X.bag_of_words(T(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


@query(
    "bigram_counts",
    sql=f"""
WITH t AS (SELECT doc_id, {_TOK} AS toks FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) AS term
      FROM t WHERE len(toks) >= 2)
SELECT term, count(*) AS n FROM g GROUP BY 1
""",
)
def bigram_counts(spark, sf):
    """Corpus-wide bigram frequencies (n-gram range (2, 2))."""
    bow = X.bag_of_words(T(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", ngram_range=(2, 2))
    return bow.groupBy("term").agg(F.sum("n").alias("n"))


@query(
    "tfidf_running",
    headline=True,
    sql=f"""
WITH b AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY 1, 2),
d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n_docs FROM documents),
t AS (SELECT b.*, d.n_docs, count(*) OVER (PARTITION BY term ORDER BY d.n_docs ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS df
      FROM b JOIN d USING (doc_id)),
w AS (SELECT *, (n / sum(n) OVER (PARTITION BY doc_id)) * (ln((1 + n_docs) / (1 + df)) + 1) AS x FROM t)
SELECT doc_id, term, n, {Q6("x / sqrt(sum(x * x) OVER (PARTITION BY doc_id))")} AS tfidf FROM w
""",
)
def tfidf_running(spark, sf):
    """Online TF-IDF (document frequencies so far, current document included)."""
    out = X.tfidf_running(T(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", "doc_id")
    return out.select("doc_id", "term", "n", q6("tfidf").alias("tfidf"))


@query(
    "tfidf_batch",
    sql=f"""
WITH b AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY 1, 2),
t AS (SELECT b.*, (SELECT count(DISTINCT doc_id) FROM documents) AS n_docs, count(*) OVER (PARTITION BY term) AS df FROM b),
w AS (SELECT *, (n / sum(n) OVER (PARTITION BY doc_id)) * (ln((1 + n_docs) / (1 + df)) + 1) AS x FROM t)
SELECT doc_id, term, n, {Q6("x / sqrt(sum(x * x) OVER (PARTITION BY doc_id))")} AS tfidf FROM w
""",
)
def tfidf_batch(spark, sf):
    """Corpus TF-IDF with L2-normalised document vectors."""
    out = X.tfidf_batch(T(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", "term", "n", q6("tfidf").alias("tfidf"))
