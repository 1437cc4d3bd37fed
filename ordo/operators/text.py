"""Vectorisers over a document table.

Documents become a long (doc, term, count) table by ``explode`` +
aggregation — the sparse document-term matrix in relational form.  Whole texts
are dealt by document first, so terms are counted, joined with what is known
of their document and weighed there without another shuffle; tables of one row
a term are sent to all tasks if small.  Running TF-IDF (the online form, where document frequencies and the
document count include the current document) takes document frequencies as
a running count per term over document order; frequent terms are hot keys
and are split into order blocks by the running helper.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.stats import Stat
from ..plans.rows import written
from ..plans.session import sent_if_few
from .sequence import row_number
from .windows import running

DOCS_PER_TASK = 2_000


def bag_of_words(df: DataFrame, id_col: str, text_col: str, lowercase: bool = True, accents: bool = False,
                 ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    """(id, term, n): term counts per document, all rows of one in the same partition."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.select(id_col, text_col).repartition(max(least, -(-df.count() // DOCS_PER_TASK)), id_col)
    toks = TX.tokens(F.col(text_col), lowercase, accents)
    if ngram_range != (1, 1):
        # a lambda variable is computed once, so an n-gram does not tokenise again
        toks = F.flatten(F.transform(F.array(toks), lambda t: TX.ngrams(t, ngram_range)))
    # the outer form, since Spark guards the inner one with a filter that tokenises once more
    terms = df.select(id_col, F.explode_outer(toks).alias("term")).filter(F.col("term").isNotNull())
    return terms.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n"))


def tfidf_batch(df: DataFrame, id_col: str, text_col: str, normalize: bool = True, **kw) -> DataFrame:
    """TF-IDF over the whole corpus: idf = ln((1+N)/(1+df)) + 1."""
    bow = bag_of_words(df, id_col, text_col, **kw)
    n_docs = df.select(id_col).distinct().agg(F.count(F.lit(1)).alias("n_docs"))
    dfs = written(bow.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms")
    t = bow.join(sent_if_few(dfs, dfs.count()), "term").join(n_docs.withColumn("_k", F.lit(0)), F.lit(0) == F.col("_k")).drop("_k")
    return _weights(t, id_col, normalize)


def tfidf_running(df: DataFrame, id_col: str, text_col: str, order, normalize: bool = True, **kw) -> DataFrame:
    """Online TF-IDF of each document as it arrives (counts include it)."""
    docs = row_number(df.select(id_col, *([order] if isinstance(order, str) else order)), None, order, "n_docs")
    t = written(bag_of_words(df, id_col, text_col, **kw).join(docs.select(id_col, "n_docs"), id_col), "terms")
    t = t.withColumn("_one", F.lit(1.0))
    t = running(t, {"df": Stat.of("count", "_one")}, by="term", order="n_docs").drop("_one")
    return _weights(t, id_col, normalize)


def _weights(t: DataFrame, id_col: str, normalize: bool) -> DataFrame:
    wdoc = Window.partitionBy(id_col)
    t = t.withColumn("_terms", F.sum("n").over(wdoc))
    w = (F.col("n") / F.col("_terms")) * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)
    t = t.withColumn("tfidf", w)
    if normalize:
        t = t.withColumn("tfidf", F.col("tfidf") / F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf")).over(wdoc)))
    return t.select(id_col, "term", "n", "tfidf")
