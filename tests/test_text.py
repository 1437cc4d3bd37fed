"""Term counts and weights against plain versions, and where their rows travel."""

import math
import re
from collections import Counter, defaultdict

import pytest

from ordo.operators import text as X
from ordo.plans import session as S

TEXTS = [(i % 37, " ".join(f"w{(i * j) % 11} the" for j in range(1, i % 9))) for i in range(120)] + [(None, "the odd one"), (None, "the odd two"), (99, None), (98, "")]


def plain_counts(size=1):
    found = Counter()
    for i, text in TEXTS:
        words = re.findall(r"\w{2,}", text or "")
        found.update((i, " ".join(words[k : k + size])) for k in range(len(words) - size + 1))
    return found


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "i long, text string").repartition(6)


def exchanges(df):
    """Shuffles by key of a plan that has not run yet."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("size", [1, 2])
def test_terms_are_counted_where_their_document_is(spark, monkeypatch, docs, size):
    monkeypatch.setattr(X, "DOCS_PER_TASK", 10)  # more tasks than shuffle partitions
    bow = X.bag_of_words(docs, "i", "text", ngram_range=(size, size))
    assert exchanges(bow) == 1
    assert {(r.i, r.term): r.n for r in bow.collect()} == plain_counts(size)


@pytest.mark.parametrize("most", [None, "3"])
def test_tfidf_of_repeated_documents(spark, docs, most):
    """The same weights whether document frequencies are sent to all tasks or joined by term."""
    if most:
        spark.conf.set(S.CONF_BROADCAST_ROWS, most)
    try:
        out = X.tfidf_batch(docs, "i", "text")
        moved, got = exchanges(out), {(r.i, r.term): r.tfidf for r in out.collect()}
    finally:
        spark.conf.unset(S.CONF_BROADCAST_ROWS)
    counts = plain_counts()
    df, total = Counter(t for _, t in counts), defaultdict(int)
    for (i, _), n in counts.items():
        total[i] += n
    n_docs = len({i for i, _ in TEXTS})
    w = {(i, t): n / total[i] * (math.log((1 + n_docs) / (1 + df[t])) + 1) for (i, t), n in counts.items()}
    norm = defaultdict(float)
    for (i, _), x in w.items():
        norm[i] += x * x
    assert got == pytest.approx({(i, t): x / math.sqrt(norm[i]) for (i, t), x in w.items()})
    assert most or moved <= 2  # whole texts and the ids that are counted
