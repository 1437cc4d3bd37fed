"""Naive Bayes against a plain version."""

import math
import random
from collections import Counter

import pytest

from ordo.operators import learners as L


def plain(bow, docs, kind, a=1.0):
    """{id: (y, score)} by the textbook formulas, learnt from the other folds."""
    out, about = {}, {d: (y, f) for d, y, f in docs}
    words = {d: Counter({t: n for i, t, n in bow if i == d}) for d in about}
    for d, (_, fold) in about.items():
        if not words[d]:
            continue
        others = [(i, y) for i, (y, f) in about.items() if f != fold and y is not None]
        n, held, size = Counter(), Counter(), Counter(y for _, y in others)
        for i, y in others:
            for t, c in words[i].items():
                n[t, y] += c
                held[t, y] += 1
        terms = {t for t, _ in n}
        scores = {}
        for y in size:
            n_y = sum(c for (_, z), c in n.items() if z == y)
            prior = math.log(size[y] / len(others))
            if kind == "multinomial":
                scores[y] = prior + sum(c * math.log((n[t, y] + a) / (n_y + a * len(terms))) for t, c in words[d].items())
            elif kind == "bernoulli":
                q = {t: (held[t, y] + a) / (size[y] + 2 * a) for t in terms}
                scores[y] = prior + sum(math.log(1e-9 + (p if t in words[d] else 1 - p)) for t, p in q.items())
            else:
                total = {t: sum(n[t, z] for z in size) for t in words[d]}
                below = sum(n.values()) + a * len(terms) - n_y
                scores[y] = -sum(c * math.log((total[t] - n[t, y] + a) / below) for t, c in words[d].items())
        out[d] = max((s, y) for y, s in scores.items())
    return out


@pytest.mark.parametrize("kind", ["multinomial", "bernoulli", "complement"])
def test_naive_bayes_meets_terms_once(spark, kind, monkeypatch):
    """Few or many terms sent, few or many classes: the same as the plain version; the last join reads sums of documents, no counts of terms."""
    rng = random.Random(3)
    docs = [(i, rng.choice(["a", "b", "c", None]), i % 3) for i in range(40)]
    bow = [(i, t, rng.randint(1, 4)) for i, y, _ in docs for t in {*rng.sample("pqrstuvw", 3), (y or "a") * 2, f"only{i}"}]
    want = plain(bow, docs, kind)
    tables = spark.createDataFrame(bow, "id long, term string, n long"), spark.createDataFrame(docs, "id long, y string, fold int")
    for sent, wide in ((None, 50), (8, 50), (0, 1)):
        if sent is not None:
            spark.conf.set("ordo.broadcastRows", str(sent))
        if hasattr(L, "WIDE"):
            monkeypatch.setattr(L, "WIDE", wide)
        try:
            out = L.naive_bayes(*tables, "id", "y", kind, fold="fold")
            got = {r["id"]: (r["score"], r["y_pred"]) for r in out.collect()}
        finally:
            spark.conf.unset("ordo.broadcastRows")
        assert got.keys() == want.keys()
        for d, (score, y) in want.items():
            assert got[d][0] == pytest.approx(score) and got[d][1] == y
        assert "ordo-counts" not in out._jdf.queryExecution().toString()
