"""The search against plain scores of every document."""

import math
import random
import re
from collections import Counter

import pytest

from ordo.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain(docs, items, k):
    held = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        found = []
        for doc_id, c in held:
            m = 75 + 25 * c.total() * n_docs // n_terms
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((score, doc_id))
        found = sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item, r, d, s) for r, (s, d) in enumerate(found, 1)]
    return Counter(out)


def check(spark, docs, items, k=20, **more):
    table = spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in docs], "doc_id long, text string, rank int, score int, item_id string, n int").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    assert Counter(tuple(r) for r in lexical.search(table, asked, k, **more).collect()) == plain(docs, items, k)


@pytest.mark.parametrize("k,block_words", [(1, 16384), (5, 60), (20, 16384)])
def test_random_corpus(spark, monkeypatch, k, block_words):
    """Skewed words, copies and quoted items; shards of a few documents."""
    monkeypatch.setattr(lexical, "CELLS", 1)
    rng = random.Random(k)
    words = [f"w{i}" for i in range(120)]
    prose = lambda n: " ".join(words[min(int(rng.expovariate(0.06)), 119)] for _ in range(n))
    items = [(i, prose(rng.randint(1, 25))) for i in range(12)]
    docs = [(i, prose(rng.randint(0, 90))) for i in range(700)]
    docs += [(1000 + i, items[i % 12][1] + " " + prose(i)) for i in range(40)] + [(2000 + i, docs[7][1]) for i in range(50)]
    check(spark, docs, items, k, block_words=block_words)


def test_awkward_rows(spark):
    docs = [(1, None), (2, ""), (3, "!?"), (None, "Über alles"), (4, "über ALLES"), (4, "über ALLES"), (5, "ÜBER alles"), (6, "a_b-c 1\x002"), (7, "x " * 300_000 + "alles")]
    items = [(1, "ÜBER über über"), (1, "alles"), (1, "alles"), (2, None), (3, ""), (4, "nowhere"), (None, "b 2"), (5, "x X y")]
    check(spark, docs, items)


def test_empty_tables(spark):
    check(spark, [], [(1, "a")])
    check(spark, [(1, "a")], [])
    check(spark, [(1, None)], [(1, "a")])
    check(spark, [(1, "a")], [(1, "a")])
