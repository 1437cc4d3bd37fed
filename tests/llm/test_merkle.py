"""The manifest against a plain tree built in Python."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from ordo.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """Top and the path of (left, right) siblings of every node."""
    paths = [[] for _ in nodes]
    owner = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 3, len(nodes))) for i in range(0, len(nodes), 3)]
        for run in runs:
            for i in run:
                step = ("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i))
                for k in owner[i]:
                    paths[k].append(step)
        owner = [sum((owner[i] for i in run), []) for run in runs]
        nodes = [h(*(nodes[i] for i in run)) for run in runs]
    return nodes[0], paths


def plain(rows):
    leaves = []
    for doc_id, text, lang, source, n in rows:
        made = lambda t: h(*map(field, (doc_id, source, lang, n, t)))
        bad = text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        leaves.append((source, doc_id, made(text), made(text.replace("\n", "") if bad else text)))
    groups = sorted({x[0] for x in leaves}, key=lambda s: (s is not None, (s or "").encode()))
    split = [sorted((x[1:] for x in leaves if x[0] == s), key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for s in groups]
    subs = [tree([x[1] for x in part]) for part in split]
    root, ups = tree([s[0] for s in subs])
    out = Counter()
    for part, (sub, paths), up in zip(split, subs, ups, strict=True):
        for (doc_id, leaf, bad), path in zip(part, paths, strict=True):
            steps, fold = path + up, bad
            for a, z in steps:
                fold = h(a, fold, z)
            out[(doc_id, leaf, sub, root, h(*(a + z for a, z in steps)), fold, fold == root)] += 1
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf int, g string, path string, at int"


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA)
    got = merkle.manifest_documents(docs).collect()
    assert Counter(tuple(r) for r in got) == (plain(rows) if rows else Counter())


@pytest.mark.parametrize("levels", [1, 2])
def test_many_rounds(spark, monkeypatch, levels):
    """Small blocks, so that groups take several rounds; sizes around powers of three."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    rng, rows, next_id = random.Random(levels), [], 0
    for s, n in enumerate([1, 2, 3, 4, 8, 9, 10, 27, 28, 40]):
        for _ in range(n):
            rows.append((next_id * 7, "\n".join("ab" for _ in range(rng.randint(0, 3))), "en", f"s{s}" if s else None, rng.choice([None, 5])))
            next_id += 1
    check(spark, rows)


def test_awkward_rows(spark):
    rows = [(None, None, None, None, None), (None, "a\nb", None, "", 1), (3, "", "en", "", 0), (3, "", "en", "", 0), (3, None, "en", "", 0)]
    rows += [(4, "é\n" * 200_000, "de", "Z", 9), (5, "x", "de", "é", 9), (6, "x\n", "de", "z", 9), (7, "\n", "de", "a" * 300, 9)]
    check(spark, rows)


def test_empty_and_single(spark):
    check(spark, [])
    check(spark, [(1, "one\ntwo", "en", "s", 7)])
