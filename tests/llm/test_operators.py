"""Each operator against a plain version on small tables with awkward rows."""

import collections
import hashlib
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from ordo.llm import bpe, decontaminate, html_text, jaccard, langid, licenses, quality, secrets, sharding, suffixes
from ordo.llm.trigrams import trigram_query

ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "#"), (None, "a b c"), (None, None), (904, "same row"), (904, "same row")]
RNG = random.Random(11)
VOCAB = [f"w{i}é" for i in range(700)]


def prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_suffix_order_is_sorted():
    texts = [bytes(RNG.choice(b"ab\xff") for _ in range(RNG.randint(0, 30))) for _ in range(40)]
    owner, start = suffixes.suffix_order(texts)
    found = [texts[i][j:] for i, j in zip(owner, start, strict=True)]
    assert found == sorted(t[j:] for t in texts for j in range(len(t)))


def test_repeats_match_brute_force(shape):
    shared = prose(80)
    rows = [(i, prose(RNG.randint(0, 60)) + shared[RNG.randint(0, 200) :] + prose(RNG.randint(0, 60))) for i in range(25)]
    rows += [(200, "x" * 199), (201, "x" * 200), (202, "y" * 201), (203, "ab" * 300), (204, rows[3][1]), *ODD]
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(shape(rows)).collect())
    seen = collections.Counter(b[j : j + 200] for _, t in rows if (b := (t or "").encode()) for j in range(len(b) - 199))
    want = collections.Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 199):
            if seen[b[j : j + 200]] > 1:
                gone[j : j + 200] = b"\x01" * 200
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        want[(i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())] += 1
    assert got == want


def test_leaks_whole_edited_and_none(spark, shape):
    items = [(k, prose(30)) for k in range(10)] + [(50, "zzz yyy"), (51, None), (52, "")]
    rows = [(k, prose(40) + " " + t + " " + prose(40)) for k, t in items[:10]]
    for k, t in items[:10]:  # every seventh word replaced
        rows.append((100 + k, prose(20) + " " + " ".join("other" if i % 7 == 3 else w for i, w in enumerate(t.split())) + " " + prose(9)))
    rows += [(300, "ZZZ, yyy!")] + [(400 + k, prose(80)) for k in range(20)] + ODD
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaked_documents(shape(rows), bench).collect()}
    assert got == {(k, k) for k in range(10)} | {(100 + k, k) for k in range(10)} | {(300, 50)}
    blocks = {(r.doc_id, r.item_id) for r in decontaminate.leaked_documents(shape(rows), bench, block_words=100).collect()}
    assert blocks == got
    assert decontaminate.leaked_documents(shape(rows), bench.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [8, 30])
def test_half_an_item_leaks_however_often(spark, shape, copies):
    item, other = prose(40), prose(40)
    half = " ".join(item.split()[:20])
    rows = [(k, prose(30) + " " + half + " " + prose(30)) for k in range(copies)] + [(500, prose(80))]
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.score) for r in decontaminate.leaked_documents(shape(rows), bench).collect()}
    assert {g[:2] for g in got} == {(k, 1) for k in range(copies)} and all(g[2] >= 0.5 for g in got)


def test_blocks_of_items_are_bounded(spark, shape):
    texts = ["".join(RNG.choice("БГДЖЗИЛ") for _ in range(5)) for _ in range(400)]
    items = [(k, " ".join(RNG.choice(texts) for _ in range(25))) for k in range(40)] + [(90, "NO LOWER CASE " * 5)] + [(91, "same item of five words")] * 30
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.distinct_items(bench, "item_id", "text")
    assert {r.i: (r.copies, r.n) for r in rows.collect()} == {k: (1, 25) for k in range(40)} | {90: (1, 15), 91: (30, 5)}
    found = decontaminate.blocks(rows, 200)
    assert len(found) > 4 and sum(b[3] for b in found) == 40 * 25 + 20 and all(b[3] <= 200 for b in found)
    assert all(a[2] < b[1] for a, b in zip(found, found[1:]))
    got = decontaminate.leaked_documents(shape([(5, items[3][1]), (6, "the same item of five words")]), bench, block_words=400).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(5, 3)] + [(6, 91)] * 30


def test_main_text():
    page = (
        "<html><head><title>t</title><script>x()</script></head><body><nav><a>Home</a></nav><div class='cookie-notice'>We use "
        "cookies to make this site work for you and for us</div><article><h1>T &amp; T</h1><p>One  <b>two</b>\nthree.<p>Four</article>"
        "<aside>side</aside><div id=comments><p>Great post</div><form>name</form><footer>&copy; me</footer></body></html>"
    )
    assert html_text.main_text(page) == "T & T\nOne two three.\nFour"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p>  ") == ""
    plain = "<body><div class=menu>a b</div><div id=c><p>" + "word " * 40 + "<p>end</div></body>"
    assert html_text.main_text(plain) == ("word " * 40).strip() + "\nend"


def test_main_text_keeps_short_parts_of_a_region():
    long = ("word " * 40).strip()
    parts = f"<p>{long}</p><ul><li>milk<li>two eggs</ul><p>{long}</p><table><tr><td>a<td>1<tr><td>b<td>2</table><blockquote>so it goes"
    parts += f"</blockquote><dl><dt>k<dd>v</dl><figure><figcaption>cap</figcaption></figure><pre>x = 1</pre><div><div><p>end</div></div><p>{long}</p>"
    want = "\n".join([long, "milk", "two eggs", long, "a", "1", "b", "2", "so it goes", "k", "v", "cap", "x = 1", "end", long])
    menu = "<div><ul><li><a>Home</a><li><a>News</a><li><a>Shop</a></ul></div>"
    for page in (f"<body>{menu}<div id=c>{parts}</div></body>", f"<body>{menu}<section><div>{parts}</div></section>"):
        assert html_text.main_text(page) == want
    page = f"<body>{menu}<main><p>intro</p><article><p>{long}</p></article><p>between</p><article><p>short</p></article></main>{menu}"
    assert html_text.main_text(page) == f"intro\n{long}\nbetween\nshort"
    assert html_text.main_text(f"<div>{menu}<div><div><p>{long}<p>{long}</div><ul><li>a<li>b<li>c<li>d</ul><div><p>{long}<p>{long}</div></div></div>") == "\n".join([long, long, *"abcd", long, long])


def test_main_text_of_marked_wrappers_and_open_heads():
    long = ("word " * 40).strip()
    wrappers = ("class='content with-sidebar'", "id='layout-nav-left'", "class='search-result'", "class='content sidebar'", "class='notice'", "role=search")
    for attrs in wrappers:
        assert html_text.main_text(f"<body><nav>a b</nav><div {attrs}><article><p>{long}<p>end</article></div>") == f"{long}\nend"
        assert html_text.main_text(f"<body><nav>a b</nav><div {attrs}><p>{long}<p>end</div>") == f"{long}\nend"
    assert html_text.main_text(f"<body><form id=f><nav>a b</nav><p>{long}<p>end</form>") == f"{long}\nend"
    assert html_text.main_text(f"<body><form id=f><nav>a b</nav><article><p>{long}<p>end</article></form><p>2020") == f"{long}\nend"
    for head in ("<head><meta charset=x><title>t</title><style>p{}</style>", "<head><title>t</title>"):
        for body in ("<body>", ""):
            assert html_text.main_text(f"<html>{head}{body}<p>{long}<p>end") == f"{long}\nend"
    assert html_text.main_text("<head><title>t</title>just text") == "just text"
    # comments and teasers do not come in beside an article
    article, teaser = f"<article><p>{long}<p>end</article>", f"<article><p>{long} teaser</article>"
    assert html_text.main_text(f"{article}<div class=related>{teaser}</div><ol class=comments><li>{teaser}</ol>") == f"{long}\nend"
    assert html_text.main_text(f"<div><p>{long}<p>end</div><div id=comments>{teaser}</div>") == f"{long}\nend"


def test_main_text_without_clear_clusters():
    """Paragraphs of about one length, short sections, short articles: nothing of them goes."""
    long = ("word " * 40).strip()
    for n in (2, 3, 4, 5):
        parts = [f"{long} {'more ' * i}end" for i in range(n)]
        assert html_text.main_text("<body>" + "".join(f"<div><p>{t}</p></div>" for t in parts)) == "\n".join(parts)
    page = f"<body><div><h2>Head A</h2><p>{long}</p></div><div><h2>Head B</h2><p>short</p></div>"
    assert html_text.main_text(page) == f"Head A\n{long}\nHead B\nshort"
    page = "<body><article><h1>T</h1><p>short one</p></article><div><p>some text that is longer</p></div>"
    assert html_text.main_text(page).startswith("T\nshort one")
    assert html_text.main_text(f"<article><h1>T</h1><p>{long}</p></article><div><p>{long}</p></div>") == f"T\n{long}"


def test_main_text_leaves_out_marked_names():
    long = ("word " * 40).strip()
    names = "site-header site-footer sidebar-left comment-list user-comments ad-slot advert-box cookie-bar main-nav siteFooter ad_unit".split()
    for name in names:
        for attr in ("class", "id"):
            assert html_text.main_text(f"<body><div {attr}={name}><p>{long} no</p></div><div><p>{long}</p><p>end</p></div>") == f"{long}\nend", name
    for name in ("entry-header", "article-list", "main", "container", "left-column", "read-more", "page-title"):
        assert html_text.main_text(f"<body><div class={name}><p>{long}</p></div>") == long


def test_main_text_of_unclosed_tags_is_linear():
    for page in ("<ul><li>a" * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 100_000, "<p><b>x" * 100_000 + "</div>" * 100_000):
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 8


def test_pages_keep_rows(spark):
    rows = [(1, "u", "<article><p>some text of a page</article>"), (1, "u", None), (None, None, ""), (2, "u", "<p>cut &am")]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in got) == ["", "", "cut &am", "some text of a page"]
    assert all(r.n_chars == len(r.text) for r in got)


def test_shards_are_even_and_gapless(shape):
    rows = [(i, prose(RNG.randint(1, 30))) for i in range(300)] + [(1000 + i, "one hot text " * 5) for i in range(200)] + ODD
    got = sharding.shard_documents(shape(rows)).collect()
    assert len(got) == len(rows)
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(size) == set(range(8)) and max(size.values()) - min(size.values()) <= 2 * max(r.size for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert text == collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got)
    assert sharding.shard_documents(shape([])).count() == 0


def test_trigram_queries():
    assert trigram_query(r"[0-9a-f]+") is None
    assert trigram_query(r"ab?c") is None
    assert trigram_query(r"abcd") == {frozenset(("abc", "bcd"))}
    assert trigram_query(r"(?i)(TOKEN|key)\s*=") == {frozenset(("tok", "oke", "ken")), frozenset(("key",))}


def test_secrets_match_plain_regexes(shape):
    keys = ["token = 'abcdef1234'", "API-key: x", "api_key=\"ABCDEFGH\"", "AKIA" + "Z9" * 8, "AKIAshort", "0f" * 12, "0f" * 11, "token=token: abcdefgh", "é passwd : s3cr3t-s3cr3t x"]
    rows = [(i, prose(RNG.randint(0, 20)) + " " + " ".join(RNG.sample(keys, 3)) + " " + prose(3)) for i in range(60)]
    rows += [(500, " ".join(f"{i:024x}" for i in range(700)))] + ODD
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = collections.Counter()
    for i, t in rows:
        t = t or ""
        spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        n = collections.Counter(s[1] for s in spans)
        want[(i, n[0], n[1], n[2], hashlib.sha256(",".join(s[2] for s in sorted(spans)).encode()).hexdigest())] += 1
    got = collections.Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.scan_documents(shape(rows)).collect())
    assert got == want
    clean = {r.doc_id: r.text for r in secrets.redact(shape([(1, "x token = abcdef12 y " + "0f" * 12), (2, None), (3, "plain")])).collect()}
    assert clean == {1: "x [SECRET] y [SECRET]", 2: None, 3: "plain"}


def test_quality_measures(shape):
    rows = [(i, "\n".join(RNG.choice([prose(5), "again and again", "", "  ", "# $"]) for _ in range(RNG.randint(1, 25)))) for i in range(60)] + ODD
    want = collections.Counter()
    for i, t in rows:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = collections.Counter(windows)
        cover = {k + d for k, x in enumerate(windows) if n[x] > 1 for d in range(3)}
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover), failed)] += 1
    got = quality.judge_documents(shape(rows)).collect()
    assert want == collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert not any(r.kept and r.base_failed for r in got)


def test_bad_hosts_lose_their_documents(spark):
    good, bad = [(i, prose(80), "good") for i in range(50)], [(100 + i, "too short", "bad") for i in range(60)] + [(999, prose(80), "bad"), (998, prose(80), None)]
    got = {r.doc_id: r.kept for r in quality.judge_documents(spark.createDataFrame(good + bad, "doc_id long, text string, source string")).collect()}
    assert all(got[i] for i in range(50)) and not got[999] and got[998]


def test_quality_sql_gives_the_same_rows(spark):
    import duckdb

    rows = [(i, "\n".join(RNG.choice([prose(9), "again and again", "", " \t", "# $"]) for _ in range(RNG.randint(1, 25))), f"h{i % 7}") for i in range(80)]
    rows += [(100 + i, "too short", "bad") for i in range(60)] + [(999, prose(80), "bad"), (998, prose(80), None)] + [(i, t, None) for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    db = duckdb.connect()
    db.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    want = collections.Counter(db.execute(quality.oracle_sql()).fetchall())
    assert collections.Counter(tuple(r) for r in quality.judge_documents(docs).collect()) == want
    assert any(not r[-1] and not r[-2] for r in want)


def test_licenses(shape):
    texts = ["Released under the MIT License.", "the Apache\nLicense, Version 2.0 and CC-BY, cc by", "MITLicense mit_license gnu general public license", "SPDX-License-Identifier: BSD-3-Clause"]
    rows = [(i, prose(4) + " " + t) for i, t in enumerate(texts)] + ODD
    got = {r.doc_id: r for r in licenses.scan_documents(shape(rows)).collect() if r.doc_id is not None}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (1, 7, 7, "mit")
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 5, 13, "apache,cc-by")
    assert got[2].n_base == 2 and got[2].base_labels == "gpl,mit"
    assert got[3].n_base == 0 and "bsd-3-clause" in got[3].labels.split(",")
    assert (got[900].n_words, got[900].n_base, got[900].first_word, got[900].labels, got[900].score) == (0, 0, None, "", 0.0)
    assert len(licenses.rules()) > 200


def samples(parsed):
    """Texts that a parsed pattern matches, one at least of every alternative."""
    out = [""]
    for kind, x in parsed:
        name = str(kind)
        if name == "BRANCH":
            more = [t for branch in x[1] for t in samples(branch)]
        elif name == "SUBPATTERN":
            more = samples(x[3])
        elif name == "MAX_REPEAT":
            more = [""] * (x[0] == 0) + samples(x[2])
        elif name == "IN":
            more = [chr(v) if str(k) == "LITERAL" else "1" for k, v in x]
        else:
            more = [chr(x)] if name == "LITERAL" else [""]
            assert name in ("LITERAL", "ASSERT_NOT")
        out = [a + b for a in out for b in more]
    return out


def test_every_alternative_opens_its_license_rule(shape):
    for label, keywords, _, pattern in licenses.rules():
        for text in samples(re._parser.parse(pattern)):
            assert set(text.split()) & set(keywords.split()), (label, keywords, text)
    texts = {"FreeBSD License": "bsd-2-clause", "licensed under Open RAIL-M": "openrail", "GPLv2": "gpl-2", "under GPLv3+": "gpl-3", "LGPLv2.1": "lgpl-2.1", "LGPLv3": "lgpl-3", "GNU AGPLv3": "agpl-3", "covered by the GPL2": "gpl,gpl-2"}
    got = {r.doc_id: (r.labels, r.n_base) for r in licenses.scan_documents(shape(list(enumerate(texts)))).collect()}
    assert got == {i: (labels, 0) for i, labels in enumerate(texts.values())}


def plain_components(rows):
    sets = []
    for _, t in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return sets, label


def test_jaccard_matches_brute_force(shape):
    shared, base = prose(110), prose(180).split()
    rows = [(5000 + i, prose(RNG.randint(3, 60)) + " " + shared + " " + prose(RNG.randint(3, 60))) for i in range(60)]
    for i in range(60):
        copy = list(base)
        for _ in range(RNG.randint(0, 6)):
            copy[RNG.randrange(len(copy))] = RNG.choice(VOCAB)
        rows.append((6000 + i, " ".join(copy)))
    for k, n in enumerate((4, 5, 8, 12, 60, 250, 300, 520, 600)):
        text = prose(n).split()
        for i in range(6):
            rows.append((100 * k + i, " ".join(text + prose(i * n // 16).split())))
    rows += [r for r in ODD if r[0] is not None]
    sets, label = plain_components(rows)
    smallest = {c: min(i for (i, _), x in zip(rows, label, strict=True) if x == c) for c in set(label)}
    want = collections.Counter((i, len(s), smallest[c] if s else i) for (i, _), s, c in zip(rows, sets, label, strict=True))
    table = shape(rows)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(table).collect()) == want
    kept = [r.doc_id for r in jaccard.keep_one(table).collect()]
    assert sorted(kept) == sorted([smallest[c] for c in set(label) if any(s and x == c for s, x in zip(sets, label, strict=True))] + [i for (i, _), s in zip(rows, sets, strict=True) if not s])


def test_jaccard_of_a_set_with_too_few_parts(shape):
    text = prose(4).split()
    while len(text) < 264:  # every shingle hash in the upper half, where a set of 260 has no parts
        tries = [RNG.choice(VOCAB) for _ in range(40)]
        found = jaccard.shingle_sets(pa.array([" ".join([*text[-4:], w]) for w in tries]))
        text.append(next(tries[i] for i, h in found if int(h[0]) >> 60 > 8))
    hashes = next(h for _, h in jaccard.shingle_sets(pa.array([" ".join(text)])))
    assert any(len(sigs) <= k for _, k, sigs in jaccard.signatures(hashes, 80))
    rows = [(1, " ".join(text)), (2, " ".join([*text[:-1], "other"])), (3, " ".join([*text[:130], "other", *text[131:]])), (4, prose(264)), (5, "")]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(shape(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_jaccard_of_a_large_family(shape, monkeypatch):
    """Copies with more and more edits, some near to each other only; a component is compared in several blocks."""
    monkeypatch.setattr(jaccard, "MEMBERS", 3)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]

    def edited(n):
        text = list(base)
        for at in rng.sample(range(120), n):
            text[at] = f"e{rng.randint(0, 10**9)}"
        return text

    rows = [(i, " ".join(edited(i % 6))) for i in range(60)]
    for i in range(12):
        far = edited(5)
        rows += [(100 + 2 * i, " ".join(far)), (101 + 2 * i, " ".join([*far, "x", "y"]))]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(shape(rows)).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows if (w := t.split())}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert got == label and 1 < len(set(label.values())) < 60


def test_jaccard_of_copies_that_meet_nobody(shape, monkeypatch):
    """Copies edited each in its own way, too far from their original: no visits by the square of the family."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 31):
        text = list(base)
        for at in rng.sample(range(400), 6 if i % 3 == 0 else 16):
            text[at] = f"e{i}x{at}"
        rows.append((i, " ".join(text)))
    seen = {}

    def counted(df, name):
        seen[name] = materialize(df, name)
        return seen[name]

    materialize = jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", counted)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(shape(rows)).collect()}
    sets, label = plain_components(rows)
    assert got == {i: min(j for (j, _), y in zip(rows, label, strict=True) if x == y) for (i, _), x in zip(rows, label, strict=True)}
    assert 15 < len(set(label)) and ("visits" not in seen or seen["visits"].count() < 10)


def test_jaccard_of_copies_next_to_a_family(shape, monkeypatch):
    """Copies a little too far from a family and from each other meet the family, not each other one by one."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(90):
        text, n = list(base), 1 if i < 6 else 2 if i < 36 else 3
        for k in range(n):
            at = 5 + k * 140 // n + rng.randrange(140 // n - 5)
            text[at] = f"e{i}x{at}"
        rows.append((i, " ".join(text)))
    seen, materialize = {}, jaccard.materialize

    def counted(df, name):
        seen[name] = materialize(df, name)
        return seen[name]

    monkeypatch.setattr(jaccard, "materialize", counted)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(shape(rows)).collect()}
    sets, label = plain_components(rows)
    assert got == {i: min(j for (j, _), y in zip(rows, label, strict=True) if x == y) for (i, _), x in zip(rows, label, strict=True)}
    assert 15 < len(set(label)) and seen["visits"].count() < 150


def test_held_signatures_find_every_near_pair():
    """The one with less slack of two sets that share enough looks for a part its partner is found by."""
    rng = np.random.default_rng(4)
    met = 0
    for trial in range(3000):
        a = rng.integers(0, 1 << 63, int(rng.choice([4, 9, 30, 146, 700])), dtype=np.uint64) * np.uint64(2)
        size = {0: int(len(a) * rng.uniform(1, 1.25)), 1: 0}
        lost = rng.random(len(a)) < rng.choice([0.0, 0.02, 0.08])
        b = np.concatenate([a[~lost], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(a) // 9)), dtype=np.uint64)])
        size[1] = int(len(b) * rng.uniform(1, 1.15))
        if 180 * len(np.intersect1d(a, b)) < 80 * (size[0] + size[1]):
            continue
        met += 1
        sides = [(180 * len(h) - 160 * n, *jaccard.held_signatures(np.sort(h), n, 80)) for h, n in ((a, size[0]), (b, size[1]))]
        (_, _, guest), (_, host, _) = sorted(sides, key=lambda x: x[0])
        assert len(np.intersect1d(guest, host))
    assert met > 500


def test_shingle_sets_hold_little_at_once():
    texts = pa.array([prose(1500) for _ in range(200)])
    for value in (None, *texts[:3].to_pylist()):
        list(jaccard.shingle_sets(pa.array([value], pa.string())))  # powers are kept
    tracemalloc.start()
    assert sum(1 for _ in jaccard.shingle_sets(texts)) == 200
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.nbytes > 1 << 20 and peak < 24 << 20


def test_keep_one_keeps_clashing_columns(spark):
    rows = [(1, "a b c d e f", "k1", 1), (2, "a b c d e f", "k2", 2), (3, None, "k3", 3), (4, "", "k4", 4)]
    for names in ("doc_id long, text string, _key string, _id int", "doc_id long, text string, key string, comp int", "doc_id long, text string, cid string, c0 int"):
        table = spark.createDataFrame(rows, names)
        assert sorted(map(tuple, jaccard.keep_one(table).collect())) == [rows[0], rows[2], rows[3]]
    assert jaccard.keep_one(table.limit(0)).columns == table.columns


def test_jaccard_edges(shape):
    got = jaccard.jaccard_components(shape([(None, "a b c d e f"), (None, "a b c d e f"), (7, "A b c d e f"), (None, "q")])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == [(-1, 1, -1), (-1, 2, 7), (-1, 2, 7), (7, 2, 7)]
    assert jaccard.jaccard_components(shape([])).count() == 0


def test_bpe_matches_library(shape):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    pool = "aeiou thnsrTHE'sdll  \n\t\x0b\x1c\x85  éßñ漢字🙂٣½0123ǅʰ̀‍_-#*"
    texts = ["".join(RNG.choice(pool) for _ in range(RNG.randint(0, 50))) for _ in range(400)] + ["x<|endoftext|> y", "a" * 5000, " " * 3000 + "b"]
    rows = list(enumerate(texts)) + ODD
    got = collections.Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in bpe.bpe_encode(shape(rows), path, with_ids=True).collect())
    want = collections.Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), tuple(ids), t or "")] += 1
    assert got == want


def test_long_text_is_split_the_same(monkeypatch):
    codec = bpe.codec(public_tokenizers.path("byte_bpe_50k.json"))
    text = prose(3000)
    whole = codec.encode(text)
    monkeypatch.setattr(bpe, "WINDOW", 64)
    assert codec.encode(text) == whole and codec.decode(whole, block=100) == text.encode()


def test_languages_held_out(spark, shape):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify_documents(docs).collect()
    held = [r for r in got if r.held_out]
    assert held and all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    odd = langid.identify_documents(shape([(1, "the text"), *ODD])).collect()
    assert len(odd) == 1 + len(ODD) and all(r.lang_pred == "und" and r.score == 0 for r in odd if r.doc_id in (900, 901, 902, 903))
    assert langid.identify_documents(shape([])).count() == 0


@pytest.mark.parametrize("operator", ["remove_repeats", "scan_documents", "judge_documents"])
def test_empty_tables(shape, operator):
    module = {"remove_repeats": suffixes, "scan_documents": secrets, "judge_documents": quality}[operator]
    assert getattr(module, operator)(shape([])).count() == 0
