"""DuckDB SQL for the rows of operators that SQL can express, over whole ``documents``."""

from __future__ import annotations

import re

from . import quality
from .secrets import BASE, MORE, Rule


def suffix_dedup_sql(length: int = 200) -> str:
    """Rows of ``suffixes.remove_repeats``: every window of every text, counted.

    Texts are written in hexadecimal, so that two digits are a byte, and cut
    into stretches of 500 windows, since places in long strings are slow.
    """
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
v AS (SELECT rid, x, unnest(range(0, greatest(CAST(length(x) // 2 AS BIGINT) - {length - 1}, 0), 500)) AS lo FROM d),
y AS (SELECT rid, lo, substr(x, 2 * lo + 1, {2 * (500 + length - 1)}) AS x FROM v),
p AS (SELECT rid, lo, x, unnest(range(0, CAST(length(x) // 2 AS BIGINT) - {length - 1})) AS i FROM y),
w AS (SELECT rid, lo + i AS i, md5(substr(x, 2 * i + 1, {2 * length})) AS h FROM p),
t AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
r AS (SELECT rid, i FROM w SEMI JOIN t USING (h)),
b AS (SELECT rid, i, CAST(i > coalesce(lag(i) OVER a, -{length + 1}) + {length} AS INT) AS new FROM r WINDOW a AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS n FROM b),
s AS (SELECT rid, n, min(i) AS a, max(i) + {length} AS z FROM c GROUP BY rid, n),
g AS (SELECT rid, a, z, coalesce(lag(z) OVER o, 0) AS y FROM s WINDOW o AS (PARTITION BY rid ORDER BY a)),
k AS (SELECT rid, string_agg(substr(x, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) AS head, CAST(sum(z - a) AS BIGINT) AS gone, count(*) AS spans,
        max(z) AS tail FROM g JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(gone, 0) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""


def either_case(pattern: str) -> str:
    """``(?i)pattern`` for ASCII letters alone, written out; character classes stay as they are."""
    out, depth = [], 0
    for token in re.findall(r"\\x[0-9A-Fa-f]{2}|\\.|.", pattern.removeprefix("(?i)")):
        depth += (token == "[") - (token == "]")
        out.append(f"[{token.upper()}{token}]" if not depth and token.isalpha() else token)
    return "".join(out)


def plain_pattern(rule: Rule) -> str:
    """A rule's pattern without look-around, folding and ``\\s``, which engines read differently."""
    pattern = either_case(rule.pattern) if rule.pattern.startswith("(?i)") else rule.pattern
    if rule.kind == "hex":  # runs of digits; short ones go by the rule's least length
        pattern = "[0-9a-f]+"
    return pattern.replace(r"\s", r"\x20\x09-\x0D").replace("'", "''")


def secret_scan_sql(rules: tuple[Rule, ...] = BASE + MORE) -> str:
    """Rows of ``secrets.scan_documents``: all matches of all rules in all texts, without an index."""
    parts = " UNION ALL ".join(
        f"SELECT rid, {order} AS o, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{plain_pattern(r)}') AS hits,"
        f" regexp_extract_all(t, '{plain_pattern(r)}', {r.group}) AS said, string_split_regex(t, '{plain_pattern(r)}') AS gaps FROM d"
        for order, r in enumerate(rules)
    )
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in BASE)
    found = "kind || ':' || a || ':' || z"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({parts}),
u AS (SELECT rid, o, kind, least, unnest(hits) AS hit, unnest(said) AS s, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i
      FROM m WHERE len(hits) > 0),
e AS (SELECT rid, o, kind, least, s, length(hit) AS n, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY rid, o ORDER BY i) AS BIGINT) AS z FROM u),
f AS (SELECT rid, o, kind, z - n AS a, z FROM e WHERE length(s) >= least),
g AS (SELECT rid, {counts}, string_agg({found}, ',' ORDER BY a, o, z) FILTER (WHERE o < {len(BASE)}) AS base,
        string_agg({found}, ',' ORDER BY a, o, z) AS spans FROM f GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


def jaccard_join_sql(width: int = 5, percent: int = 80) -> str:
    """Rows of ``jaccard.jaccard_components``: links from counted common shingles, components by reachability."""
    gram = " || ' ' || ".join(["x", *[f"lead(x, {k}) OVER a" for k in range(1, width)]])
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
      FROM documents),
p AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d WHERE len(w) >= {width}),
g AS (SELECT rid, {gram} AS gram FROM p WINDOW a AS (PARTITION BY rid ORDER BY i)),
f AS (SELECT DISTINCT rid, gram FROM g WHERE gram IS NOT NULL
      UNION ALL SELECT rid, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {width - 1}),
c AS (SELECT rid, count(*) AS n, md5(string_agg(gram, chr(10) ORDER BY gram)) AS h FROM f GROUP BY rid),
k AS (SELECT h, min(rid) AS rid, min(n) AS n FROM c GROUP BY h),
s AS (SELECT h, n, gram FROM k JOIN f USING (rid)),
o AS (SELECT x.h AS a, y.h AS b, count(*) AS met, min(x.n) + min(y.n) AS total
      FROM s x JOIN s y ON x.gram = y.gram AND x.h < y.h GROUP BY x.h, y.h),
l AS (SELECT a, b FROM o WHERE 100 * met >= {percent} * (total - met)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(h, other) AS (SELECT h, h FROM k UNION SELECT reach.h, e.b FROM reach JOIN e ON reach.other = e.a),
least_id AS (SELECT h, min(doc_id) AS doc_id FROM c JOIN d USING (rid) GROUP BY h),
label AS (SELECT reach.h, min(least_id.doc_id) AS component_id FROM reach JOIN least_id ON reach.other = least_id.h GROUP BY reach.h)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles,
  CASE WHEN c.h IS NULL THEN d.doc_id ELSE label.component_id END AS component_id
FROM d LEFT JOIN c USING (rid) LEFT JOIN label ON c.h = label.h
"""


def merkle_manifest_sql() -> str:
    """Rows of ``merkle.manifest_documents``: the tree level by level, then each row's fold along its path."""

    def field(value: str) -> str:
        return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    byte = "list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, {})"
    crc = f"""list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
             lambda a, b: xor(a // 256, {byte.format("xor(a, b) % 256")}), CAST(4294967295 AS BIGINT))"""
    step = "SELECT x.{0}, t.lvl, string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos < x.pos // t.scale) AS l, string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos > x.pos // t.scale) AS r"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, '') AS g, {leaf("text")} AS leaf,
    {leaf("replace(text, chr(10), '')")} AS bare, doc_id IS NOT NULL AND xor({crc}, 4294967295) % 2 = 0 AS picked FROM documents),
x AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos FROM d),
tree(lvl, scale, g, pos, h, size) AS (
  SELECT 0, CAST(1 AS BIGINT), g, pos, leaf, count(*) OVER (PARTITION BY g) FROM x
  UNION ALL
  SELECT lvl, scale, g, pos, h, count(*) OVER (PARTITION BY g) FROM (
    SELECT lvl + 1 AS lvl, scale * 3 AS scale, g, pos // 3 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h
    FROM tree WHERE size > 1 GROUP BY lvl, scale, g, pos // 3)),
s AS (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS pos FROM tree WHERE size = 1),
top(lvl, scale, pos, h, size) AS (
  SELECT 0, CAST(1 AS BIGINT), pos, h, count(*) OVER () FROM s
  UNION ALL
  SELECT lvl, scale, pos, h, count(*) OVER () FROM (
    SELECT lvl + 1 AS lvl, scale * 3 AS scale, pos // 3 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h
    FROM top WHERE size > 1 GROUP BY lvl, scale, pos // 3)),
low AS ({step.format("rid")} FROM x JOIN tree t ON t.g = x.g AND t.size > 1 AND t.pos // 3 = x.pos // t.scale // 3 GROUP BY x.rid, t.lvl),
up AS ({step.format("g")} FROM s x JOIN top t ON t.size > 1 AND t.pos // 3 = x.pos // t.scale // 3 GROUP BY x.g, t.lvl),
path AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY part, lvl) AS k, coalesce(l, '') AS l, coalesce(r, '') AS r FROM (
  SELECT rid, 0 AS part, lvl, l, r FROM low UNION ALL SELECT rid, 1, lvl, l, r FROM x JOIN up USING (g))),
fold(rid, k, h) AS (
  SELECT rid, CAST(0 AS BIGINT), CASE WHEN picked THEN bare ELSE leaf END FROM x
  UNION ALL
  SELECT fold.rid, path.k, sha256(path.l || fold.h || path.r) FROM fold JOIN path ON path.rid = fold.rid AND path.k = fold.k + 1),
done AS (SELECT rid, arg_max(h, k) AS h FROM fold GROUP BY rid),
proof AS (SELECT rid, sha256(string_agg(l || r, '' ORDER BY k)) AS p FROM path GROUP BY rid)
SELECT x.doc_id, x.leaf, s.h AS subroot, z.h AS root, coalesce(p, sha256('')) AS proof_sha256, done.h AS folded_root, done.h = z.h AS verified
FROM x JOIN s USING (g) JOIN done USING (rid) LEFT JOIN proof USING (rid) JOIN (SELECT h FROM top WHERE size = 1) z ON true
"""


def top_k_sql(every: int = 100, k: int = 10, scale: int = 1024) -> str:
    """Rows of ``topk.nearest_embeddings``: all scores, ranked."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % {every} = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}
"""


def lexical_search_sql(k: int = 20) -> str:
    """Rows of ``lexical.search``: every document that shares a term with an item, scored and ranked."""

    def split(text: str) -> str:
        folded = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"regexp_extract_all({folded}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {split("text")} AS w FROM documents),
h AS (SELECT rid, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
c AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM h),
b AS MATERIALIZED (SELECT row_number() OVER () AS iid, item_id, {split("text")} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT iid, t, count(*) AS times FROM (SELECT iid, unnest(w) AS t FROM b) GROUP BY iid, t),
p AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM h) SEMI JOIN q USING (t) GROUP BY rid, t),
f AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY t, nn),
v AS (SELECT rid, t, f.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))) AS impact FROM p JOIN f USING (t) JOIN h USING (rid), c),
s AS (SELECT iid, rid, CAST(sum(times * impact) AS BIGINT) AS score FROM q JOIN v USING (t) GROUP BY iid, rid HAVING sum(times * impact) > 0),
r AS (SELECT iid, doc_id, score, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN h USING (rid))
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r JOIN b USING (iid) WHERE rank <= {k}
"""


ORACLES: dict[str, str] = {
    "op1_suffix_dedup": suffix_dedup_sql(),
    "op5_secret_scans": secret_scan_sql(),
    "op6_quality_rules": quality.oracle_sql(),
    "op8_jaccard_join": jaccard_join_sql(),
    "op11_merkle_manifest": merkle_manifest_sql(),
    "op12_exact_top_k": top_k_sql(),
    "op13_lexical_search": lexical_search_sql(),
}
