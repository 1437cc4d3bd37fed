"""Secret scan through a trigram inverted index.

Each rule's regular expression gives a Boolean query over trigrams
(``trigrams.py``).  The index lists, for every trigram that a query names,
the documents that contain it (postings of a document's key, exploded from
the rows and regrouped by Spark).  A query's clause is answered by
intersecting its postings: documents counted once for every trigram of the
clause.  Candidates of any clause are verified with the regular expression;
rules without mandatory trigrams read every document.

The index holds only trigrams that rules name, so it grows with the
documents and not with their length.  The postings are spread by document
key, so neither a frequent trigram nor a large group of equal texts meets in
one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, match_spans, materialize
from .trigrams import trigram_query

BROADCAST_CANDIDATES = 100_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds, in their order.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
#: Kinds that the method adds.
MORE = (
    Rule("private-key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("bearer", r"(?i)bearer\x20+[A-Za-z0-9._~+/-]{20,}"),
    Rule("url-password", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{1,64}@"),
)


def document_key(doc_id: Column, text: Column) -> Column:
    """64-bit key of a row; a clash only adds a candidate, which verification drops."""
    return F.xxhash64(doc_id, text)


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """The inverted index: (trigram, key) for every document that contains a trigram."""
    held = let(F.lower("text"), lambda low: F.filter(F.array(*[F.lit(t) for t in vocabulary]), lambda t: F.contains(low, t)))
    return docs.select("key", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame | None, list[str]]:
    """(key, kinds) of the documents that may match a rule, and the kinds that must read all."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    scan = [kind for kind, q in queries.items() if q is None]
    clauses = [(kind, n, len(c), t) for kind, q in queries.items() if q for n, c in enumerate(sorted(q, key=sorted)) for t in sorted(c)]
    if not clauses:
        return None, scan
    spark = docs.sparkSession
    index = postings(docs, sorted({t for *_, t in clauses}))
    # as large as the rules' queries, whatever the documents
    terms = F.broadcast(spark.createDataFrame(clauses, "kind string, clause int, need int, trigram string"))
    met = index.join(terms, "trigram").groupBy("key", "kind", "clause", "need").agg(F.count_distinct("trigram").alias("n"))
    found = met.filter("n = need").groupBy("key").agg(F.collect_set("kind").alias("kinds"))
    return materialize(found, "secret-candidates"), scan


def verified(text: Column, rule: Rule) -> Column:
    """Spans (a, z, kind order) of a rule's true matches in a text."""
    pattern = F.lit(rule.pattern)
    spans = match_spans(text, pattern)
    if rule.group:
        sized = F.zip_with(
            spans,
            F.regexp_extract_all(text, pattern, F.lit(rule.group)),
            lambda s, g: F.struct(s["a"].alias("a"), s["z"].alias("z"), F.char_length(g).alias("n")),
        )
    else:
        sized = F.transform(spans, lambda s: F.struct(s["a"].alias("a"), s["z"].alias("z"), (s["z"] - s["a"]).cast("int").alias("n")))
    return F.filter(sized, lambda s: s["n"] >= rule.least)


def _ordered(spans: Column, order: int, kind: str) -> Column:
    """Spans that sort by start, then by the kind's place in the rules."""
    return F.transform(
        spans, lambda s: F.struct(s["a"].alias("a"), F.lit(order).alias("o"), s["z"].alias("z"), F.lit(kind).alias("kind"))
    )


def _number(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def find_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` plus ``spans``: array of (a, z, kind) by start, then kind order."""
    keyed = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    keyed = keyed.withColumn("_key", document_key(F.col(id_col), F.col("_text")))
    found, scan = candidates(keyed.select(F.col("_key").alias("key"), F.col("_text").alias("text")), rules)
    if found is None:
        joined = keyed.withColumn("_kinds", F.array().cast("array<string>"))
    else:
        found = found.select(F.col("key").alias("_key"), F.col("kinds").alias("_kinds"))
        few = found.count() <= BROADCAST_CANDIDATES
        joined = keyed.join(F.broadcast(found) if few else found, "_key", "left")
    nothing = F.array().cast("array<struct<a:bigint,z:bigint,n:int>>")
    parts = []
    for order, rule in enumerate(rules):
        hits = verified(F.col("_text"), rule)
        if rule.kind not in scan:
            hits = F.when(F.array_contains("_kinds", rule.kind), hits).otherwise(nothing)
        parts.append(_ordered(hits, order, rule.kind))
    spans = F.transform(
        F.array_sort(F.flatten(F.array(*parts))), lambda s: F.struct(s["a"].alias("a"), s["z"].alias("z"), s["kind"].alias("kind"))
    )
    return joined.withColumn("spans", spans).drop("_text", "_key", "_kinds")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``; overlapping spans become one.

    Texts without secrets (null ones too) stay as they are.
    """

    def merged(spans: Column) -> Column:
        nothing = F.array().cast("array<struct<a:bigint,z:bigint>>")

        def step(acc: Column, s: Column) -> Column:
            last = F.element_at(acc, -1)
            plain = F.struct(s["a"].alias("a"), s["z"].alias("z"))
            joint = F.struct(last["a"].alias("a"), F.greatest(last["z"], s["z"]).alias("z"))
            return (
                F.when(F.size(acc) == 0, F.array(plain))
                .when(s["a"] < last["z"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joint)))
                .otherwise(F.concat(acc, F.array(plain)))
            )

        return F.aggregate(spans, nothing, step)

    def rebuilt(spans: Column, text: Column) -> Column:
        def gap(s: Column, i: Column) -> Column:
            start = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["z"])
            return F.substring(text, (start + 1).cast("int"), (s["a"] - start).cast("int"))

        tail = F.substring(text, (F.element_at(spans, -1)["z"] + 1).cast("int"), F.char_length(text))
        return F.array_join(F.concat(F.transform(spans, gap), F.array(tail)), mark)

    found = find_spans(docs.withColumnRenamed("spans", "__spans"), BASE + MORE, id_col, text_col)
    text = F.col(text_col)
    clean = F.when(F.size("spans") > 0, let(merged(F.col("spans")), lambda m: rebuilt(m, text))).otherwise(text)
    return found.withColumn(text_col, clean).drop("spans").withColumnRenamed("__spans", "spans").select(*docs.columns)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans read ``kind:start:end`` (code points, end exclusive), by start, then
    kind in the rules' order, joined by commas; ``base_sha256`` is the digest
    of the base kinds' spans.  Null or empty text: no spans.  Repeated rows
    and null ids stay; other columns are ignored; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = find_spans(source, rules, "doc_id", "text")
    base = F.array(*[F.lit(r.kind) for r in BASE])

    def said(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["z"].cast("string"))), ",")

    of_base = F.filter("spans", lambda s: F.array_contains(base, s["kind"]))
    return found.select(
        "doc_id",
        *[_number(r.kind) for r in BASE],
        F.sha2(said(of_base), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )
