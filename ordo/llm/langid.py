"""Language identification with language-bitmask n-gram filters.

Each language has a Bloom filter of its usual character n-grams.  The filters
are stored bit-sliced: slot ``j`` of one table holds a bitmask whose bit ``l``
is slot ``j`` of the filter of language ``l``, so one look-up per hash (and an
AND over the hashes) returns all languages that contain an n-gram.  A text's
hits are summed per language (popcounts of the masks), corrected for each
filter's false positives, and the largest corrected count decides.

Training counts n-grams on a bounded sample of labelled documents
(``sample_docs`` per language, chosen by a hash of the id); n-grams above a
relative frequency go into the filters, so at most ``1 / min_share`` per
language and length reach the driver.  Prediction covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTHS = (3, 4)
SPAN = 1 << 19  # characters handled at once; longer texts are cut with overlap
_LETTERS: list[np.ndarray] = []


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves remainder 2 by 4 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads n-gram codes over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_codes(text: str) -> tuple[np.ndarray, ...]:
    """Hashes of the n-grams of a text, one array per length.

    Letters are lower-cased; every run of other characters counts as one
    space, also before and after the text.
    """
    code = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(letters()[code], code, np.uint32(32))
    code = code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])].astype(np.uint64)
    out, h = [], code
    for n in range(2, max(LENGTHS) + 1):
        h = h[:-1] * np.uint64(0x110001) + code[n - 1 :] if len(h) > 1 else h[:0]
        if n in LENGTHS:
            out.append(mix(h + np.uint64(n)))
    return tuple(out)


def slots_of(grams: np.ndarray, slots: int, n_hashes: int) -> Iterator[np.ndarray]:
    """The filter slots of each n-gram, one array per hash; ``slots`` is a power of two."""
    step = (grams >> np.uint64(32)) | np.uint64(1)
    for k in range(n_hashes):
        yield ((grams + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64)


def slices(text: str) -> Iterator[str]:
    step = SPAN - max(LENGTHS) + 1
    for lo in range(0, max(1, len(text) - max(LENGTHS) + 1), step):
        yield text[lo : lo + SPAN]


@dataclass
class LanguageFilters:
    """The bit-sliced filters: ``table[j, w]`` is word ``w`` of slot ``j``'s language mask."""

    languages: list[str]
    table: np.ndarray
    n_hashes: int

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """Bitmask of all languages that contain each n-gram."""
        out = None
        for at in slots_of(grams, len(self.table), self.n_hashes):
            out = self.table[at] if out is None else out & self.table[at]
        return out

    def false_rates(self) -> np.ndarray:
        fill = [((self.table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.languages))]
        return np.array(fill) ** self.n_hashes

    def hits(self, text: str) -> tuple[int, np.ndarray]:
        """Number of n-grams and, per language, of those in its filter."""
        n, found = 0, np.zeros(len(self.languages))
        for part in slices(text):
            for grams in gram_codes(part):
                masks = self.masks(grams)
                n += len(grams)
                for i in range(len(self.languages)):
                    found[i] += int(((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).sum())
        return n, found

    def decide(self, text: str | None, rates: np.ndarray) -> tuple[str, float]:
        """Language and score; ``und`` with score 0 without a letter or a model."""
        if not text or not self.languages or not any(c.isalpha() for c in text):
            return "und", 0.0
        n, found = self.hits(text)
        if n == 0:
            return self.languages[0], 0.0
        true = np.clip((found - n * rates) / np.maximum(1 - rates, 1e-9), 0, n)
        best = int(np.argmax(true))
        return self.languages[best], float(true[best] / n)


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = 4_000,
    min_share: float = 2e-5,
    slots: int = 1 << 20,
    n_hashes: int = 3,
) -> LanguageFilters:
    """Fit the filters on labelled documents that are not held out.

    About ``sample_docs`` documents per language are read (all, if there are
    fewer); rows without text or language are passed over.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    rows = rows.filter(F.col("t").isNotNull() & F.col("l").isNotNull() & F.col("i").isNotNull() & ~held_out(F.col("i")))
    sizes = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageFilters([], np.zeros((1, 1), np.uint64), n_hashes)
    draw = F.pmod(F.xxhash64(F.col("i"), F.lit("sample")), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for l in languages for x in (l, min(1_000_000, sample_docs * 1_000_000 // sizes[l] + 1))])
    sample = rows.filter(draw < share[F.col("l")]).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in slices(text):
                    for n, grams in zip(LENGTHS, gram_codes(part), strict=True):
                        values, times = np.unique(grams, return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(values), pa.string()), pa.array(np.full(len(values), n, np.int32)), pa.array(values.view(np.int64)), pa.array(times.astype(np.int64))],
                            names=["l", "n", "g", "c"],
                        )

    counts = sample.mapInArrow(count, "l string, n int, g long, c long").groupBy("l", "n", "g").agg(F.sum("c").alias("c"))
    wholes = counts.groupBy("l", "n").agg(F.sum("c").alias("all"))
    # one row per language and length: a bounded table
    usual = counts.join(F.broadcast(wholes), ["l", "n"]).filter(F.col("c") >= F.col("all") * F.lit(min_share)).select("l", "g")
    table = np.zeros((slots, -(-len(languages) // 64)), np.uint64)
    found = usual.toPandas()
    for lang, part in found.groupby("l"):
        bit = languages.index(lang)
        grams = part["g"].to_numpy(np.int64).view(np.uint64)
        for at in slots_of(grams, slots, n_hashes):
            table[at, bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
    return LanguageFilters(languages, table, n_hashes)


def identify(docs: DataFrame, model: LanguageFilters, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred`` and ``score`` (0 to 1).

    ``und`` if the text is null or has no letter; ties go to the language that
    sorts first.  Every row stays, repeated ones too.
    """
    names = docs.columns
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model, model.false_rates()))
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    taken = [StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
    schema = StructType([*taken, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, rates = shared.value
        for batch in batches:
            said = [filters.decide(v.as_py(), rates) for v in batch.column(at)]
            extra = [pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=schema.names)

    out = docs.toDF(*[f.name for f in taken]).mapInArrow(run, schema)
    return out.toDF(*names, *("lang_pred", "score"))


def identify_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **parameters) -> DataFrame:
    """Train on the rows that are not held out, predict every row.

    Returns doc_id, held_out, lang_pred and score.  Null ids count as not held
    out and train nothing; null or letterless texts are ``und`` with score 0;
    without any labelled row every text is ``und``.  Empty table: no rows.
    """
    model = train(docs, id_col, text_col, lang_col, **parameters)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return identify(source, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
