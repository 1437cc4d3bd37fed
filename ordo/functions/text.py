"""Text scalar functions (JVM-side except the optional accent stripper)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# A token is a run of two or more letters, digits or
# underscores (the word-character rule of the reference tokenizer).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


@F.pandas_udf(StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """NFKD-decompose and drop combining marks (Arrow-batched helper)."""
    def one(t):
        if t is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))

    return s.map(one)


def tokens(text: Column, lowercase: bool = True, accents: bool = False, pattern: str = TOKEN_PATTERN) -> Column:
    t = text
    if accents:
        t = strip_accents(t)
    if lowercase:
        t = F.lower(t)
    return F.regexp_extract_all(t, F.lit(pattern), 0)


def _gram_of(toks: Column, n: int):
    # a one-argument lambda: two-argument lambdas mean (element, index) to transform
    return lambda i: F.array_join(F.slice(toks, i, n), " ")


def ngrams(toks: Column, ngram_range: tuple[int, int] = (1, 1)) -> Column:
    """All n-grams for n in the inclusive range, each joined by a space."""
    lo, hi = ngram_range
    parts = []
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(toks)
        else:
            idx = F.sequence(F.lit(1), F.greatest(F.size(toks) - n + 1, F.lit(0)))
            grams = F.transform(idx, _gram_of(toks, n))
            parts.append(F.when(F.size(toks) >= n, grams).otherwise(F.array().cast("array<string>")))
    return parts[0] if len(parts) == 1 else F.concat(*parts)
