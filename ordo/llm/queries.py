"""Registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import bpe, decontaminate, html_text, jaccard, langid, lexical, licenses, merkle, oracles, quality, secrets, sharding, suffixes, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": lambda spark, d: suffixes.remove_repeats(table(spark, d, "documents")),
    "op2_decontamination": lambda spark, d: decontaminate.leaked_documents(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op3_html_extraction": lambda spark, d: html_text.extract_pages(table(spark, d, "pages")),
    "op4_sharding": lambda spark, d: sharding.shard_documents(table(spark, d, "documents")),
    "op5_secret_scans": lambda spark, d: secrets.scan_documents(table(spark, d, "documents")),
    "op6_quality_rules": lambda spark, d: quality.judge_documents(table(spark, d, "documents")),
    "op7_license_scans": lambda spark, d: licenses.scan_documents(table(spark, d, "documents")),
    "op8_jaccard_join": lambda spark, d: jaccard.jaccard_components(table(spark, d, "documents")),
    "op9_bpe": lambda spark, d: bpe.bpe_encode(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json")),
    "op10_language_id": lambda spark, d: langid.identify_documents(table(spark, d, "documents")),
    "op11_merkle_manifest": lambda spark, d: merkle.manifest_documents(table(spark, d, "documents")),
    "op12_exact_top_k": lambda spark, d: topk.nearest_embeddings(table(spark, d, "embeddings")),
    "op13_lexical_search": lambda spark, d: lexical.search(table(spark, d, "documents"), table(spark, d, "benchmark")),
}

ORACLES: dict[str, str] = dict(oracles.ORACLES)
