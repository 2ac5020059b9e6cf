"""The queries of this package: each applies one operator, with its production parameters, to the whole of its table."""

from __future__ import annotations

from . import bpe, decontaminate, exact_dedup, html_text, line_dedup, simhash_dedup, substring_dedup, suffix_dedup, toxicity, warc
from .common import table

QUERIES = {
    "op1_warc_packages": lambda spark, d: warc.read_back(table(spark, d, "pages")),
    "op2_html_text": lambda spark, d: html_text.extracted(table(spark, d, "pages")),
    "op3_suffix_dedup": lambda spark, d: suffix_dedup.suffix_dedup(table(spark, d, "documents")),
    "op4_toxicity": lambda spark, d: toxicity.toxic_documents(table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_substring_dedup": lambda spark, d: substring_dedup.substring_dedup(table(spark, d, "documents")),
    "op6_exact_dedup": lambda spark, d: exact_dedup.exact_duplicates(table(spark, d, "documents")),
    "op7_bpe": lambda spark, d: bpe.encoded(table(spark, d, "documents")),
    "op8_decontamination": lambda spark, d: decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op9_near_dedup": lambda spark, d: simhash_dedup.near_duplicates(table(spark, d, "documents")),
    "op10_line_dedup": lambda spark, d: line_dedup.line_dedup(table(spark, d, "documents"), count="removed_lines").select("doc_id", "text", "removed_lines"),
}

ORACLES = {
    "op1_warc_packages": warc.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
}
