"""A corpus pipeline of five of the operators: toxic documents go, repeated line chunks go, one document of
each group of near copies stays, benchmark passages go, and what is left is tokenized.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as
Parquet and read again. All but the last return the columns of `documents`.

Edge cases: rows with a null text or doc_id stay through all stages, null texts get null tokens; empty texts are one group of near copies, of which one
stays; of rows that repeat doc_id and text one stays, several texts of one doc_id are documents of their own; a document may end empty, and stays; very long
texts are worked off whole; an empty table gives no rows; n_chars is kept true."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, decontaminate, line_dedup, simhash_dedup, toxicity
from quarry.llm.common import saved, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: A trained classifier, SimHash and a tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name}")
    return docs
