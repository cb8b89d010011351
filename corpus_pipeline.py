"""The corpus pipeline: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlens.llm import decontaminate, packing, pii, quality, simhash
from gridlens.llm.common import drop_staged, stage_table, staged, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go. Null texts, languages, sources and lengths are judged like others."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least id; of repeated rows the first."""
    return simhash.drop_near_duplicates(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go. Null and empty texts overlap nothing."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in its text gives way to the name of its kind. A null text stays null."""
    return pii.redact(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces lie in the training sequences. A null or empty text is one piece, its end token."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality_classifier", good_documents),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_leaks),
    ("personal_data", personal_data),
    ("best_fit_packing", packed_sequences),
]

#: SQL can't express tokenizers, fitted classifiers or fingerprint components; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents: the pieces of every document that stays, and their places in sequences.

    Each stage's result is written and read back, and then what the stages before have staged is deleted. Nulls, empty texts and
    repeated rows are treated as each stage says; extra columns pass through to the last stage. An empty table gives no pieces.
    """
    docs, mark = table(spark, sf_dir, "documents"), staged()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage_table(docs, name)
            drop_staged(spark, since=mark, but_last=1)
    return docs
