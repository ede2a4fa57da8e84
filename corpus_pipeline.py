"""From raw documents to a training mix: the stages, and a run over all of them.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of ``documents``; the last one adds what the mix takes of each.
Null texts count as empty.  Rows that repeat are told apart by doc_id and text,
those without a doc_id are no copies of others; an empty table stays empty, and
further columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import cut, table
from millrace.llm.decontaminate import clean_documents
from millrace.llm.line_crf import keep_good
from millrace.llm.mixing import mixed_documents
from millrace.llm.near_copies import keep_least
from millrace.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier accepts; it learns from ``labels``."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, a similarity of 0.8 or more."""
    return keep_least(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with ``benchmark``."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with ``mix_taken`` (words) and ``mix_slices`` (which words, for which shard)."""
    return mixed_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("mixing", mixing),
]

# A trained classifier and XXH64 have no SQL: stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder before the next one starts."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
