"""From documents to batches: language ID, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again for the next; all but the
last return the columns of documents. Null or empty texts go in the first stage (they have no language); later stages
define results for them all the same, in their operators' docstrings. Repeated rows count as copies and become one in the
second stage; ties go to the smaller doc_id; an empty table passes all stages empty; further columns, whatever their
names, are carried along; very long texts are read whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineupforge.llm import jaccard, language, mixing, packing, pii
from lineupforge.llm.common import cut, table

#: SQL can't express the language models, the near-duplicate components or the draws.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told and not rejected; a null lang is filled in."""
    return language.accepted(docs, language.fit(docs.where(~language.held_out(F.col("doc_id"))).select("doc_id", "text", "lang")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each component of the n-gram Jaccard join."""
    return jaccard.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes words of each source near its target weight, repeats included."""
    return mixing.mixed_documents(docs, weights=[3, 1, 2], share=1.5)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches within length buckets."""
    return packing.pack(docs)


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("mixing", mix_sources), ("packing", pack_batches)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
