"""The queries of this package: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, jaccard, language, mixing, neighbours, packing, pii, quality, repair, substrings, toxicity, urls
from .common import table
from .oracles import SQL  # noqa: F401


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(table(spark, sf_dir, "documents"), weights=[3, 1, 2], share=1.5)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, and one more that says control strings; the digests are read back from the formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    template = chat.Template()

    def digests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        for part in parts:
            out = []
            for conv, formatted, segments in zip(part["conv_id"], part["formatted"], part["segments"]):
                turns = chat.read_back(formatted, template)
                loss = "".join(template.unescaped(formatted[s["start"] : s["end"]]) for s in segments if s["loss"])
                out.append((None if pd.isna(conv) else int(conv), len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted)))
            yield pd.DataFrame({k: pd.Series([o[i] for o in out], dtype=kind) for i, (k, kind) in enumerate([("conv_id", "Int64"), ("n_turns", "int64"), ("turns_sha256", object), ("loss_chars", "int64"), ("loss_sha256", object), ("formatted_chars", "int64")])})

    formatted = chat.format_chat(rows.withColumn("turn", F.col("turn").cast("long")).unionByName(extra), template)
    return formatted.select("conv_id", "formatted", "segments").mapInPandas(digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"))
    model = language.fit(docs.where(~out).select("doc_id", "text", "lang"))
    return language.identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"))
    machine = toxicity.fit(docs.where(~out), table(spark, sf_dir, "labels").where(~out))
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=3, most=200)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.damaged(table(spark, sf_dir, "conversations"))
    found = repair.repair(rows, F.col("times"))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", repair.digest(F.col("repaired")).alias("repaired_sha256"))


#: The listed rules of op13: verdict, host and path.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), rules=URL_RULES).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_mixing, op3_packing, op4_substring_dedup, op5_chat_format, op6_language_id, op7_ngram_jaccard, op8_toxicity, op9_pii, op10_nearest, op11_source_divergence, op12_conversation_repair, op13_url_filters)}
