"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, with
n_chars following the text.

Cases that hold for every stage: columns may be null, and other columns, whatever their names, go through unchanged; an
empty table gives no rows; texts of any length are read whole; repeated rows are documents of their own until ngram_join
keeps one of them; n_chars is only worked out anew where a stage changes texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.decontamination import drop_leaked
from vantage.llm.line_dedup import drop_lines
from vantage.llm.ngram_join import keep_one
from vantage.llm.packing import pack
from vantage.llm.toxicity import drop_toxic
from vantage.runtime import discard, settle, small_batches


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose score is 0.5 or more. Null and empty texts, and all texts where there are no labels, stay."""
    small_batches(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines found in at least 10 documents. A document that only held such lines stays, with an empty text.

    A null text becomes an empty one, with n_chars 0; empty lines stay.
    """
    small_batches(spark)
    return drop_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of texts with similarity 0.8 or more: that of the least doc_id, once.

    Texts without words, null and empty ones included, are one class; documents without a doc_id stay.
    """
    small_batches(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item. Null and empty texts hold none; documents without a doc_id stay."""
    small_batches(spark)
    return drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens. A null or empty text is one piece that holds the end id."""
    small_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each stage's result is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settle(stage(spark, docs, sf_dir), f"stage_{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
