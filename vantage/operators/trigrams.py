"""A trigram index over blocks of documents, for searches of any substring."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.runtime import shared_dir, small_batches

SHELVES = 256  # most folders, about


@dataclass
class TrigramIndex:
    """texts: (key, text, block, shelf), a folder for each shelf of `per` consecutive blocks; postings: (gram, block), each once."""

    texts: DataFrame
    postings: DataFrame
    key: str
    per: int


def build(docs: DataFrame, key: str = "doc_id", size: int = 64, text: str = "text") -> TrigramIndex:
    """Lay lower-cased texts out in blocks of `size` consecutive keys, on at most SHELVES folders or one more, and list each block's trigrams.

    A block's trigrams are collected in the tasks that read it, so what is shuffled is distinct ones a task. Null texts and keys are left out.
    """
    spark = docs.sparkSession
    base = f"{shared_dir(spark)}/vantage/trigrams-{uuid.uuid4().hex}"
    known = docs.filter(F.col(text).isNotNull() & F.col(key).isNotNull())
    ends = known.agg(F.min(key), F.max(key)).first()
    per = 1 if ends[0] is None else max(1, -(-(ends[1] // size - ends[0] // size + 1) // SHELVES))
    small_batches(spark)
    rows = known.select(F.col(key).cast("long").alias(key), F.lower(text).alias("text"), F.floor(F.col(key) / size).cast("long").alias("block"))
    shelved = rows.withColumn("shelf", F.floor(F.col("block") / per).cast("long"))
    shelved.repartition("shelf").sortWithinPartitions("shelf", "block").write.partitionBy("shelf").parquet(f"{base}/texts")

    def grams(batches):
        for batch in batches:
            held: dict[int, set[str]] = {}
            for block, t in zip(batch.column("block").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(block, set()).update(t[k : k + 3] for k in range(len(t) - 2))
            for block, found in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string()), pa.array([block] * len(found), pa.int64())], ["gram", "block"])

    rows.select("block", "text").mapInArrow(grams, "gram string, block long").distinct().repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{base}/postings")
    texts = spark.read.schema(f"{key} long, text string, block long, shelf long").parquet(f"{base}/texts")
    return TrigramIndex(texts, spark.read.schema("gram string, block long").parquet(f"{base}/postings"), key, per)


def candidates(index: TrigramIndex, word: str) -> DataFrame | None:
    """The blocks that hold all trigrams of a word; None where it has none, so that every block has to be read."""
    word = word.lower()
    need = sorted({word[k : k + 3] for k in range(len(word) - 2)})
    if not need:
        return None
    return index.postings.filter(F.col("gram").isin(need)).groupBy("block").count().filter(F.col("count") == len(need)).select("block")


def search(index: TrigramIndex, word: str) -> DataFrame:
    """(key) of the texts that hold the word in any case. Only folders with candidate blocks are read, and each text of such a block is verified."""
    found = candidates(index, word)
    if found is None:
        texts = index.texts
    else:
        found = found.withColumn("shelf", F.floor(F.col("block") / index.per).cast("long"))
        texts = index.texts.join(F.broadcast(found), ["shelf", "block"], "left_semi")
    return texts.filter(F.contains("text", F.lit(word.lower()))).select(index.key)
