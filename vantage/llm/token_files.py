"""Token-id files: documents in id order, cut into shards that a Re-Pair grammar compresses."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm import grammar
from vantage.llm.arrays import slices, starts, texts
from vantage.llm.tokens import tokenizer
from vantage.runtime import settle

FILES = "part int, shard int, part_start long, n_docs long, n_tokens long, payload binary"
ROWS = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"


def token_ids(docs: DataFrame, file: str, cuts: Broadcast) -> DataFrame:
    """(part, doc_id, ids): the ids of each text as little-endian numbers of 16 bits where the vocabulary allows, else 32.

    part: how many of the cuts are below doc_id; 0 for a null one. The rows of a doc_id that is several cuts are dealt by
    hash to the parts on both sides of these.
    """

    def encode(batches):
        coder = tokenizer(file)
        kind = id_type(coder.library.get_vocab_size())
        for batch in slices(batches, "text"):
            counts, ids = coder.encode(texts(batch))
            at = starts(counts * np.dtype(kind).itemsize)
            raw = pa.py_buffer(ids.astype(kind).tobytes())
            column = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at.tobytes()), raw])
            doc_id = batch.column("doc_id")
            names = doc_id.fill_null(np.iinfo(np.int64).min).to_numpy()
            low, high = (np.searchsorted(cuts.value, names, side=side) for side in ("left", "right"))
            part = np.where(doc_id.is_null(), 0, low)
            for k in np.flatnonzero((high - low > 1) & doc_id.is_valid().to_numpy(zero_copy_only=False)).tolist():
                part[k] = low[k] + xxhash.xxh3_64_intdigest(column[k].as_buffer()) % int(high[k] - low[k] + 1)
            yield pa.record_batch({"part": pa.array(part, pa.int32()), "doc_id": doc_id, "ids": column.cast(pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "part int, doc_id long, ids binary")


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 0xFFFF else "<u4"


def write_files(docs: DataFrame, file: str, end_id: int = 2, shard_tokens: int = 1_000_000) -> DataFrame:
    """Write the token files of docs and return them as a table of shards, in the order (part, shard).

    Parts are ranges of doc_id with about equal numbers of documents, cut at quantiles of that column; a part's task
    gathers at most about shard_tokens ids before it writes a shard. Rows that share a doc_id follow each other in any
    order. A null doc_id comes first. The shards lie in the shared folder as Parquet rows, so Spark's writers commit
    them and any reader finds them.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [k / parts for k in range(1, parts)], F.lit(10_000)) if parts > 1 else F.lit(None)).first()[0]
    cuts = np.array(cuts or [], np.int64)
    kind = id_type(tokenizer(file).library.get_vocab_size())

    def shards(batches):
        at_part, ids, names, counts, held, total, number = None, [], [], [], 0, 0, 0

        def flush():
            nonlocal ids, names, counts, held, total, number
            raw = grammar.write(names, np.concatenate(ids), np.array(counts, np.int64), end_id)
            out = pa.record_batch({"part": pa.array([at_part], pa.int32()), "shard": pa.array([number], pa.int32()), "part_start": pa.array([total], pa.int64()), "n_docs": pa.array([len(names)], pa.int64()), "n_tokens": pa.array([held], pa.int64()), "payload": pa.array([raw], pa.binary())})
            ids, names, counts, total, number, held = [], [], [], total + held, number + 1, 0
            return out

        for batch in batches:
            for part, doc_id, raw in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if held and (part != at_part or held >= shard_tokens):
                    yield flush()
                if part != at_part:
                    at_part, total, number = part, 0, 0
                x = np.frombuffer(raw.as_buffer(), kind)
                ids.append(x)
                ids.append(np.array([end_id], kind))
                names.append(doc_id)
                counts.append(len(x) + 1)
                held += len(x) + 1
        if held:
            yield flush()

    dealt = token_ids(docs, file, spark.sparkContext.broadcast(cuts))
    ordered = dealt.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    return settle(ordered.mapInArrow(shards, FILES), "token_files")


def read_files(files: DataFrame) -> DataFrame:
    """Decode token files: one row per document with its place among all ids, its number of ids and their crc32."""
    spark = files.sparkSession
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # a row a part
    base, at = [], 0
    for r in sorted(sums):
        base.append((r.part, at))
        at += r.n
    bases = spark.createDataFrame(base or [(0, 0)], "part int, base long")

    def decode(batches):
        for batch in batches:
            for part, part_start, raw in zip(batch.column("part").to_pylist(), batch.column("part_start").to_pylist(), batch.column("payload"), strict=True):
                shard = grammar.Shard(raw.as_buffer())
                ids, n = shard.documents()
                at = starts(n)
                view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.record_batch(
                    {
                        "part": pa.array(np.full(len(n), part), pa.int32()),
                        "doc_id": pa.array(shard.doc_ids, pa.int64(), mask=shard.null),
                        "start": pa.array(at[:-1] + part_start, pa.int64()),
                        "n_tokens": pa.array(n, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    rows = files.select("part", "part_start", "payload").mapInArrow(decode, ROWS)
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, file: str, end_id: int = 2, shard_tokens: int = 1_000_000) -> DataFrame:
    """Write docs as token files and read them back.

    Cases: a null or empty text holds the end id alone; repeated rows follow each other, and the rows of one doc_id may lie in several parts; a null doc_id comes first and
    stays null; rows that tie in doc_id stand in the order of their ids within a part; a text of any length lies whole in one part; an empty table gives no rows; columns other than doc_id and text are ignored.
    """
    return read_files(write_files(docs, file, end_id, shard_tokens))
