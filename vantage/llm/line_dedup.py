"""Drop lines that many documents share, through sharded minimal perfect hash arrays.

1. Each document's distinct line keys are hashed to 128 bits and counted: per batch in the task, then by a groupBy.
2. Keys found in at least min_docs documents are dealt to shards by hash; each shard becomes a minimal perfect hash with
   a fingerprint and a count for each key. Rarer keys can't lose lines, so they take no slots; fingerprints turn them away.
3. Documents probe the arrays where they are; no text moves and no line is joined. The arrays go out in waves of at most
   wave_bytes. A wave marks lines in a column, so more waves only mean more passes, never a lost key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.llm.arrays import U64, list_parts, slices, starts, texts
from vantage.llm.mph import Index, build
from vantage.runtime import discard, settle, unused

SPACE = " \t\n\x0b\x0c\r"
SHARD_KEYS = 100_000


def line_keys(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the lines into distinct keys, and the hash of each key as 2 numbers; code -1: the key is empty."""
    coded = pc.ascii_lower(pc.ascii_trim(lines, characters=SPACE)).dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, names)), "<u8").reshape(-1, 2)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = np.array([not x for x in names], bool)
    return np.where(empty[codes], -1, codes) if len(codes) else codes, hashes


def line_counts(docs: DataFrame) -> DataFrame:
    """(h1, h2, n): in how many documents each line key occurs."""

    def count(batches):
        for batch in slices(batches, "text"):
            per_doc, lines = list_parts(pc.split_pattern(texts(batch), "\n"))
            codes, hashes = line_keys(lines)
            doc = np.repeat(np.arange(len(per_doc)), per_doc)
            keep = codes >= 0
            if not keep.any():
                continue
            pair = np.unique(doc[keep] * len(hashes) + codes[keep])
            n = np.bincount(pair % len(hashes), minlength=len(hashes))
            on = n > 0
            yield pa.record_batch({"h1": pa.array(hashes[on, 0].view(np.int64)), "h2": pa.array(hashes[on, 1].view(np.int64)), "n": pa.array(n[on], pa.int64())})

    return docs.select("text").mapInArrow(count, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def shard_arrays(counts: DataFrame, min_docs: int) -> DataFrame:
    """(shard, bytes, payload): a minimal perfect hash with fingerprints and counts for each shard of frequent keys."""
    frequent = settle(counts.filter(F.col("n") >= min_docs), "line_counts")
    shards = max(1, -(-frequent.count() // SHARD_KEYS))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = build(pdf[["h1", "h2"]].to_numpy(np.int64).view(U64), pdf["n"].to_numpy())
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "bytes": [len(raw)], "payload": [raw]})

    dealt = frequent.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int"))
    packed = dealt.groupBy("shard").applyInPandas(pack, "shard int, bytes long, payload binary")
    arrays = settle(packed.withColumn("shards", F.lit(shards)), "line_arrays")
    discard(frequent)
    return arrays


def mark_lines(docs: DataFrame, arrays: DataFrame, min_docs: int, wave_bytes: int, finish: Callable, schema: T.StructType | str) -> DataFrame:
    """Mark each line, a byte a line: 1 where the line's key occurs in at least min_docs documents.

    finish: from a batch and its marks, one bytes object a row, to a batch of `schema`; it runs with the last wave.
    """
    sizes = sorted((r.shard, r.bytes, r.shards) for r in arrays.select("shard", "bytes", "shards").collect())
    waves, held = [[]], 0
    for shard, size, _ in sizes:
        if waves[-1] and held + size > wave_bytes:
            waves.append([])
            held = 0
        waves[-1].append(shard)
        held += size
    total = sizes[0][2] if sizes else 1
    spark = docs.sparkSession
    marked = unused(docs, "marked")
    docs = docs.withColumn(marked, F.lit(None).cast("binary"))
    between = docs.schema
    held_table = None  # the last wave's table, which the next wave reads
    for k, wave in enumerate(waves):
        given = spark.sparkContext.broadcast([(r.shard, bytes(r.payload)) for r in arrays.filter(F.col("shard").isin(wave)).select("shard", "payload").collect()] if wave else [])

        def probe(batches, given=given, last=k + 1 == len(waves)):
            held = {shard: Index(raw) for shard, raw in given.value}
            for batch in slices(batches, "text"):
                per_doc, lines = list_parts(pc.split_pattern(texts(batch), "\n"))
                codes, hashes = line_keys(lines)
                of = np.mod(hashes[:, 0].view(np.int64), total)
                common = np.zeros(len(hashes) + 1, bool)
                for shard, index in held.items():
                    at = np.flatnonzero(of == shard)
                    common[at] = index.count(hashes[at]) >= min_docs
                mark = common[codes].astype(np.uint8)  # code -1 reads the last entry, which stays false
                before = batch.column(marked)
                if before.null_count < len(before):
                    mark |= np.frombuffer(b"".join(before.to_pylist()), np.uint8)
                raw, at = mark.tobytes(), starts(per_doc).tolist()
                marks = [raw[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]
                names = [x for x in batch.schema.names if x != marked]
                plain = batch.select(names)
                yield finish(plain, marks) if last else pa.record_batch([*plain.columns, pa.array(marks, pa.binary())], names=[*names, marked])

        if k:
            before, held_table = held_table, settle(docs, "line_marks")
            docs = held_table
            if before is not None:
                discard(before)
        docs = docs.mapInArrow(probe, schema if k + 1 == len(waves) else between)
    return docs


def find_lines(docs: DataFrame, min_docs: int, wave_bytes: int, finish: Callable, schema: T.StructType | str) -> DataFrame:
    """All three steps; finish and schema as in mark_lines()."""
    arrays = shard_arrays(line_counts(docs), min_docs)
    out = mark_lines(docs, arrays, min_docs, wave_bytes, finish, schema)
    discard(arrays)  # the tasks hold what they need of them
    return out


def _kept(batch: pa.RecordBatch, marks: list[bytes]) -> tuple[list[str], list[int], list[int]]:
    out, total, dropped = [], [], []
    for text, mark in zip(texts(batch).to_pylist(), marks, strict=True):
        total.append(len(mark))
        gone = mark.count(1)
        dropped.append(gone)
        out.append("\n".join([x for x, m in zip(text.split("\n"), mark, strict=True) if not m]) if gone else text)
    return out, total, dropped


def drop_lines(docs: DataFrame, min_docs: int = 10, wave_bytes: int = 64 << 20) -> DataFrame:
    """docs without the lines whose key occurs in at least min_docs documents; the other columns stay.

    A key is the line without ASCII white space at both ends, A-Z lower-cased; empty keys always stay. A null text counts
    as one empty line and becomes an empty text. All lines of a key go, in every document, repeats included; the rest is
    joined by line feeds, so a document may become empty. A text or line of any length counts whole; repeated rows are
    documents of their own; keys that tie in their counts have the same fate. An empty table gives no rows. Other columns,
    doc_id too, may be null and are kept as they are.
    """
    schema = docs.schema

    def rebuild(batch, marks):
        kept = pa.array(_kept(batch, marks)[0], pa.string())
        return pa.record_batch([kept if x == "text" else batch.column(x) for x in schema.names], names=schema.names)

    return find_lines(docs, min_docs, wave_bytes, rebuild, schema)


def line_digest(docs: DataFrame, min_docs: int = 10, wave_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of drop_lines(), the same cases holding."""

    def digest(batch, marks):
        kept, total, dropped = _kept(batch, marks)
        return pa.record_batch({"doc_id": batch.column("doc_id"), "n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in kept])})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return find_lines(own, min_docs, wave_bytes, digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
