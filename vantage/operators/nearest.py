"""Nearest vectors by cosine: exactly, and by an index of locality-sensitive hashes with 8-bit codes.

Queries meet vectors in blocks of bounded size, and each block keeps its best only, so no row is made for a pair and a
bucket of any size is spread over tasks. A block's scores are one matrix product.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VECTORS, QUERIES = 4096, 1024  # most rows of a block, about
SCORED = "query_id long, vec_id long, score double"


def unit(column: pd.Series | list) -> np.ndarray:
    """Rows of length one; a vector of zeros stays."""
    x = np.asarray([np.asarray(v, np.float64) for v in column])
    n = np.sqrt((x * x).sum(1, keepdims=True)) if len(x) else np.ones((0, 1))
    return x / np.where(n == 0, 1.0, n)


def row_best(q_ids: np.ndarray, v_ids: np.ndarray, scores: np.ndarray, top: int) -> pd.DataFrame:
    """The `top` best of each row of scores, rounded to 6 places; ties go to the lesser id."""
    order = np.argsort(v_ids, kind="stable")
    scores, v_ids = np.round(scores[:, order], 6), v_ids[order]
    best = np.argsort(-scores, axis=1, kind="stable")[:, :top]
    rows = np.repeat(np.arange(len(q_ids)), best.shape[1])
    return pd.DataFrame({"query_id": q_ids[rows], "vec_id": v_ids[best.ravel()], "score": scores[rows, best.ravel()]})


def ranked(scored: DataFrame, top: int) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("long")
    return scored.withColumn("rank", at).filter(F.col("rank") <= top)


def _dealt(df: DataFrame, key: str, blocks: int, name: str) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))


def _spread(df: DataFrame, blocks: int, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def meet(queries: DataFrame, vectors: DataFrame, score: Callable, schema: str, most: tuple[int, int] | None = None) -> DataFrame:
    """What score(queries, vectors) makes of every block of queries with every block of vectors; `most` rows of each, about."""
    queries_most, vectors_most = most or (QUERIES, VECTORS)
    q_blocks, v_blocks = max(1, -(-queries.count() // queries_most)), max(1, -(-vectors.count() // vectors_most))
    q = _spread(_dealt(queries, "query_id", q_blocks, "q_block"), v_blocks, "v_block")
    v = _spread(_dealt(vectors, "vec_id", v_blocks, "v_block"), q_blocks, "q_block")
    names = StructType.fromDDL(schema).names

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return score(a, b) if len(a) and len(b) else pd.DataFrame({name: [] for name in names})

    return q.groupBy("q_block", "v_block").cogroup(v.groupBy("q_block", "v_block")).applyInPandas(run, schema)


def _known(df: DataFrame, key: str, *others: str) -> DataFrame:
    return df.filter("embedding IS NOT NULL").select(key, "embedding", *others)


def exact(queries: DataFrame, vectors: DataFrame, top: int = 20, least: float = 0.0) -> DataFrame:
    """(query_id, vec_id, score, rank): the `top` vectors (vec_id, embedding) nearest each query (query_id, embedding) with scores above `least`.

    A null vector is no candidate and no query; a vector of zeros has the score 0. Ties go to the lesser vec_id.
    """

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return row_best(a["query_id"].to_numpy(), b["vec_id"].to_numpy(), unit(a["embedding"]) @ unit(b["embedding"]).T, top)

    scored = meet(_known(queries, "query_id"), _known(vectors, "vec_id"), score, SCORED)
    return ranked(scored.filter(F.col("score") > least), top)


def all_scores(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, vec_id, score): the score of every query with every vector, a row a pair. A vector of zeros has the score 0, a null one a null."""

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = np.round(unit(a["embedding"]) @ unit(b["embedding"]).T, 6)
        return pd.DataFrame({"query_id": np.repeat(a["query_id"].to_numpy(), len(b)), "vec_id": np.tile(b["vec_id"].to_numpy(), len(a)), "score": found.ravel()})

    null = lambda df: df.filter("embedding IS NULL")
    ids = lambda q, v: q.select("query_id").crossJoin(v.select("vec_id")).withColumn("score", F.lit(None).cast("double"))
    known = meet(_known(queries, "query_id"), _known(vectors, "vec_id"), score, SCORED, (QUERIES // 4, VECTORS // 4))  # all pairs of a block are rows
    return known.unionByName(ids(queries, null(vectors))).unionByName(ids(null(queries), vectors.filter("embedding IS NOT NULL")))


def within(queries: DataFrame, vectors: DataFrame, group: str, least: float, top: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the `top` other vectors of the query's group, a number, with scores of at least `least`. Ties go to the lesser vec_id."""

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = unit(a["embedding"]) @ unit(b["embedding"]).T
        other = (a["query_id"].to_numpy()[:, None] != b["vec_id"].to_numpy()) & (a[group].to_numpy()[:, None] == b[group].to_numpy())
        best = row_best(a["query_id"].to_numpy(), b["vec_id"].to_numpy(), np.where(other, found, -2.0), top)
        return best[best["score"] >= max(least, -1.5)]

    known = lambda df, key: _known(df, key, group).filter(F.col(group).isNotNull())
    return ranked(meet(known(queries, "query_id"), known(vectors, "vec_id"), score, SCORED), top)


def quantised(x: np.ndarray) -> np.ndarray:
    """Rows as whole numbers of 8 bits by the largest of the row; halves go away from zero."""
    a = x * 127 / np.maximum(np.abs(x).max(1, keepdims=True), 1e-9)
    t = np.trunc(a)
    return t + np.sign(a) * (np.abs(a - t) >= 0.5)


def quantised_recall(queries: DataFrame, vectors: DataFrame, top: int = 10, kept: int = 20) -> DataFrame:
    """(query_id, found): of the `top` exact neighbours of a query, how many are among the `top` of the `kept` best by 8-bit vectors. Ties go to the lesser vec_id.

    A block keeps what is among its best by either score, with both scores.
    """

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("vec_id", kind="stable")
        x, y = (np.asarray([np.asarray(v, np.float64) for v in df["embedding"]]) for df in (a, b))
        whole = np.round(unit(x) @ unit(y).T, 6)
        rough = np.round(unit(quantised(x)) @ unit(quantised(y)).T, 6)
        held = np.zeros(whole.shape, bool)
        for found, n in ((whole, top), (rough, kept)):
            np.put_along_axis(held, np.argsort(-found, axis=1, kind="stable")[:, :n], True, axis=1)
        rows, places = np.nonzero(held)
        return pd.DataFrame({"query_id": a["query_id"].to_numpy()[rows], "vec_id": b["vec_id"].to_numpy()[places], "exact": whole[held], "rough": rough[held]})

    p = meet(_known(queries, "query_id"), _known(vectors, "vec_id"), score, "query_id long, vec_id long, exact double, rough double")
    at = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "vec_id"))
    seated = p.withColumn("place", at("exact")).withColumn("seat", at("rough")).filter(F.col("seat") <= kept)
    final = seated.withColumn("final", at("exact")).filter((F.col("final") <= top) & (F.col("place") <= top))
    return final.groupBy("query_id").agg(F.count("*").alias("found"))


@dataclass(frozen=True)
class Planes:
    """Random hyperplanes: `tables` hashes of `bits` bits each."""

    tables: int
    bits: int
    seed: int = 7

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each row in each table."""
        planes = np.random.default_rng(self.seed).standard_normal((x.shape[1], self.tables * self.bits))
        sides = (x @ planes > 0).reshape(len(x), self.tables, self.bits)
        return (sides @ (1 << np.arange(self.bits))).astype(np.int32)


def fit(vectors: DataFrame, target: float = 0.95, near: int = 10, tables: int = 32, sample: int = 2_000, asked: int = 100) -> Planes:
    """The most bits a hash with which a sample of at most `sample` vectors (least hashes of their ids) finds the share `target` of the `near` nearest of `asked` of
    its vectors. With more vectors the nearest come nearer, so the whole index tends to find more; recall() measures it.
    """
    kept = vectors.filter("embedding IS NOT NULL").select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    x = unit([r.embedding for r in kept])
    if len(x) < 2:
        return Planes(tables, 1)
    found = x[:asked] @ x.T
    best = np.argsort(-found, axis=1, kind="stable")[:, : near + 1]
    for bits in (12, 10, 8, 7, 6, 5, 4, 3, 2):
        planes = Planes(tables, bits)
        b = planes.buckets(x)
        hit = (b[:asked, None, :] == b[best]).any(2)
        if hit[:, 1:].mean() >= target:
            return planes
    return Planes(tables, 1)


def coded(vectors: DataFrame, planes: Planes, key: str) -> DataFrame:
    """(key, code, tab, bucket): a row for each table of the index; code holds a byte a number, by the largest of the vector."""

    def run(batches):
        for batch in batches:
            x = unit(batch.column("embedding").to_pylist())
            if not len(x):
                continue
            largest = np.abs(x).max(1, keepdims=True)
            codes = np.round(x * 127 / np.where(largest == 0, 1.0, largest)).astype(np.int8)
            raw = [c.tobytes() for c in codes]
            n, t = len(x), planes.tables
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(key).to_numpy(), t)), pa.array([c for c in raw for _ in range(t)], pa.binary()), pa.array(np.tile(np.arange(t, dtype=np.int32), n)), pa.array(planes.buckets(x).ravel())],
                [key, "code", "tab", "bucket"],
            )

    return vectors.filter("embedding IS NOT NULL").select(key, "embedding").mapInArrow(run, f"{key} long, code binary, tab int, bucket int")


def approximate(queries: DataFrame, vectors: DataFrame, planes: Planes, top: int = 10, kept: int | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank) like exact(), among vectors that share a bucket of some table with the query.

    Codes of 8 bits choose `kept` (twice `top` where unset) candidates, which the whole vectors rank. Buckets with more rows than a block holds
    are dealt to several; their sizes, at most tables * 2 ** bits rows, go out to all tasks.
    """
    kept = kept or 2 * top
    v, q = coded(vectors, planes, "vec_id"), coded(queries, planes, "query_id")
    size = lambda df, most, name: df.groupBy("tab", "bucket").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = F.broadcast(size(v, VECTORS, "v_blocks").join(size(q, QUERIES, "q_blocks"), ["tab", "bucket"]))  # a row a bucket
    blocks = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    v = v.join(sizes, ["tab", "bucket"]).select("vec_id", "code", "tab", "bucket", own("vec_id", "v_blocks").alias("v_block"), F.explode(blocks("q_blocks")).alias("q_block"))
    q = q.join(sizes, ["tab", "bucket"]).select("query_id", "code", "tab", "bucket", own("query_id", "q_blocks").alias("q_block"), F.explode(blocks("v_blocks")).alias("v_block"))

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, y = (unit([np.frombuffer(c, np.int8) for c in df["code"]]) for df in (a, b))
        return row_best(a["query_id"].to_numpy(), b["vec_id"].to_numpy(), x @ y.T, kept)

    block = ["tab", "bucket", "q_block", "v_block"]
    rough = q.groupBy(*block).cogroup(v.groupBy(*block)).applyInPandas(score, SCORED).distinct()
    chosen = ranked(rough, kept).select("query_id", "vec_id")
    whole = lambda df, key, name: df.select(key, F.transform("embedding", lambda x: x.cast("double")).alias(name))
    pairs = chosen.join(whole(vectors, "vec_id", "v"), "vec_id").join(whole(queries, "query_id", "q"), "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(dot(F.col("q"), F.col("q")) * dot(F.col("v"), F.col("v")))
    scored = pairs.select("query_id", "vec_id", F.round(F.coalesce(F.try_divide(dot(F.col("q"), F.col("v")), length), F.lit(0.0)), 6).alias("score"))
    return ranked(scored, top)


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, found, wanted): how many of each query's wanted vectors were found."""
    hit = wanted.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.groupBy("query_id").agg(F.count("hit").alias("found"), F.count("*").alias("wanted"))
