"""Best-fit packing of token documents into sequences, after a Martello-Toth dominance reduction.

Only the histogram of piece lengths, which has `max_tokens` entries however large the corpus is, reaches the driver.
There `plan_sequences` makes a plan of runs: the pieces of a length with ranks a..b go to sequences s..s+(b-a), at one
offset. Tasks then look their pieces up in the plan.

1. Reduction. From the longest length down, a piece is fixed in a set of up to three wherever that set dominates every
   other set which holds the piece, so an optimal packing with that set exists: see dominant_set().
2. Best fit, longest first, on what remains: each piece goes to the fullest sequence that can take it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantage.llm.arrays import slices, starts, texts
from vantage.llm.tokens import tokenizer
from vantage.runtime import settle

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def pieces_of(docs: DataFrame, file: str, max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenize (doc_id, text) and cut into pieces of at most max_tokens ids; the end id closes each document.

    part and place: the task, and the piece's rank among those of its length there. A null text counts as empty and
    yields the end id alone. Repeated rows stay separate documents.
    """

    def cut(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(max_tokens + 1, np.int64)
        coder = tokenizer(file)
        for batch in slices(batches, "text"):
            counts, ids = coder.encode(texts(batch))
            at = starts(counts)
            whole = counts + 1
            n = -(-whole // max_tokens)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(starts(n)[:-1], n)
            start = piece * max_tokens
            length = np.minimum(whole[row] - start, max_tokens)
            end = np.array([end_id], "<u4").tobytes()
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            crc = np.empty(len(row), np.int64)
            for k, (r, s, m) in enumerate(zip(row.tolist(), start.tolist(), length.tolist(), strict=True)):
                a = int(at[r]) + s
                b = min(a + m, int(at[r + 1]))
                x = zlib.crc32(raw[4 * a : 4 * b])
                crc[k] = zlib.crc32(end, x) if b - a < m else x
            order = np.argsort(length, kind="stable")
            place = np.empty(len(row), np.int64)
            by, first, many = np.unique(length[order], return_index=True, return_counts=True)
            place[order] = np.arange(len(row)) - np.repeat(first, many) + np.repeat(seen[by], many)
            seen[by] += many
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(row)).cast(pa.int64()),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "part": pa.array(np.full(len(row), part), pa.int32()),
                    "place": pa.array(place, pa.int64()),
                }
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def dominant_set(left: np.ndarray, w: int) -> tuple[int, ...] | None:
    """What goes beside a piece of length w in a set that dominates every other set with that piece; None if none is known.

    left: how many pieces of each length there are. A set dominates another if its pieces can be matched with groups of
    the other's that are no longer. So it is enough to look at what fits beside w: nothing; one piece at most, of which
    the longest dominates; or two at most, where the longest dominates if it is as long as any two together, and it and
    the longest beside it do if no two that fit have a longer second one. An exact complement dominates always.
    """
    room = len(left) - 1 - w
    own = left[: room + 1].copy()
    if w <= room:
        own[w] -= 1  # this piece itself is no partner
    some = np.flatnonzero(own)
    if not len(some):
        return ()
    longest = int(some[-1])
    low = np.repeat(some[:3], np.minimum(own[some[:3]], 3))[:3].tolist()
    if longest == room or len(low) < 2 or low[0] + low[1] > room:
        return (longest,)
    if len(low) == 3 and sum(low) <= room:
        return None
    # the longest piece beside each as the shorter of two, and beside each as the longer
    k = np.searchsorted(some, room - some, side="right") - 1
    k = np.where((k >= 0) & (some[k] == some) & (own[some] < 2), k - 1, k)
    sums = np.where(k >= 0, some + some[k], 0)
    if sums.max() <= longest:
        return (longest,)
    second = room - longest
    beside = some[(some <= second) & ((some != longest) | (own[some] > 1))]
    if not len(beside):
        return None
    above = np.where(own[some] > 1, some, np.append(some[1:], len(left)))  # the least other piece that is no shorter
    if some[some + above <= room].max(initial=0) <= beside[-1]:
        return (longest, int(beside[-1]))
    return None


def plan_sequences(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, last rank + 1, first sequence, offset) that place every piece of the histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    total = left.copy()
    rows: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(w: int, n: int, at: int, offset: int) -> None:
        a = int(total[w] - left[w])
        rows.append((w, a, a + n, at, offset))
        left[w] -= n

    again = True
    while again:  # what one pass fixes can make further sets dominant
        again = False
        for w in range(capacity, 0, -1):
            while left[w] and (beside := dominant_set(left, w)) is not None:
                fixed = (w, *beside)
                # fewer pieces leave fewer sets to dominate, so the set stays dominant while its pieces last
                n = min(int(left[x]) // fixed.count(x) for x in fixed)
                at = 0
                for x in fixed:
                    put(x, n, opened, at)
                    at += x
                opened += n
                again = True

    open_at: dict[int, list[tuple[int, int]]] = {}
    for w in range(capacity, 0, -1):
        while left[w]:
            room = min((r for r in open_at if r >= w), default=0)
            if room:
                first, bins = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room]
            else:
                room, first, bins = capacity, opened, -(-int(left[w]) // (capacity // w))
                opened += bins
            each = room // w
            full = min(bins, int(left[w]) // each)
            for k in range(each if full else 0):
                put(w, full, first, capacity - room + k * w)
            if full:
                rest = room - each * w
                if rest:
                    open_at.setdefault(rest, []).append((first, full))
            if full < bins:
                some = int(left[w])
                for k in range(some):
                    put(w, 1, first + full, capacity - room + k * w)
                rest = room - some * w
                if some:
                    open_at.setdefault(rest, []).append((first + full, 1))
                    full += 1
                if full < bins:
                    open_at.setdefault(room, []).append((first + full, bins - full))
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place_pieces(pieces: DataFrame, max_tokens: int = 2048) -> DataFrame:
    """Add sequence_id and offset to the pieces of pieces_of(); reads them twice, so pass a settled table."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    spark = pieces.sparkSession
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_sequences(histogram, max_tokens))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank")
    )

    def look_up(batches):
        rows = plan.value
        key = (rows[:, 0] << 48) + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(x).to_numpy() for x in ("length", "rank"))
            k = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            out = {x: batch.column(x) for x in names}
            out["sequence_id"] = pa.array(rows[k, 3] + rank - rows[k, 1], pa.int64())
            out["offset"] = pa.array(rows[k, 4], pa.int64())
            yield pa.record_batch(out)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(look_up, schema)


def pack(docs: DataFrame, file: str, max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack whole documents into sequences of at most max_tokens ids.

    Cases: a null or empty text is one piece that holds the end id; repeated rows are packed each; equal lengths are
    placed in any order; a text of any length is cut into pieces of max_tokens ids, all of which are packed; an empty table gives no rows; columns other than doc_id and text are ignored; a null doc_id
    is kept.
    """
    return place_pieces(settle(pieces_of(docs, file, max_tokens, end_id), "pieces"), max_tokens)
