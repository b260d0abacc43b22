"""Benchmark decontamination by the q-gram lemma.

An item of m characters that occurs in a text with at most k edits shares at least m + 1 - q(k + 1) of its q-grams with
that place, and all these hits lie on neighbouring diagonals (text position minus item position). So:

1. Every q-gram of a text is looked up among the items' q-grams; hits are counted in overlapping bands of diagonals, wide
   enough that some band holds all hits of an occurrence.
2. Bands whose count meets the bound are kept; no occurrence within the edit budget can be lost.
3. A banded alignment of the item against that part of the text, only on the diagonals of the band and the edits beside
   it, verifies each and finds its place and its edits.

Items that repeat a q-gram often (a row of dashes) would give a hit for each repeat at every position, so for them hits
count once a position, in overlapping windows of the text instead of bands: the lemma holds there too, and every
occurrence lies whole in some window.

Texts and items are compared letter by letter, lower-cased, any white space as a space, so places are code points of the
original. Items reach tasks in slices of bounded size; every slice scans all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.arrays import U64, gather, mix, slices, starts, texts

Q = 8
TABLE_BITS = 22
REPEATS = 4  # an item that holds one q-gram more often is counted in windows
MATCHES = "doc_id long, item_id long, start int, end int, edits int, item_chars int"
_FOLD = np.arange(0x500, dtype=np.uint32)
for _c in range(0x500):
    _s = chr(_c)
    _FOLD[_c] = 32 if _s.isspace() else ord(_s.lower()) if len(_s.lower()) == 1 else _c
_FOLD[0] = 32


def fold(text: str) -> np.ndarray:
    """Code points, lower-cased up to U+04FF, white space as spaces; as many as the text has."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    low = x < 0x500
    x[low] = _FOLD[x[low]]
    x[(x >= 0x2000) & (x <= 0x200A) | (x == 0x3000) | (x == 0x2028) | (x == 0x2029)] = 32
    return x


def grams(x: np.ndarray) -> np.ndarray:
    """A hash of the Q code points from each position on."""
    if len(x) < Q:
        return np.zeros(0, U64)
    base = 0x9E3779B97F4A7C15
    power = lambda n: U64(pow(base, n, 1 << 64))
    one = x.astype(U64)
    two = one[:-1] * power(1) + one[1:]
    four = two[:-2] * power(2) + two[2:]
    return mix(four[:-4] * power(4) + four[4:])


class Items:
    """The items of a slice with their q-grams, ready for look-up."""

    def __init__(self, rows: list[tuple[int, str]], rate: float):
        self.ids, self.codes = [], []
        for item_id, text in rows:
            x = fold(" ".join(text.split()))
            if len(x) >= Q:
                self.ids.append(item_id)
                self.codes.append(x)
        self.size = np.array([len(x) for x in self.codes], np.int64)
        self.edits = (rate * self.size).astype(np.int64)
        self.least = self.size + 1 - Q * (self.edits + 1)  # at least 1: see find_leaks()
        hashes = [grams(x) for x in self.codes]
        self.loose = np.array([np.unique(h, return_counts=True)[1].max() > REPEATS for h in hashes], bool)
        hashes = [np.unique(h) if loose else h for h, loose in zip(hashes, self.loose, strict=True)]
        self.width = np.int64(1) << np.ceil(np.log2(np.maximum(self.edits, 16))).astype(np.int64) if len(self.size) else self.size
        self.width = np.where(self.loose, self.size + self.edits, self.width)
        flat = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]) if hashes else np.zeros(0, np.int64)
        at = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        at[self.loose[item] if len(item) else []] = 0
        order = np.argsort(flat, kind="stable")
        self.keys, first, self.many = np.unique(flat[order], return_index=True, return_counts=True)
        self.first, self.item, self.at = first.astype(np.int64), item[order], at[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.keys >> U64(64 - TABLE_BITS)).astype(np.int64)] = True

    def hits(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text position, item, item position) of all shared q-grams; item position 0 for items counted in windows."""
        maybe = np.flatnonzero(self.table[(hashed >> U64(64 - TABLE_BITS)).astype(np.int64)])
        k = np.searchsorted(self.keys, hashed[maybe])
        k[k == len(self.keys)] = 0
        good = self.keys[k] == hashed[maybe] if len(self.keys) else np.zeros(0, bool)
        k, at = k[good], maybe[good]
        rows, n = gather(np.arange(len(self.item), dtype=np.int64), self.first, self.many, k)
        return np.repeat(at, n), self.item[rows], self.at[rows]


def _banded(item: np.ndarray, window: np.ndarray, row: np.ndarray, most: int) -> np.ndarray:
    """Edits of the item against each window on each diagonal of the band, from the costs `row` to start there.

    Column d of the result is diagonal d: it ends at window position d + len(item). What inserting costs along a row is a
    running minimum.
    """
    wide = row.shape[1]
    step = np.arange(wide, dtype=np.int32)
    for k, c in enumerate(item.tolist()):
        new = row + (window[:, k : k + wide] != c)
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        row = np.minimum.accumulate(new - step, axis=1) + step
        if k % 32 == 31 and row.min() > most:
            break
    return row


def align(item: np.ndarray, codes: np.ndarray, low: np.ndarray, begin: np.ndarray, end: np.ndarray, wide: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, edits) of the best place of item that starts on diagonals low to low + wide, for each of many texts.

    Texts are codes[begin:end]; start is -1 where no place is within `most` edits. Beyond a text's ends stands a code that
    equals none, which costs as much as leaving the item's letter out.
    """
    first, last, edits = np.full(len(low), -1), np.full(len(low), -1), np.full(len(low), most + 1)
    m, width = len(item), wide + 2 * most + 1
    nothing = np.uint32(0xFFFFFFFF)

    def window(at: np.ndarray, step: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        place = at[:, None] + step
        return np.where((place >= a[:, None]) & (place < z[:, None]), codes[np.clip(place, 0, len(codes) - 1)], nothing)

    together = max(1, 2_000_000 // (m + width))
    for k in range(0, len(low), together):
        some = slice(k, k + together)
        row = _banded(item, window(low[some] - most, np.arange(m + width), begin[some], end[some]), np.zeros((len(low[some]), width), np.int32), most)
        edits[some] = row.min(1)
        last[some] = low[some] - most + row.argmin(1) + m
        good = np.flatnonzero(edits[some] <= most) + k
        if not len(good):
            continue
        stop = last[good]
        apart = np.arange(-most, most + 1, dtype=np.int32)
        row = np.broadcast_to(np.where(apart >= 0, apart, 2 * m + 1), (len(good), len(apart))).astype(np.int32)
        row = _banded(item[::-1], window(stop - 1 + most, -np.arange(m + len(apart)), begin[good], end[good]), row, 2 * m)
        first[good] = np.maximum(stop - m - apart[row.argmin(1)], begin[good])
        last[good] = np.minimum(stop, end[good])
    return first, last, edits


def regions(codes: np.ndarray, bounds: np.ndarray, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(document, item, start, end, edits) of every verified place; places of an item that overlap become one.

    codes: folded documents, each followed by Q zeros; bounds: where each starts, and the end.
    """
    at, item, inner = items.hits(grams(codes))
    if not len(at):
        return []
    # a document's texts are apart, so a band belongs to the document of its hits
    doc = np.searchsorted(bounds, at, side="right") - 1
    width = items.width[item]
    shift = 2 * int(items.size.max())
    shifted = at - inner + shift
    band = shifted // width
    early = items.loose[item] | (shifted % width < items.edits[item])  # windows reach two steps far
    doc, item, band = (np.concatenate([x, y[early]]) for x, y in ((doc, doc), (item, item), (band, band - 1)))
    order = np.lexsort((band, item, doc))
    doc, item, band = doc[order], item[order], band[order]
    edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])]))
    count = np.diff(np.append(edge, len(doc)))
    kept = edge[count >= items.least[item[edge]]]
    doc, item, band = doc[kept], item[kept], band[kept]
    first, last, edits = np.full(len(doc), -1), np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
    begin, end = bounds[doc], bounds[doc + 1] - Q
    for i in np.unique(item).tolist():
        own = np.flatnonzero(item == i)
        most, wide = int(items.edits[i]), int(items.width[i])
        first[own], last[own], edits[own] = align(items.codes[i], codes, band[own] * wide - shift, begin[own], end[own], wide + most, most)
    found: list[tuple[int, int, int, int, int]] = []
    good = np.flatnonzero(first >= 0)
    for row in zip(*(x[good].tolist() for x in (doc, item, first - begin, last - begin, edits)), strict=True):
        before = found[-1] if found else None
        if before and before[:2] == row[:2] and row[2] < before[3]:
            found[-1] = min(before, row, key=lambda x: x[4])
        else:
            found.append(row)
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, slice_chars: int = 8 << 20) -> DataFrame:
    """One row for each place where a benchmark item occurs in a document: (doc_id, item_id, start, end, edits, item_chars).

    rate: edits allowed per character of the item, at most 1/16, so that the lemma's bound is positive for every item.
    Cases: null or empty texts have no places; items of fewer than 8 characters after white space is squeezed are too short
    to tell and have none; an item that occurs again without overlap has a row for each; places of an item that
    overlap are one, and an item that repeats itself has one a window of twice its length; repeated rows, of documents or items, count
    each; of overlapping places with equal edits the earlier one counts; texts and items of any length are read whole; an empty table
    gives no rows; columns other than doc_id, item_id and text are ignored. doc_id and item_id may be null.
    """
    if not 0 <= rate <= 0.5 / Q:
        raise ValueError(f"rate must be between 0 and {0.5 / Q}")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // slice_chars))
    out = None
    for part in range(parts):
        some = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        rows = [(r.item_id, r.text) for r in some.collect()]  # about slice_chars characters
        found = own.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(sorted(rows, key=str)), rate), MATCHES)
        out = found if out is None else out.unionByName(found)
    return out


def _scan(given, rate: float):
    def scan(batches):
        items = Items(given.value, rate)
        gap = np.zeros(Q, np.uint32)
        for batch in slices(batches, "text", 1 << 20):
            folded = [fold(x) for x in texts(batch).to_pylist()]
            bounds = starts(np.array([len(x) + Q for x in folded]))
            found = regions(np.concatenate([y for x in folded for y in (x, gap)]), bounds, items) if len(items.size) else []
            if not found:
                continue
            d, i, a, z, e = (np.array(x) for x in zip(*found, strict=True))
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(d)),
                    "item_id": pa.array([items.ids[k] for k in i], pa.int64()),
                    "start": pa.array(a, pa.int32()),
                    "end": pa.array(z, pa.int32()),
                    "edits": pa.array(e, pa.int32()),
                    "item_chars": pa.array(items.size[i], pa.int32()),
                }
            )

    return scan


def drop_leaked(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06) -> DataFrame:
    """docs without the documents that hold a benchmark item; a null doc_id is never dropped."""
    leaked = find_leaks(docs, benchmark, rate).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)
