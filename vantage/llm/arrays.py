"""Small numpy and Arrow helpers used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a text or binary column holds about `most` bytes in each; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = ends[at] - size[at]
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """A text column with nulls as empty texts and 64-bit offsets."""
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


def list_parts(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths and flat values of a list array."""
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


def starts(lengths: np.ndarray) -> np.ndarray:
    """Offsets with a leading zero and the total last."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ragged rows `pick` of (data, start, length) one after the other, and their lengths."""
    n = length[pick]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    shift = start[pick] - (ends - n)
    return data[np.repeat(shift, n) + np.arange(total, dtype=np.int64)], n


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x
