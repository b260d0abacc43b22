"""Running counts, sums and fingerprints along the rows of a key, however many rows one key holds.

Rows are dealt to range partitions by key and order, so a key with a third of all rows lies in many of them. Each task sums
up along its own rows; what a partition has to add for the key that it goes on with is worked out from one row a partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from vantage.runtime import settle

U64 = np.uint64
PRIME = (1 << 61) - 1
# any two numbers below PRIME would do: the bases of the two lanes of a fingerprint
BASES = (0x1B873593CC9E2D51, 0x165667B19E3779F9)


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for numbers below PRIME."""
    low, half = U64((1 << 31) - 1), U64(31)
    a_high, a_low, b_high, b_low = a >> half, a & low, b >> half, b & low
    middle = a_high * b_low + a_low * b_high
    out = a_high * b_high * U64(2) + (middle >> U64(30)) + ((middle & U64((1 << 30) - 1)) << half) + a_low * b_low
    return reduced(out)


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & U64(PRIME)) + (x >> U64(61))
    return np.where(x >= U64(PRIME), x - U64(PRIME), x)


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo PRIME."""
    out, square, left = np.ones(len(exponents), U64), np.full(1, base % PRIME, U64), exponents.astype(U64)
    while left.any():
        out = np.where(left & U64(1), multiply(out, square), out)
        square, left = multiply(square, square), left >> U64(1)
    return out


def summed(x: np.ndarray) -> np.ndarray:
    """Running sums modulo PRIME."""
    low, high = np.cumsum(x & U64((1 << 31) - 1)), np.cumsum(x >> U64(31))
    return reduced(reduced(low) + multiply(reduced(high), np.full(1, 1 << 31, U64)))


def running(df: DataFrame, key: str, order: list[str | Column], count: str, sums: dict[str, str] | None = None, prints: dict[str, str] | None = None, name: str = "running") -> DataFrame:
    """df with the row's number within its key, from 1, as `count`; running sums (64 bits, overflowing ones wrap) of the
    columns that `sums` maps new names to; and running fingerprints: for each name that `prints` maps to a column of numbers
    below PRIME, the polynomial of all values up to the row as `name`, and of those before it as `name_before`.

    `order` tells rows of one key apart; rows that tie on all of it come in any order and stay in one task. The key must not be null. The n-th of the `prints` takes the n-th base.
    """
    sums, prints = sums or {}, prints or {}
    added = [count, *sums, *(x for p in prints for x in (p, f"{p}_before"))]
    schema = StructType([*df.schema, *StructType().add("__part", LongType()).add("__at", LongType())])
    for x in added:
        schema = schema.add(x, LongType())
    bases = dict(zip(prints, BASES, strict=False))

    def local(batches):
        part, at, last, carry = TaskContext.get().partitionId(), 0, None, {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key)
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            new[0] = not carry or keys[0].as_py() != last
            begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            goes_on = np.cumsum(new) == 0
            out = {count: np.arange(n) - begin + 1 + np.where(goes_on, carry.get(count, 0), 0)}
            for x, source in sums.items():
                value = batch.column(source).to_numpy()
                total = np.cumsum(value)
                out[x] = total - total[begin] + value[begin] + np.where(goes_on, carry.get(x, 0), 0)
            for x, source in prints.items():
                term = multiply(batch.column(source).to_numpy().astype(U64), powers(bases[x], out[count]))
                total = summed(term)
                before = reduced(total + U64(PRIME) - term)
                inside = reduced(before + U64(PRIME) - before[begin])
                out[f"{x}_before"] = reduced(inside + np.where(goes_on, U64(carry.get(x, 0)), U64(0))).astype(np.int64)
                out[x] = reduced(out[f"{x}_before"].astype(U64) + term).astype(np.int64)
            last, carry = keys[-1].as_py(), {x: int(v[-1]) for x, v in out.items()}
            columns = [pa.array(np.full(n, part)), pa.array(np.arange(at, at + n)), *(pa.array(out[x]) for x in added)]
            at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema.names)

    placed = settle(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(local, schema), name)
    ends = placed.groupBy("__part").agg(F.min_by(key, "__at").alias("first"), F.max_by(F.struct(F.col(key).alias("__key"), *added), "__at").alias("last")).collect()  # a row a partition
    held: dict[int, tuple] = {}
    open_key, carry = None, {}
    for r in sorted(ends, key=lambda r: r["__part"]):
        goes_on = r.first == open_key
        if goes_on:
            held[r["__part"]] = (r.first, carry)
        whole = goes_on and r.last["__key"] == open_key
        carry = joined(carry, r.last.asDict(), count, sums, bases) if whole else r.last.asDict()
        open_key = r.last["__key"]

    def carried(batches):
        for batch in batches:
            parts = batch.column("__part").to_numpy()
            out = {x: batch.column(x).to_numpy().copy() for x in added}
            for part in np.unique(parts).tolist():
                if part in held:
                    first, before = held[part]
                    rows = np.flatnonzero((parts == part) & pc.equal(batch.column(key), pa.scalar(first, batch.schema.field(key).type)).to_numpy(zero_copy_only=False))
                    if len(rows):
                        moved = joined(before, {x: v[rows] for x, v in out.items()}, count, sums, bases)
                        for x in added:
                            out[x][rows] = moved[x]
            kept = [k for k in batch.schema.names if k not in added and k not in ("__part", "__at")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *(pa.array(out[x]) for x in added)], [*kept, *added])

    final = StructType([f for f in schema if f.name not in ("__part", "__at")])
    out = placed.mapInArrow(carried, final)
    out._vantage_path = placed._vantage_path
    return out


def joined(before: dict, after: dict, count: str, sums: dict[str, str], bases: dict[str, int]) -> dict:
    """Counts, sums and fingerprints of rows that follow others of the same key; `after` holds numbers or arrays."""
    single = not isinstance(after[count], np.ndarray)
    after = {x: np.atleast_1d(np.asarray(v, np.int64)) for x, v in after.items() if x != "__key"}
    out = {count: after[count] + before[count]}
    out |= {x: after[x] + np.int64(before[x]) for x in sums}
    for x, base in bases.items():
        shift = powers(base, np.full(1, before[count]))
        for y in (x, f"{x}_before"):
            out[y] = reduced(multiply(after[y].astype(U64), shift) + U64(before[x])).astype(np.int64)
    return {x: int(v[0]) for x, v in out.items()} if single else out
