"""The most frequent values by bounded counters, exactly."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructType


def sketch(df: DataFrame, column: str, counters: int) -> DataFrame:
    """(column, low, lost) from each task: at most `counters` values with a lower bound of their counts.

    Counts of a batch are added; beyond `counters` values all lose the largest count that then has to go. A value was seen at most low + lost
    times, and lost is at most the task's rows / (counters + 1). `lost` stands in one row a task, with a null value.
    """
    schema = StructType([df.schema[column]]).add("low", LongType()).add("lost", LongType())
    kind = to_arrow_type(df.schema[column].dataType)

    def run(batches):
        held, lost = Counter(), 0
        for batch in batches:
            for value, n in zip(*(x.to_pylist() for x in pc.value_counts(batch.column(column)).flatten()), strict=True):
                if value is not None:
                    held[value] += n
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                lost += cut
                held = Counter({k: n - cut for k, n in held.items() if n > cut})
        yield pa.RecordBatch.from_arrays([pa.array([*held, None], kind), pa.array([*held.values(), 0]), pa.array([0] * len(held) + [lost])], [column, "low", "lost"])

    return df.select(column).mapInArrow(run, schema)


def heavy_hitters(df: DataFrame, column: str, k: int, counters: int = 4096) -> DataFrame:
    """(column, n) of the k most frequent values with their exact counts; ties go to the lesser value.

    Tasks' counters are added up, which keeps their error: a value that no counter holds was seen at most `lost` times. Where the k-th lower
    bound is above that, the k most frequent are among those whose upper bound reaches it, and a second pass counts these exactly. Where it
    isn't, no few values stand out, and all are counted. Null values are left out; with fewer than k values all are returned.
    """
    merged = sketch(df, column, counters).groupBy(column).agg(F.sum("low").alias("low"), F.sum("lost").alias("lost")).cache()
    try:
        lost = merged.filter(F.col(column).isNull()).agg(F.sum("lost")).first()[0] or 0
        kth = merged.filter(F.col(column).isNotNull()).orderBy(F.desc("low")).limit(k).agg(F.min("low"), F.count("*")).first()
        known = df.filter(F.col(column).isNotNull())
        if lost and (kth[1] < k or kth[0] <= lost):
            counted = known
        else:
            # at most (all rows) / (kth - lost) values, and no more than counters a task
            near = [r[0] for r in merged.filter(F.col(column).isNotNull() & (F.col("low") + lost >= kth[0])).select(column).limit(counters + 1).collect()] if kth[1] else []
            counted = known.filter(F.col(column).isin(near)) if len(near) <= counters else known
    finally:
        merged.unpersist()
    return counted.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)
