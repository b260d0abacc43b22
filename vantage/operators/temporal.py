"""Time-aware joins, sessions, trailing windows and rollups. Times are microseconds since 1970."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions.time import window_start


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__at", F.row_number().over(at)).filter(F.col("__at") == 1).drop("__at")


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, value: str, out: str) -> DataFrame:
    """Add to left the value of the latest right row of the key with time <= left's; null if there is none.

    Both sides go through one sort per key and a running last value, so no pair of rows is ever formed.
    """
    l = left.withColumn("__side", F.lit(1)).withColumn("__value", F.lit(None).cast(right.schema[value].dataType))
    r = right.select(key, time, F.col(value).alias("__value")).withColumn("__side", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True)
    at = Window.partitionBy(key).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn(out, F.last("__value", ignorenulls=True).over(at))
    return filled.filter(F.col("__side") == 1).drop("__side", "__value")


def validity(changes: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Intervals [valid_from, valid_to) from a change log; changes that change nothing are dropped."""
    at = Window.partitionBy(key).orderBy(time, value)
    changed = changes.withColumn("__before", F.lag(value).over(at)).filter(F.col("__before").isNull() | (F.col("__before") != F.col(value)))
    until = F.lead(time).over(Window.partitionBy(key).orderBy(time, value))
    return changed.select(key, value, F.col(time).alias("valid_from"), until.alias("valid_to")).withColumn("is_current", F.col("valid_to").isNull())


def sessions(events: DataFrame, key: str, time: str, gap: int, tie: str) -> DataFrame:
    """Sessions that a silence of more than `gap` ends."""
    at = Window.partitionBy(key).orderBy(time, tie)
    starts = events.withColumn("__new", F.coalesce((F.col(time) - F.lag(time).over(at) > gap).cast("int"), F.lit(1)))
    numbered = starts.withColumn("session", F.sum("__new").over(at))
    return numbered.groupBy(key, "session").agg(F.min(time).alias("start_us"), F.max(time).alias("end_us"), F.count("*").alias("n"))


def trailing(events: DataFrame, key: str, time: str, widths: dict[str, int], value: str) -> DataFrame:
    """Counts and sums of the rows of the key strictly before a row, within each width; rows of equal time don't count."""
    out = events
    for name, width in widths.items():
        span = Window.partitionBy(key).orderBy(time).rangeBetween(-width, -1)
        out = out.withColumn(f"n_{name}", F.count("*").over(span)).withColumn(f"sum_{name}", F.coalesce(F.sum(value).over(span), F.lit(0)))
    return out


def trailing_distinct(events: DataFrame, key: str, time: str, value: str, width: int) -> DataFrame:
    """Each row with n, how many different values the key has in the `width` up to and at the row's time. Rows without a key or a time are left out.

    A value counts from a row until `width` after it, or on while it comes again, so n is a running sum of values that begin to count less those that
    end: two rows of a key and time for each stretch at most, whatever the width holds.
    """
    known = events.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    same = Window.partitionBy(key, value).orderBy(time)
    before, after = F.lag(time).over(same), F.lead(time).over(same)
    counts = F.col(value).isNotNull()
    marked = known.withColumn("__first", counts & (before.isNull() | (before < F.col(time) - width))).withColumn("__last", counts & (after.isNull() | (after > F.col(time) + width)))
    # a row asks at its own time; what ends is a row that asks nothing
    change = lambda at, by, asks: F.struct(at.alias("at"), by.cast("long").alias("by"), F.lit(asks).alias("asks"))
    own, end = change(F.col(time), F.col("__first").cast("int"), True), change(F.col(time) + width + 1, F.lit(-1), False)
    rows = marked.withColumn("__c", F.explode(F.when(F.col("__last"), F.array(own, end)).otherwise(F.array(own))))
    span = Window.partitionBy(key).orderBy("__c.at").rangeBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("n", F.sum("__c.by").over(span)).filter("__c.asks").select(*events.columns, "n")


def attribute(touches: DataFrame, outcomes: DataFrame, key: str, width: int) -> DataFrame:
    """Each outcome with the last touch of the key in the width before it, one touch at most.

    touches and outcomes: (key, us, id). The last touch is the running last value in the key's order, kept if it is
    recent enough.
    """
    joined = asof_join(outcomes.select(key, "us", F.col("id").alias("outcome")), touches.select(key, "us", F.struct("us", "id").alias("touch")), key, "us", "touch", "touch")
    fresh = F.when(F.col("us") - F.col("touch.us") <= width, F.col("touch.id"))
    return joined.select(key, "outcome", fresh.alias("touch"))


def rollup_levels(events: DataFrame, sizes: list[int], key: str, time: str, value: str) -> list[DataFrame]:
    """Sums at each window size, every level made from the one before."""
    out = [events.groupBy(key, window_start(time, sizes[0]).alias("start_us")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))]
    for size in sizes[1:]:
        out.append(out[-1].groupBy(key, window_start("start_us", size).alias("start_us")).agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    return out


def salted_sum(df: DataFrame, key: str, value: str, salts: int, by: Column) -> DataFrame:
    """Count and sum a key in two phases, so that a hot key is spread over `salts` groups first."""
    first = df.groupBy(key, F.pmod(by, F.lit(salts)).alias("__salt")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return first.groupBy(key).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def adaptive_salted_sum(df: DataFrame, key: str, value: str, share: float, salts: int, by: Column) -> DataFrame:
    """salted_sum() for the keys that hold more than `share` of all rows; at most 1/share keys are broadcast."""
    sizes = df.groupBy(key).agg(F.count("*").alias("__n"))
    total = sizes.agg(F.sum("__n").alias("__all"))
    heavy = sizes.crossJoin(F.broadcast(total)).filter(F.col("__n") > share * F.col("__all")).select(key, F.lit(True).alias("__hot"))
    marked = df.join(F.broadcast(heavy), key, "left")
    salt = F.when(F.col("__hot"), F.pmod(by, F.lit(salts))).otherwise(F.lit(0))
    first = marked.groupBy(key, salt.alias("__salt")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return first.groupBy(key).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def funnel(events: DataFrame, key: str, steps: list[str], width: int) -> DataFrame:
    """Per key, the most steps matched in order within `width` of the first, over all starts.

    For each step, the latest start that reached it, as a running maximum over the key's events in time order. Windows
    sort and spill, so no row holds all events of a key.
    """
    out = events.filter(F.col("event_type").isin(*steps)).select(key, "us", "event_id", "event_type")
    before = Window.partitionBy(key).orderBy("us", "event_id", "event_type").rowsBetween(Window.unboundedPreceding, -1)
    for k, step in enumerate(steps):
        start = F.col("us") if k == 0 else F.max(f"__s{k - 1}").over(before)
        out = out.withColumn("__start", start).withColumn(f"__s{k}", F.when((F.col("event_type") == step) & (F.col("us") - F.col("__start") <= width), F.col("__start")))
    reached = [F.max(f"__s{k}").isNotNull().cast("int") for k in range(len(steps))]
    return out.groupBy(key).agg(sum(reached[1:], reached[0]).alias("depth"))


def capped_sessions(events: DataFrame, key: str, gap: int, longest: int) -> DataFrame:
    """(key, sessions): greedy sessions, each ended by a gap of more than `gap` or when it has lasted more than `longest`.

    A fold over each key's times in order; the task keeps two times of one key, however many events that key has.
    """
    name = events.schema[key].dataType.simpleString()

    def fold(batches):
        at, first, last, n = None, 0, 0, 0
        for batch in batches:
            keys, counts = [], []
            for k, us in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n and k != at:
                    keys.append(at)
                    counts.append(n)
                    n = 0
                if not n or us - last > gap or us - first > longest:
                    first, n = us, n + 1
                at, last = k, us
            yield pa.record_batch([pa.array(keys, batch.schema.field(0).type), pa.array(counts, pa.int64())], names=[key, "sessions"])
        if n:
            yield pa.record_batch([pa.array([at], batch.schema.field(0).type), pa.array([n], pa.int64())], names=[key, "sessions"])

    own = events.filter(F.col("us").isNotNull()).select(key, "us")
    return own.repartition(key).sortWithinPartitions(key, "us").mapInArrow(fold, f"{key} {name}, sessions long")


def count_runs_then(events: DataFrame, key: str, run: str, then: str, types: list[str]) -> DataFrame:
    """(key, matches, n): how often an event of type `then` follows a run of type `run`, and the key's events of the types.

    Events of other types are passed over. A match is an event whose predecessor in the key's order ends a run.
    """
    kind = F.when(F.col("event_type").isin(*types), F.col("event_type"))
    before = Window.partitionBy(key).orderBy("us", "event_id", "event_type").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.select(key, "us", "event_id", "event_type", kind.alias("__kind")).withColumn("__last", F.last("__kind", ignorenulls=True).over(before))
    return rows.groupBy(key).agg(F.count_if((F.col("__kind") == then) & (F.col("__last") == run)).cast("int").alias("matches"), F.count("__kind").cast("int").alias("n"))
