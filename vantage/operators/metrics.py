"""Metric points: validation, series keys, and order-sensitive folds of series into windows.

A point has service, name, labels, kind, value, us (event time), source and seq. The state of a series belongs to one
window: nothing carries over from the window before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions.time import window_start

KINDS = ("counter", "gauge", "histogram")
GAMMA = 1.025


def points_from_events(events: DataFrame) -> DataFrame:
    """Metric points made from the events table."""
    region = F.create_map(F.lit("region"), (F.col("user_id") % 3).cast("string"))
    points = events.select(
        "event_id",
        F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string")).alias("service"),
        F.col("event_type").alias("name"),
        region.alias("labels"),
        F.when(F.col("event_type") == "click", "counter").when(F.col("event_type") == "view", "gauge").otherwise("histogram").alias("kind"),
        "value",
        "cents",
        "us",
        F.concat(F.lit("pod-"), (F.col("user_id") % 10).cast("string")).alias("source"),
    ).withColumn("series", series_key())
    return points.withColumn("seq", F.row_number().over(Window.partitionBy("source", "series").orderBy("event_id")).cast("long"))


def series_key(service: str = "service", name: str = "name", labels: str = "labels") -> Column:
    """service, name and sorted k=v labels, joined by the unit separator."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws("\x1f", F.col(service), F.col(name), F.array_join(pairs, "\x1f"))


def validate(points: DataFrame, max_labels: int = 32) -> DataFrame:
    """Add `error`: the first rule that a point breaks, or null."""
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    rules = [
        (F.coalesce(F.col("service"), F.lit("")) == "", "service"),
        (F.coalesce(F.col("name"), F.lit("")) == "", "name"),
        (F.coalesce(F.col("source"), F.lit("")) == "", "source"),
        (F.col("us").isNull(), "event_time"),
        (~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "kind"),
        (~finite, "value"),
        (F.size("labels") > max_labels, "labels"),
    ]
    error = F.when(rules[0][0], rules[0][1])
    for broken, name in rules[1:]:
        error = error.when(broken, name)
    return points.withColumn("error", error)


def fold(points: DataFrame, size: int) -> DataFrame:
    """Count, sum, minimum, maximum, mean and last value of each series in each window of `size` microseconds."""
    last = F.max_by("cents", F.struct("us", -F.col("seq")))
    return (
        points.groupBy("series", window_start("us", size).alias("start_us"))
        .agg(F.count("*").alias("n"), F.sum("cents").alias("sum_cents"), F.min("cents").alias("min_cents"), F.max("cents").alias("max_cents"), last.alias("last_cents"), F.max("us").alias("last_us"))
        .withColumn("mean_cents", F.col("sum_cents") / F.col("n"))
    )


def counter_deltas(points: DataFrame, size: int) -> DataFrame:
    """Growth, resets and rate a second of counters, in order of seq within a source's stream.

    The first point of a stream in a window adds nothing; a decrease is a reset and adds the whole new value.
    """
    at = Window.partitionBy("series", "source", "start_us").orderBy("seq")
    step = points.filter(F.col("kind") == "counter").withColumn("start_us", window_start("us", size)).withColumn("prev", F.lag("cents").over(at))
    reset = F.col("cents") < F.col("prev")
    delta = F.when(F.col("prev").isNull(), 0).when(reset, F.col("cents")).otherwise(F.col("cents") - F.col("prev"))
    return (
        step.groupBy("series", "start_us")
        .agg(F.sum(delta).alias("delta_cents"), F.count_if(reset).alias("resets"))
        .withColumn("rate", F.col("delta_cents") / (size / 1_000_000))
    )


def gauge_last(points: DataFrame, size: int, arrival: str = "event_id") -> DataFrame:
    """The gauge's value of greatest event time (of ties, the first in seq), and how many points came out of order."""
    at = Window.partitionBy("series", "start_us").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    step = points.filter(F.col("kind") == "gauge").withColumn("start_us", window_start("us", size)).withColumn("seen", F.max("us").over(at))
    return step.groupBy("series", "start_us").agg(F.max_by("cents", F.struct("us", -F.col("seq"))).alias("last_cents"), F.count_if(F.col("us") < F.col("seen")).alias("out_of_order"))


def bucket(value: str = "value") -> Column:
    """Log bucket of a positive value; the ratio of logs is rounded, so that exact powers fall the same way everywhere."""
    return F.ceil(F.round(F.log(F.col(value)) / F.log(F.lit(GAMMA)), 9)).cast("long")


def sketch(points: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Counts by log bucket; values of zero or less share the null bucket."""
    at = F.when(F.col(value) > 0, bucket(value))
    return points.groupBy(*keys, at.alias("bucket")).agg(F.count("*").alias("n"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def sketch_quantile(sketches: DataFrame, keys: list[str], q: float) -> DataFrame:
    """The value at rank ceil(q * n): the middle of its bucket; 0 where zeros and negatives reach that rank."""
    order = Window.partitionBy(*keys).orderBy(F.col("bucket").asc_nulls_first())
    ranked = sketches.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    hit = ranked.filter(F.col("upto") >= F.greatest(F.lit(1), F.ceil(q * F.col("total"))))
    first = hit.groupBy(*keys).agg(F.min_by("bucket", "upto").alias("bucket"), F.max("total").alias("n"))
    middle = 2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (1 + GAMMA)
    return first.select(*keys, "n", F.when(F.col("bucket").isNull(), 0.0).otherwise(F.round(middle, 6)).alias("value"))


def merge_aggregates(folds: DataFrame, size: int) -> DataFrame:
    """Merge folds of the same series and window: sums add, the last value is the latest, rates are taken anew."""
    return (
        folds.groupBy("series", "start_us")
        .agg(F.sum("n").alias("n"), F.sum("sum_cents").alias("sum_cents"), F.min("min_cents").alias("min_cents"), F.max("max_cents").alias("max_cents"), F.max_by("last_cents", F.struct("last_us", "last_cents")).alias("last_cents"))
        .withColumn("per_second", F.col("n") / (size / 1_000_000))
    )


def window_quality(points: DataFrame, size: int, lateness: int, arrival: str = "event_id") -> DataFrame:
    """Per series and window: points behind the watermark, gaps in seq, points out of order, and whether it is partial."""
    before = Window.partitionBy("series").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    stream = Window.partitionBy("series", "source").orderBy("seq")
    step = (
        points.withColumn("seen", F.max("us").over(before))
        .withColumn("prev_seq", F.lag("seq").over(stream))
        .withColumn("start_us", window_start("us", size))
    )
    late = F.coalesce(F.col("us") < F.col("seen") - lateness, F.lit(False))
    gaps = F.greatest(F.col("seq") - F.col("prev_seq") - 1, F.lit(0))
    return (
        step.groupBy("series", "start_us")
        .agg(F.count_if(late).alias("late"), F.coalesce(F.sum(gaps), F.lit(0)).alias("gaps"), F.count_if(F.col("us") < F.col("seen")).alias("out_of_order"))
        .withColumn("partial", (F.col("late") > 0) | (F.col("gaps") > 0))
    )


def error_report(checked: DataFrame, detail: int = 32, order: str = "event_id") -> DataFrame:
    """Per error: how many, the first `detail` ids, and how many details were left out."""
    bad = checked.filter(F.col("error").isNotNull()).withColumn("at", F.row_number().over(Window.partitionBy("error").orderBy(order)))
    first = F.array_sort(F.collect_list(F.when(F.col("at") <= detail, F.col(order))))
    return bad.groupBy("error").agg(F.count("*").alias("n"), F.array_join(first, ",").alias("first_ids"), F.count_if(F.col("at") > detail).alias("dropped_detail"))


def reorder(points: DataFrame) -> DataFrame:
    """Each stream in order of seq without repeats; gap: how many numbers are missing before a point; dups: copies dropped."""
    stream = Window.partitionBy("series", "source").orderBy("seq")
    once = points.groupBy("series", "source", "seq").agg(F.min_by("cents", "event_id").alias("cents"), (F.count("*") - 1).alias("dups"))
    return once.withColumn("gap", F.coalesce(F.col("seq") - F.lag("seq").over(stream) - 1, F.lit(0)))
