"""Structured Streaming operators. Each takes a streaming or a batch DataFrame and returns one of the same kind."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from vantage.runtime import shared_dir


def read_events(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The events table as a stream of files; the schema is fixed, time has a zone so that a watermark can hold it."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/events.parquet*")
    return raw.withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())).withColumn("cents", F.round(F.col("value") * 100).cast("long"))


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there now into a Parquet table in the shared folder, and read that table."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/vantage/stream-{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def run_upserts(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run an aggregate in update mode; every batch's rows are kept with its number, the last of each key is the result.

    Rows hold absolute values and the batch number as a version, so a batch that is written twice changes nothing.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/vantage/stream-{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{base}/table/batch={number}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{base}/table").drop("batch")
    others = [c for c in rows.columns if c not in (*keys, "version")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "version").alias("v"), F.max("version").alias("version"))
    return last.select(*keys, "v.*", "version")


def windowed(events: DataFrame, size: str, delay: str, keys: list[str | Column], slide: str | None = None) -> DataFrame:
    """Counts and sums in windows that close when the watermark passes them."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", delay).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("cents").alias("total"))
    names = [k if isinstance(k, str) else "key" for k in keys]
    return out.select(F.unix_micros("w.start").alias("start_us"), *names, "n", "total")


def sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Sessions of a user; rows without a user are not let in."""
    keyed = events.filter(F.col("user_id").isNotNull()).withWatermark("ts", delay)
    out = keyed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


def distinct_within(events: DataFrame, key: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def salted_windows(events: DataFrame, size: str, delay: str, key: str, salts: int) -> DataFrame:
    """Windowed sums of a hot key in two stateful steps: by salt, then over the salts."""
    first = events.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w"), key, (F.col("event_id") % salts).alias("salt")).agg(F.count("*").alias("n"), F.sum("cents").alias("total"))
    second = first.groupBy(F.window(F.window_time("w"), size).alias("w2"), key).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return second.select(F.unix_micros("w2.start").alias("start_us"), key, "n", "total")


def interval_join(left: DataFrame, right: DataFrame, delay: str, most: str) -> DataFrame:
    """Pairs of left and right rows of a user where right comes 0 to `most` after left."""
    a = left.select(F.col("event_id").alias("left_id"), F.col("user_id").alias("left_user"), F.col("ts").alias("left_ts")).withWatermark("left_ts", delay)
    b = right.select(F.col("event_id").alias("right_id"), F.col("user_id").alias("right_user"), F.col("ts").alias("right_ts")).withWatermark("right_ts", delay)
    return a.join(b, F.expr(f"left_user = right_user AND right_ts >= left_ts AND right_ts <= left_ts + INTERVAL {most}")).select("left_id", "right_id")


class Totals(StreamingQueryListener):
    """Sums of all progress reports of one query; the query itself keeps only its last ones."""

    def __init__(self):
        self.reports: dict[str, dict[str, int]] = {}
        self.ended: dict[str, threading.Event] = {}

    def of(self, run: str) -> tuple[dict[str, int], threading.Event]:
        start = {"input_rows": 0, "late_rows": 0, "batches": 0}
        return self.reports.setdefault(run, start), self.ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        self.of(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        sums, _ = self.of(str(p.runId))
        sums["input_rows"] += p.numInputRows
        sums["late_rows"] += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        sums["batches"] += p.numInputRows > 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.of(str(event.runId))[1].set()


def run_with_progress(stream: DataFrame, name: str) -> tuple[DataFrame, dict[str, int]]:
    """run_to_table, and what the query reported of itself: rows read, rows dropped as late, batches that read rows."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/vantage/stream-{name}-{uuid.uuid4().hex}"
    totals = Totals()
    spark.streams.addListener(totals)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        progress, ended = totals.of(str(query.runId))
        if not ended.wait(60):  # reports come in order, so this is the last
            raise TimeoutError("the stream's reports did not end")
    finally:
        spark.streams.removeListener(totals)
    return spark.read.schema(stream.schema).parquet(f"{base}/table"), progress
