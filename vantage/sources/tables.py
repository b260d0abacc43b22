"""The driver's tables with the derived columns that queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.functions.time import micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with time in microseconds, value in cents, and the number in props."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        micros("ts").alias("us"),
        "user_id",
        "event_type",
        "value",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with time in microseconds and the price in cents."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", micros("o_orderdate").alias("us"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")
    )


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with time in microseconds, the price in cents, quantity as a whole number, rates in hundredths."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("l_quantity").cast("long").alias("qty"), cents("l_extendedprice").alias("cents"),
        cents("l_discount").alias("disc"), cents("l_tax").alias("tax"), "l_returnflag", "l_linestatus", micros("l_shipdate").alias("us"),
    )


# the same rows in DuckDB, as common table expressions
EV = """ev AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value, CAST(round(value*100) AS BIGINT) AS cents,
 CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events)"""
OR = """o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, epoch_us(o_orderdate) AS us, CAST(round(o_totalprice*100) AS BIGINT) AS cents FROM orders)"""
LI = """li AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_quantity) AS BIGINT) AS qty, CAST(round(l_extendedprice*100) AS BIGINT) AS cents,
 CAST(round(l_discount*100) AS BIGINT) AS disc, CAST(round(l_tax*100) AS BIGINT) AS tax, l_returnflag, l_linestatus, epoch_us(l_shipdate) AS us FROM lineitem)"""
