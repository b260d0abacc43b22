"""Reconciliation, checksums, checks and exact money arithmetic. Money is whole cents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: int = 0) -> DataFrame:
    """Full comparison of two tables by key: class matched, tolerated, differs, only_left or only_right."""
    both = left.select(*keys, F.col(value).alias("left_value")).join(right.select(*keys, F.col(value).alias("right_value")), keys, "full")
    gap = F.abs(F.col("left_value") - F.col("right_value"))
    kind = F.when(F.col("right_value").isNull(), "only_left").when(F.col("left_value").isNull(), "only_right").when(gap == 0, "matched").when(gap <= tolerance, "tolerated").otherwise("differs")
    return both.withColumn("class", kind)


def chunk_checksums(df: DataFrame, key: str, columns: list[str], size: int) -> DataFrame:
    """Rows and a checksum of each key range of `size` keys; a null has a mark of its own."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    rows = df.select(F.floor(F.col(key) / size).cast("long").alias("chunk"), F.col(key).alias("k"), F.md5(text).alias("h"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "")
    return rows.groupBy("chunk").agg(F.count("*").alias("n"), F.md5(ordered).alias("checksum"))


def run_checks(df: DataFrame, checks: list[tuple[str, str, Column, float, str]]) -> DataFrame:
    """(name, dimension, share, threshold, severity, passed) of each check, from one aggregate.

    A check's column says whether a row is good; it passes where the share of good rows reaches the threshold.
    """
    one = df.agg(*[F.avg(F.coalesce(good, F.lit(False)).cast("double")).alias(name) for name, _, good, _, _ in checks])
    rows = [F.struct(F.lit(n).alias("name"), F.lit(d).alias("dimension"), F.col(n).alias("share"), F.lit(float(t)).alias("threshold"), F.lit(s).alias("severity"), (F.col(n) >= t).alias("passed")) for n, d, _, t, s in checks]
    return one.select(F.inline(F.array(*rows)))


def allocate(groups: DataFrame, group: str, part: str, weight: str, total: str) -> DataFrame:
    """Split `total` over the parts of each group in proportion to whole weights, so that the parts sum to it exactly.

    Each part gets the floor of its share; what is left goes, one by one, to the largest remainders, ties to the lesser part.
    """
    all_of = Window.partitionBy(group)
    w = F.sum(weight).over(all_of)
    share = groups.withColumn("__w", w).withColumn("amount", F.floor(F.col(total) * F.col(weight) / F.col("__w")).cast("long"))
    share = share.withColumn("amount", F.expr(f"({total} * {weight}) div __w")).withColumn("__rest", F.col(total) * F.col(weight) - F.col("amount") * F.col("__w"))
    left = F.col(total) - F.sum("amount").over(all_of)
    at = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("__rest"), part))
    return share.withColumn("amount", F.col("amount") + (at <= left).cast("long")).drop("__w", "__rest")


def balance(journal: DataFrame, account: str, as_of: int, time: str = "us") -> DataFrame:
    """Sum of each account's entries that are effective at or before as_of."""
    return journal.filter(F.col(time) <= as_of).groupBy(account).agg(F.sum("cents").alias("balance"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a share k/n."""
    p = k / n
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return (middle - half) / scale, (middle + half) / scale
