"""Session helpers that every subpackage shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't share the driver's path."""
    sc = spark.sparkContext
    if getattr(sc, "_vantage_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="vantage-")
    path = os.path.join(folder, "vantage_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(at, name)
                    z.write(file, os.path.join("vantage", os.path.relpath(file, _PACKAGE)))
    sc.addPyFile(path)
    sc._vantage_shipped = True


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches of whole texts hold at most `rows` rows, unless the session already sets fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on a local master a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = getattr(spark.sparkContext, "_vantage_shared", None) or tempfile.mkdtemp(prefix="vantage-shared-")
        spark.sparkContext._vantage_shared = found
    return found.rstrip("/")


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until df has no such column."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def settle(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vantage/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._vantage_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by settle() that no later plan reads."""
    path = getattr(df, "_vantage_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
