"""Tables that cut lineage: Parquet in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base(spark: SparkSession) -> str:
    """The shared folder. Only a single-JVM session (``local[...]``) may fall back to a temporary folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="tendril-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df and returns it as read back; the files go when the driver's JVM ends, or with ``drop``."""
    spark = df.sparkSession
    path = f"{base(spark)}/tendril-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _path(spark, path)
    fs.deleteOnExit(at)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def drop(df: DataFrame) -> None:
    """Deletes the files of a table that no later plan reads."""
    fs, at = _path(df.sparkSession, df.scratch_path)
    fs.delete(at, True)


def ranged(df: DataFrame, *keys: str, name: str = "ranged") -> DataFrame:
    """df in ranges of the keys, written, with ``g``: the number of a row's range, ascending with the keys.

    Ranges are cut where a sample of the keys says, so that they hold about as many rows however the keys are spread.
    """
    from pyspark.sql import functions as F

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table(df.repartitionByRange(parts, *keys).withColumn("g", F.spark_partition_id()), name)
