"""Wait analytics: counter differences, categories, attribution to operations, latency gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import over

#: Categories in order, with the exact wait types and prefixes that belong to them.
CATEGORIES = (
    ("Locking", (), ("LCK_M_",)),
    ("Data I/O", (), ("PAGEIOLATCH_",)),
    ("Transaction log", ("WRITELOG", "LOGBUFFER", "LOG_RATE_GOVERNOR", "POOL_LOG_RATE_GOVERNOR", "INSTANCE_LOG_RATE_GOVERNOR", "HADR_THROTTLE_LOG_RATE_GOVERNOR"), ()),
    ("Parallelism", ("CXPACKET", "CXCONSUMER", "CXSYNC_PORT", "CXSYNC_CONSUMER", "EXCHANGE"), ()),
    ("Memory", ("MEMORY_ALLOCATION_EXT", "RESOURCE_SEMAPHORE", "RESOURCE_SEMAPHORE_QUERY_COMPILE", "CMEMTHREAD"), ()),
    ("CPU & scheduling", ("SOS_SCHEDULER_YIELD", "THREADPOOL"), ()),
    ("Page latch (tempdb)", (), ("PAGELATCH_",)),
    ("Sort & spill I/O", ("IO_COMPLETION", "ASYNC_IO_COMPLETION"), ()),
    ("Availability Group", ("HADR_SYNC_COMMIT", "HADR_GROUP_COMMIT"), ()),
    ("Backup", ("BACKUPIO", "BACKUPBUFFER"), ()),
)


def wait_dictionary(spark: SparkSession) -> DataFrame:
    rows = [(i, n, kind, p) for i, (n, exact, prefix) in enumerate(CATEGORIES) for kind, ps in (("exact", exact), ("prefix", prefix)) for p in ps]
    return spark.createDataFrame(rows, "ord int, category string, kind string, pattern string")


def diff_waits(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("spid",)) -> DataFrame:
    """Per wait type after minus before (missing: 0); types only in before go; max from after; rows with time or tasks above 0."""
    by = [*keys, "wait_type"]
    b = before.select(*by, F.col("wait_time_ms").alias("t0"), F.col("waiting_tasks").alias("n0"))
    d = after.join(b, by, "left").withColumn("wait_time_ms", F.col("wait_time_ms") - F.coalesce("t0", F.lit(0)))
    d = d.withColumn("waiting_tasks", F.col("waiting_tasks") - F.coalesce("n0", F.lit(0)))
    return d.where("wait_time_ms > 0 OR waiting_tasks > 0").select(*by, "wait_time_ms", "waiting_tasks", "max_wait_ms")


def wait_steps(series: DataFrame, keys: tuple[str, ...] = ("spid",)) -> DataFrame:
    """The difference of each snapshot of a counter series to the one before it."""
    w = over([*keys, "wait_type"], "poll_ts")
    step = lambda c: F.col(c) - F.lag(c, 1, 0).over(w)
    d = series.select("poll_ts", *keys, "wait_type", step("wait_time_ms").alias("wait_time_ms"), step("waiting_tasks").alias("waiting_tasks"), "max_wait_ms")
    return d.where("wait_time_ms > 0 OR waiting_tasks > 0")


def classify_waits(waits: DataFrame) -> DataFrame:
    """Adds the first matching category; unmatched rows are noise and go."""
    c = F.col("wait_type")
    category = F.lit(None).cast("string")
    for name, exact, prefixes in reversed(CATEGORIES):
        hit = c.isin(*exact) if exact else F.lit(False)
        for p in prefixes:
            hit = hit | c.startswith(p)
        category = F.when(hit, name).otherwise(category)
    return waits.withColumn("category", category).where("category IS NOT NULL")


def categorize_waits(waits: DataFrame, keys: tuple[str, ...] = ("spid",)) -> DataFrame:
    """Sums by category of classified waits, without empty ones, and the total of each key."""
    s = classify_waits(waits).groupBy(*keys, "category").agg(F.sum("wait_time_ms").alias("wait_time_ms"), F.sum("waiting_tasks").alias("waiting_tasks"))
    s = s.where("wait_time_ms > 0 OR waiting_tasks > 0")
    return s.withColumn("total_ms", F.sum("wait_time_ms").over(W.partitionBy(*keys)))


def as_of(series: DataFrame, bounds: DataFrame, bound: str, keys: tuple[str, ...]) -> DataFrame:
    """Of each operation and counter the last snapshot at or before a bound.

    Snapshots and bounds of a counter are ordered together once; a bound takes the last snapshot before it.
    """
    counters = series.select(*keys, "wait_type").distinct()
    b = bounds.select("op_id", *keys, F.col(bound).alias("poll_ts")).join(counters, list(keys)).withColumn("side", F.lit(1))
    s = series.select(*keys, "wait_type", "poll_ts", F.struct("wait_time_ms", "waiting_tasks", "max_wait_ms").alias("s"), F.lit(0).alias("side"))
    w = over([*keys, "wait_type"], "poll_ts", "side").rowsBetween(W.unboundedPreceding, 0)
    d = s.unionByName(b, allowMissingColumns=True).withColumn("s", F.last("s", ignorenulls=True).over(w)).where("side = 1 AND s IS NOT NULL")
    return d.select("op_id", *keys, "wait_type", "s.*")


def operation_waits(series: DataFrame, operations: DataFrame, keys: tuple[str, ...] = ("spid",)) -> DataFrame:
    """Wait categories of each operation: the snapshots at its end less those at its start."""
    own = ("op_id", *keys)
    d = diff_waits(as_of(series, operations, "start_ts", keys), as_of(series, operations, "end_ts", keys), own)
    return categorize_waits(d, own)


def latency_gate(waits: DataFrame, keys: tuple[str, ...] = ("spid",)) -> DataFrame:
    """Average ms a task of log writes and of exclusive page reads; NULL without tasks."""
    per = lambda hit: F.max(F.when(hit & (F.col("waiting_tasks") > 0), F.col("wait_time_ms") / F.col("waiting_tasks")))
    return waits.groupBy(*keys).agg(per(F.col("wait_type") == "WRITELOG").alias("log_ms"), per(F.col("wait_type").startswith("PAGEIOLATCH_EX")).alias("read_ms"))
