"""Sources and sinks: catalog projections, strict documents, append-only history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import maintenance
from ..operators.maintenance import ESTATE

CONTENDED = "database string, observed array<struct<object_id: bigint, first_seen: timestamp, last_seen: timestamp, times_blocked: int, confirmed_by: string, page_from_end: int>>"
#: The kinds of events that may leave the system.
EVENTS = ("cancel", "fail", "pause", "abort", "run_failure")


def active_sessions(requests: DataFrame, sessions: DataFrame, texts: DataFrame) -> DataFrame:
    """Requests of user sessions that aren't asleep or hold a transaction, with the running statement cut out of its batch."""
    j = requests.join(sessions, "spid").join(texts, "sql_handle", "left").where("is_user AND (status <> 'sleeping' OR open_transactions > 0)")
    size = F.when(F.col("end_offset") == -1, F.length("text")).otherwise((F.col("end_offset") - F.col("start_offset")) / 2 + 1).cast("int")
    return j.withColumn("statement", F.substring("text", (F.col("start_offset") / 2 + 1).cast("int"), size)).orderBy(F.desc("cpu_ms"), "spid")


def object_inventory(objects: DataFrame, indexes: DataFrame, partitions: DataFrame, stats: DataFrame) -> DataFrame:
    """Each partition of each index of a user table, with its compression and size: 8 KB a page."""
    o = objects.where("is_user").select("object_id", "schema_name", "table_name")
    j = o.join(indexes.select("object_id", "index_id", "type", "index_name"), "object_id").join(partitions.select("object_id", "index_id", "partition_number", "part_key", "compression"), ["object_id", "index_id"])
    s = stats.select("part_key", "pages")
    return j.join(s, "part_key").withColumn("size_mb", F.col("pages") * 8 / 1024).drop("pages")


def structure_sizes(indexes: DataFrame, stats: DataFrame, partition: int | None = None, estate: tuple[str, ...] = ESTATE) -> DataFrame:
    """KB of each structure; those without pages stay, with 0."""
    s = stats.where(F.col("partition_number") == partition) if partition is not None else stats
    j = indexes.where("NOT is_hypothetical").join(s, [*estate, "object_id", "index_id"], "left")
    return j.groupBy(*estate, "object_id", "index_id", "name").agg((F.coalesce(F.sum("pages"), F.lit(0)) * 8).alias("kb"))


def file_space(files: DataFrame) -> DataFrame:
    size, used = F.floor(F.col("size_pages") / 128), F.ceil(F.col("used_pages") / 128)
    return files.withColumn("size_mb", size).withColumn("used_mb", used).withColumn("free_mb", F.col("size_mb") - F.col("used_mb"))


def file_growth(files: DataFrame) -> DataFrame:
    """Next growth and headroom in MB; headroom is NULL where unlimited, 0 where growth is off."""
    step = F.when(F.col("growth") == 0, 0).when(F.col("is_percent"), F.floor(F.col("size_mb") * F.col("growth") / 100)).otherwise(F.floor(F.col("growth") / 128)).cast("long")
    room = F.when(F.col("growth") == 0, 0).when(F.col("max_mb") == -1, None).otherwise(F.greatest(F.lit(0), F.col("max_mb") - F.col("size_mb"))).cast("long")
    return files.withColumn("next_mb", step).withColumn("headroom_mb", room).withColumn("growth_off", F.col("growth") == 0)


def disabled_indexes(indexes: DataFrame, estate: tuple[str, ...] = ESTATE) -> DataFrame:
    own = F.array_sort(F.collect_list(F.struct("index_id", "name")))
    return indexes.where("is_disabled AND name IS NOT NULL").groupBy(*estate, "object_id").agg(F.transform(own, lambda x: x["name"]).alias("names"))


def rebuildable_indexes(indexes: DataFrame, estate: tuple[str, ...] = ESTATE) -> DataFrame:
    return indexes.where("type <> 0 AND NOT is_disabled AND name IS NOT NULL").withColumn("ord", F.row_number().over(W.partitionBy(*estate, "object_id").orderBy(F.col("type") != 1, "index_id")))


def database_eligibility(databases: DataFrame, replicas: DataFrame, mirroring: DataFrame) -> DataFrame:
    """The first condition that fails, or ''."""
    d = databases.where("database_id > 4").join(replicas, "database_id", "left").join(mirroring, "database_id", "left")
    why = F.when(F.col("state") != "ONLINE", "not online").when(F.col("is_read_only"), "read only").when(F.col("replica_role") == "SECONDARY", "secondary replica").when(F.col("mirroring_role") == "MIRROR", "mirror").otherwise("")
    return d.select("database_id", "name", why.alias("reason"))


def resolve_databases(databases: DataFrame, explicit: DataFrame | None = None, connected: DataFrame | None = None, include: tuple[str, ...] = ("*",), exclude: tuple[str, ...] = ()) -> DataFrame:
    """(server, ord, name, skipped): what to work on, in order; skipped is NULL for the selected, or the reason why not.

    databases (server, database_id, name, reason), reason '' is eligible. An explicit list (server, ord, name) is met by name
    without blanks and case; blank entries are no entries, unknown names are skipped. Without a list, connected
    (server, name) is all that is selected; without either, all databases in scope are, the others silently left out.
    """
    if explicit is not None:
        asked = explicit.select("server", "ord", F.trim("name").alias("asked")).where("asked <> ''").withColumn("_n", F.lower("asked"))
        known = databases.select("server", F.lower("name").alias("_n"), "name", "reason")
        d = asked.join(known, ["server", "_n"], "left")
        why = F.when(F.col("reason").isNull(), "not found on server").when(F.col("reason") != "", F.col("reason"))
        return d.select("server", "ord", F.coalesce("name", "asked").alias("name"), why.alias("skipped"))
    if connected is not None:
        return connected.select("server", F.lit(1).cast("long").alias("ord"), "name", F.lit(None).cast("string").alias("skipped"))
    d = maintenance.database_scope(databases, include, exclude)
    return d.select("server", F.col("database_id").cast("long").alias("ord"), "name", F.nullif("reason", F.lit("")).alias("skipped"))


def uncompressed_objects(inventory: DataFrame, key_columns: DataFrame, like: str = "%", estate: tuple[str, ...] = ESTATE) -> DataFrame:
    """Uncompressed partitions with their key columns in order, largest first."""
    own = [*estate, "object_id", "index_id"]
    k = key_columns.groupBy(*own).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column"))), lambda x: x["column"]), ", ").alias("keys"))
    return inventory.where(F.col("table_name").like(like) & (F.col("compression") == "NONE")).join(k, own, "left").orderBy(F.desc("size_mb"), *own, "partition_number")


def tail_object(pages: DataFrame, files: DataFrame, max_back: int, estate: tuple[str, ...] = ESTATE) -> DataFrame:
    """Per file (server, database, file_id, size_pages) the page nearest the end that an object owns, if within max_back pages of the end.

    pages (server, database, file_id, page, object_id) are allocated ones; the file ends with its last page, allocated or not.
    """
    f = files.select(*estate, "file_id", (F.col("size_pages") - 1).alias("last"))
    p = pages.where("object_id IS NOT NULL").join(f, [*estate, "file_id"]).where(F.col("page") >= F.col("last") - max_back)
    top = F.max_by(F.struct("object_id", "page", (F.col("last") - F.col("page")).alias("from_end")), "page")
    return p.groupBy(*estate, "file_id").agg(top.alias("t")).select(*estate, "file_id", "t.*")


def contended_source(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Observed objects of documents, one a file, or with ``lines`` one a line; a field of another type fails the read."""
    d = spark.read.schema(CONTENDED).option("mode", "FAILFAST").option("multiLine", not lines).json(path)
    return d.select("database", F.explode("observed").alias("o")).select("database", "o.*").withColumn("confirmed_by", F.coalesce(F.nullif("confirmed_by", F.lit("")), F.lit("lock")))


def run_history_sink(runs: DataFrame, path: str) -> None:
    """Appends runs, a folder a month; each month's rows are brought together first, so that they make few files."""
    d = runs.withColumn("run_month", F.date_format("started_at", "yyyy-MM"))
    d.repartitionByRange("run_month").write.mode("append").partitionBy("run_month").parquet(path)


def run_history_source(spark: SparkSession, path: str) -> DataFrame:
    """All runs; columns that were added later are NULL in older ones."""
    return spark.read.option("mergeSchema", True).parquet(path)


def plan_history_sink(plan: DataFrame, decisions: DataFrame, path: str) -> None:
    """Children first; the parent row is the commit mark."""
    decisions.write.mode("append").partitionBy("plan_id").parquet(f"{path}/decisions")
    plan.write.mode("append").parquet(f"{path}/plans")


def plan_history_source(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/decisions").join(spark.read.parquet(f"{path}/plans").select("plan_id"), "plan_id", "left_semi")


def run_report_sink(reports: DataFrame, path: str) -> None:
    reports.write.mode("append").option("ignoreNullFields", True).json(path)


def event_feed(events: DataFrame, enabled: tuple[str, ...] = EVENTS) -> DataFrame:
    """Configured kinds only, as JSON."""
    return events.where(F.col("event").isin(*enabled)).select(F.to_json(F.struct("event", "payload")).alias("json"))
