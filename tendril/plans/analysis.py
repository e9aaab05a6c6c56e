"""The maintenance plan of a whole estate as one job: measures, estimates, overrides, decisions, suppression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import maintenance as m

#: The categories that may be asked for.
CATEGORIES = ("index", "compression", "heaps", "statistics", "checkdb")
COLUMNS = ("server", "database", "schema_name", "table_name", "name", "category", "kind", "partition_number", "reason", "intent", "target", "size_mb")

CHECKED = ", ".join(f"{c} {dict(partition_number='int', size_mb='bigint').get(c, 'string')}" for c in COLUMNS)


def _estimated(measures: DataFrame, scoped: DataFrame, savings: DataFrame | None, activity: DataFrame | None, wanted: bool) -> DataFrame:
    """Measures with current_kb, row_kb, page_kb, writes and reads: NULL where no estimate was asked for, made or in scope."""
    own = (*m.ESTATE, "object_id", "index_id")
    keys = [*own, *(["partition_number"] if "partition_number" in measures.columns else [])]
    if not wanted or savings is None:
        return measures.selectExpr("*", *(f"CAST(NULL AS {k}) AS {c}" for c, k in (("current_kb", "double"), ("row_kb", "double"), ("page_kb", "double"), ("writes", "bigint"), ("reads", "bigint"))))
    inside = scoped.select(*own).distinct()

    def per(d: DataFrame, made) -> DataFrame:
        """For whole indexes, and if measures have partitions, for each of them too."""
        whole = made(d, own)
        return whole.withColumn("partition_number", F.lit(None).cast("int")).unionByName(made(d, tuple(keys))) if len(keys) > len(own) else whole

    e = per(savings.join(inside, [*own], "left_semi"), m.compression_estimate)
    able = F.col("compression").isin("NONE", "ROW")
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])
    d = measures.alias("m").join(e, same(measures, e), "left").select("m.*", *(F.when(able, F.col(c)).alias(c) for c in ("current_kb", "row_kb", "page_kb")))
    if activity is None:
        return d.withColumn("writes", F.lit(None).cast("bigint")).withColumn("reads", F.lit(None).cast("bigint"))
    a = per(activity, m.write_activity)
    return d.alias("d").join(a, same(d, a), "left").select("d.*", "writes", "reads")


def analyze(
    inventory: DataFrame, physical: DataFrame, profile: m.Profile, categories: tuple[str, ...] = (), savings: DataFrame | None = None, activity: DataFrame | None = None,
    disabled: DataFrame | None = None, statistics: DataFrame | None = None,
) -> DataFrame:
    """COLUMNS of all decisions about all databases of all servers at once; no categories: all.

    Every input has server and database. savings (object_id, index_id, partition_number, setting, current_kb,
    estimated_kb) and activity (object_id, index_id, partition_number, inserts, updates, deletes, scans, lookups) are
    the measures of compression, disabled (object_id, names) the gate of heaps, statistics (schema_name, table_name,
    name, rows, modifications) theirs; what is not given counts as not measured. Databases are checked by name, or all
    that have objects if none is named. Compression without index measures no pages, so all its indexes are too small.
    """
    if unknown := set(categories) - set(CATEGORIES):
        raise ValueError(f"unknown categories: {sorted(unknown)}")
    chosen = categories or CATEGORIES
    compress = "compression" in chosen and profile.compression
    scoped = m.object_scope(inventory, profile.include, profile.exclude)
    none = lambda c, kind="string": F.lit(None).cast(kind).alias(c)
    parts = []
    if "index" in chosen or compress:
        i = m.match_overrides(m.index_measurements(inventory, physical, compress and profile.per_partition), profile.overrides)
        i = i if "index" in chosen else i.withColumn("page_count", F.lit(0).cast("long"))
        i = m.decide_index(m.decide_compression(_estimated(i, scoped, savings, activity, compress), profile), profile)
        number = F.col("partition_number").cast("int") if "partition_number" in i.columns else none("partition_number", "int")
        parts.append(i.select(*m.ESTATE, "schema_name", "table_name", F.col("index_name").alias("name"), F.lit("index").alias("category"), "kind", number.alias("partition_number"), "reason", "intent", "target", "size_mb"))
    if "heaps" in chosen and profile.heaps:
        h = m.match_overrides(m.heap_measurements(inventory, physical, profile.heap_min_mb, profile.heap_max_mb, disabled), profile.overrides)
        now = inventory.where("type = 0").groupBy(*m.ESTATE, "object_id").agg(F.min_by("compression", "partition_number").alias("compression"))
        h = h.join(now, [*m.ESTATE, "object_id"]).withColumn("index_id", F.lit(0))
        h = m.decide_heap(m.decide_compression(_estimated(h, scoped, savings, activity, compress), profile), profile)
        parts.append(h.select(*m.ESTATE, "schema_name", "table_name", F.lit("heap").alias("name"), F.lit("heap").alias("category"), "kind", none("partition_number", "int"), "reason", none("intent"), "target", F.col("heap_mb").alias("size_mb")))
    if "statistics" in chosen and profile.statistics and statistics is not None:
        s = m.decide_statistics(m.match_overrides(statistics, profile.overrides), profile.statistics_percent, profile.statistics_sample)
        parts.append(s.select(*m.ESTATE, "schema_name", "table_name", "name", F.lit("statistics").alias("category"), "kind", none("partition_number", "int"), "reason", none("intent"), none("target"), none("size_mb", "bigint")))
    decided = m.suppress_redundant(reduce(DataFrame.unionByName, parts)) if parts else None
    if "checkdb" not in chosen or profile.checkdb is None:
        return decided if decided is not None else inventory.sparkSession.createDataFrame([], CHECKED)
    names = [n.strip().lower() for n in profile.checkdb if n.strip()]
    found = inventory.select(*m.ESTATE).distinct()
    found = found.where(F.lower("database").isin(*names)) if names else found
    checks = found.select(
        *m.ESTATE, none("schema_name"), none("table_name"), F.col("database").alias("name"), F.lit("checkdb").alias("category"), F.lit("check_db").alias("kind"), none("partition_number", "int"),
        F.lit("scheduled integrity check").alias("reason"), none("intent"), none("target"), none("size_mb", "bigint"),
    )
    return checks if decided is None else decided.unionByName(checks)
