"""Maintenance analysis: measures of indexes and heaps, decisions with reasons, scope, suppression."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import glob, truncated


@dataclass(frozen=True)
class Profile:
    """Rules of a plan. overrides: (glob on schema.table, action: skip or no_rebuild or NONE, ROW, PAGE), the first match counts.

    over_ceiling: what becomes of a rebuild of more than max_rebuild_mb (0: no ceiling): reorganize or skip. include and
    exclude are the scope of compression. statistics_percent None: the square-root rule. checkdb: databases that are
    checked, none named: the one of the plan; None: no check.
    """

    min_pages: int = 1000
    reorganize_at: float = 5.0
    rebuild_at: float = 30.0
    max_rebuild_mb: int = 0
    over_ceiling: str = "reorganize"
    compression: bool = True
    per_partition: bool = False
    page_over_row_pct: float = 10.0
    least_saving_pct: float = 10.0
    write_ratio: float = 0.3
    write_floor: int = 100
    write_cap: str = "ROW"
    heaps: bool = True
    heap_min_mb: int = 0
    heap_max_mb: int = 0
    heap_rewrite_max_mb: int = 0
    heap_forwarded_pct: float = 10.0
    heap_fragmentation: float = 30.0
    heap_free_pct: float = 30.0
    statistics: bool = True
    statistics_percent: float | None = None
    statistics_sample: int = 0
    checkdb: tuple[str, ...] | None = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    overrides: tuple[tuple[str, str], ...] = field(default_factory=tuple)


def _any_glob(globs: tuple[str, ...], *names: Column) -> Column:
    return reduce(lambda a, b: a | b, [n.rlike(glob(g)) for g in globs for n in names], F.lit(False))


def object_scope(objects: DataFrame, include: tuple[str, ...], exclude: tuple[str, ...]) -> DataFrame:
    """Objects that an include glob names (none: all) and no exclude glob, as schema.table or schema.table.index."""
    t = F.concat_ws(".", "schema_name", "table_name")
    i = F.concat_ws(".", "schema_name", "table_name", "index_name")
    kept = objects.where(_any_glob(include, t, i)) if include else objects
    return kept.where(~_any_glob(exclude, t, i))


def database_scope(databases: DataFrame, include: tuple[str, ...] = ("*",), exclude: tuple[str, ...] = ()) -> DataFrame:
    n = F.col("name")
    return databases.where(_any_glob(include or ("*",), n) & ~_any_glob(exclude, n))


def match_overrides(objects: DataFrame, overrides: tuple[tuple[str, str], ...]) -> DataFrame:
    """Adds ``override``: the action of the first glob that matches schema.table."""
    name = F.concat_ws(".", "schema_name", "table_name")
    action = reduce(lambda acc, o: F.when(name.rlike(glob(o[0])), o[1]).otherwise(acc), reversed(overrides), F.lit(None).cast("string"))
    return objects.withColumn("override", action)


#: Ids of objects, and their names, are unique in one database of one server only.
ESTATE = ("server", "database")


def index_measurements(inventory: DataFrame, physical: DataFrame, per_partition: bool = False, estate: tuple[str, ...] = ESTATE) -> DataFrame:
    """Rowstore indexes: sums of whole MB and pages, worst fragmentation, the first partition's compression. Unmeasured: NULL.

    per_partition: a row for each partition of an index that has several, with its number; others have none.
    """
    j = inventory.where("type IN (1, 2)").join(physical, [*estate, "part_key", "partition_number"], "left")
    keys = [*estate, "object_id", "schema_name", "table_name", "index_id", "index_name", "part_key"]
    if per_partition:
        several = F.count("*").over(W.partitionBy(*keys)) > 1
        j = j.withColumn("partition", F.when(several, F.col("partition_number")))
    first = F.min_by("compression", "partition_number")
    g = j.groupBy(*keys, *(["partition"] if per_partition else []))
    m = g.agg(F.sum(truncated(F.col("size_mb"))).alias("size_mb"), F.sum("page_count").alias("page_count"), F.max("fragmentation").alias("fragmentation"), first.alias("compression"))
    return m.withColumnRenamed("partition", "partition_number")


def heap_measurements(inventory: DataFrame, physical: DataFrame, min_mb: int = 0, max_mb: int = 0, disabled: DataFrame | None = None, estate: tuple[str, ...] = ESTATE) -> DataFrame:
    """Heaps within the size gate: MB, other indexes and what a rewrite touches, forwarded and all records, density (worst, from 100).

    disabled: (server, database, object_id, names) of disabled indexes, as ``disabled_indexes`` of the catalog gives them.
    """
    mb = truncated(F.col("size_mb"))
    heap = F.col("type") == 0
    own = [*estate, "object_id"]
    g = inventory.groupBy(*own, "schema_name", "table_name").agg(
        F.sum(F.when(heap, mb)).alias("heap_mb"), F.coalesce(F.sum(F.when(~heap, mb)), F.lit(0)).alias("index_mb"), F.countDistinct(F.when(~heap, F.col("index_id"))).alias("indexes")
    )
    g = g.where("heap_mb IS NOT NULL").where(F.col("heap_mb") >= min_mb)
    g = g.where(F.col("heap_mb") <= max_mb) if max_mb else g
    p = inventory.where(heap).join(physical, [*estate, "part_key", "partition_number"]).groupBy(*own).agg(
        F.sum("forwarded_count").alias("forwarded"), F.sum("record_count").alias("records"), F.max("fragmentation").alias("fragmentation"), F.least(F.min("density"), F.lit(100.0)).alias("density")
    )
    h = g.join(p, own, "left").withColumn("rewrite_mb", F.col("heap_mb") + F.col("index_mb"))
    return h if disabled is None else h.join(disabled.select(*own, F.col("names").alias("disabled")), own, "left")


def compression_estimate(savings: DataFrame, keys: tuple[str, ...] = (*ESTATE, "object_id", "index_id")) -> DataFrame:
    """Of (server, database, object_id, index_id, setting, current_kb, estimated_kb): sums for ROW and PAGE; missing either, no row.

    If savings have a ``type`` and a ``compression``, only rowstore objects that are not compressed, or by ROW, qualify.
    """
    if {"type", "compression"} <= set(savings.columns):
        savings = savings.where("type IN (0, 1, 2) AND compression IN ('NONE', 'ROW')")
    s = lambda c, k: F.sum(F.when(F.col("setting") == k, F.col(c)))
    g = savings.groupBy(*keys).agg(s("current_kb", "ROW").alias("current_kb"), s("estimated_kb", "ROW").alias("row_kb"), s("estimated_kb", "PAGE").alias("page_kb"))
    return g.where("row_kb IS NOT NULL AND page_kb IS NOT NULL")


def write_activity(stats: DataFrame, keys: tuple[str, ...] = (*ESTATE, "object_id", "index_id")) -> DataFrame:
    g = stats.groupBy(*keys).agg(F.sum(F.col("inserts") + F.col("updates") + F.col("deletes")).alias("writes"), F.sum(F.col("scans") + F.col("lookups")).alias("reads"))
    return g.withColumn("write_ratio", F.when(F.col("writes") + F.col("reads") > 0, F.col("writes") / (F.col("writes") + F.col("reads"))).otherwise(0.0))


def _tier(c: Column) -> Column:
    return F.when(c == "PAGE", 2).when(c == "ROW", 1).otherwise(0)


def decide_compression(m: DataFrame, p: Profile) -> DataFrame:
    """Of measures with estimates (current_kb, row_kb, page_kb), writes, reads and override: the chosen tier, NULL for no change, and why."""
    cur, row, page = F.col("current_kb"), F.col("row_kb"), F.col("page_kb")
    saves = lambda k: (cur > 0) & (100 * (cur - k) / cur >= p.least_saving_pct)
    beats = (row > 0) & (100 * (row - page) / row >= p.page_over_row_pct)
    pin = F.col("override").isin("NONE", "ROW", "PAGE")
    best = F.when(beats & saves(page), "PAGE").when(saves(row), "ROW").otherwise("NONE")
    total = F.col("writes") + F.col("reads")
    heavy = (total >= p.write_floor) & (total > 0) & (F.col("writes") / F.nullif(total, F.lit(0)) >= p.write_ratio)
    capped = F.when(heavy & (_tier(best) > _tier(F.lit(p.write_cap))), p.write_cap).otherwise(best)
    heavy = F.coalesce(heavy, F.lit(False))
    want = F.when(pin, F.col("override")).when(cur.isNull(), None).when(capped == "NONE", None).otherwise(capped)
    why = F.when(pin, "pinned").when(cur.isNull(), "no estimate").when(want.isNull(), "saves too little").when(want == F.col("compression"), "already there").when(heavy & (capped != best), "capped by writes").otherwise("saves enough")
    return m.withColumn("target", F.when(want != F.col("compression"), want)).withColumn("compression_reason", why)


def decide_index(m: DataFrame, p: Profile) -> DataFrame:
    """kind (skip, reorganize, rebuild), intent and reason of measured indexes with override and target.

    A rebuild is wanted for fragmentation or a target; where both ask for it, its intent is fragmentation. Where it is
    not allowed, or over the ceiling, a reorganization takes its place if fragmentation asks for one (not if
    over_ceiling is skip), and the target goes.
    """
    skip, frag = F.col("override") == "skip", F.col("fragmentation")
    big = F.col("size_mb") > p.max_rebuild_mb if p.max_rebuild_mb else F.lit(False)
    forbidden = F.coalesce(F.col("override") == "no_rebuild", F.lit(False))
    none = big & ~forbidden if p.over_ceiling == "skip" else F.lit(False)
    want, low = (frag >= p.rebuild_at) | F.col("target").isNotNull(), frag >= p.reorganize_at
    kind = F.when(skip | frag.isNull() | (F.col("page_count") < p.min_pages), "skip").when(want & ~forbidden & ~big, "rebuild").when(want & none, "skip").when(low, "reorganize").otherwise("skip")
    reason = (
        F.when(skip, "override").when(frag.isNull(), "not measured").when(F.col("page_count") < p.min_pages, "too small").when(want & (forbidden | big), "rebuild not allowed")
        .when(frag >= p.rebuild_at, "fragmented").when(want, "compression").when(low, "slightly fragmented").otherwise("healthy")
    )
    d = m.withColumn("kind", kind).withColumn("reason", reason)
    intent = F.when(F.col("kind") == "reorganize", "fragmentation").when(F.col("kind") == "rebuild", F.when(frag >= p.rebuild_at, "fragmentation").otherwise("compression"))
    return d.withColumn("intent", intent).withColumn("target", F.when(F.col("kind") == "rebuild", F.col("target")))


def decide_heap(m: DataFrame, p: Profile) -> DataFrame:
    """Rebuild a heap at any threshold, unless a gate holds it; a rebuild takes the target with it, if there is one."""
    fwd = 100 * F.col("forwarded") / F.nullif("records", F.lit(0))
    gate = F.when(~F.lit(p.heaps), "disabled").when(F.col("override") == "skip", "override").when(F.col("override") == "no_rebuild", "rebuild not allowed").when(F.col("heap_mb") < p.heap_min_mb, "too small")
    if p.heap_rewrite_max_mb:
        gate = gate.when(F.col("rewrite_mb") > p.heap_rewrite_max_mb, "rewrite too large")
    if "disabled" in m.columns:
        gate = gate.when(F.size("disabled") > 0, F.concat(F.lit("would re-enable "), F.array_join("disabled", ", ")))
    gate = gate.when(F.col("records").isNull(), "not measured")
    hit = F.when(fwd >= p.heap_forwarded_pct, "forwarded records").when(F.col("fragmentation") >= p.heap_fragmentation, "fragmented").when(100 - F.col("density") >= p.heap_free_pct, "free space")
    d = m.withColumn("kind", F.when(gate.isNull() & hit.isNotNull(), "rebuild_heap").otherwise("skip"))
    d = d.withColumn("reason", F.coalesce(gate, hit, F.lit("healthy")))
    return d.withColumn("target", F.when(F.col("kind") == "rebuild_heap", F.col("target"))) if "target" in m.columns else d


def decide_statistics(stats: DataFrame, percent: float | None = None, sample: int = 0) -> DataFrame:
    """Update where modifications reach the square root of 1,000 times the rows, or ``percent`` of the rows where set.

    Statistics of tables with the override skip are left alone, if stats have overrides.
    """
    limit = F.sqrt(1000 * F.col("rows")) if percent is None else F.col("rows") * percent / 100
    skip = F.coalesce(F.col("override") == "skip", F.lit(False)) if "override" in stats.columns else F.lit(False)
    due = F.col("modifications") >= limit
    d = stats.withColumn("kind", F.when(~skip & due, "update_statistics").otherwise("skip"))
    d = d.withColumn("reason", F.when(skip, "override").when(due, "modified").otherwise("few modifications"))
    return d.withColumn("scan", F.lit(f"sample {sample}" if sample else "fullscan"))


def suppress_redundant(decisions: DataFrame, estate: tuple[str, ...] = ESTATE) -> DataFrame:
    """Of (server, database, schema_name, table_name, name, category, kind, partition_number, reason): index work goes where the heap is rebuilt,
    statistics where it is or the index of that name is rebuilt whole; the rows stay, as skips with the reason, without intent and target.

    Decisions of a table are brought together once; each carries what the others of its table say.
    """
    d = decisions.withColumn("_t", F.lower(F.concat_ws(".", "schema_name", "table_name"))).withColumn("_n", F.lower("name"))
    d = d.withColumn("_heap", F.max(F.col("kind") == "rebuild_heap").over(W.partitionBy(*estate, "_t")))
    d = d.withColumn("_whole", F.max((F.col("kind") == "rebuild") & F.col("partition_number").isNull()).over(W.partitionBy(*estate, "_t", "_n")))
    gone = F.when(F.col("category").isin("index", "statistics") & F.col("_heap"), "heap rebuilt").when((F.col("category") == "statistics") & F.col("_whole"), "index rebuilt")
    d = d.withColumn("_gone", F.when(F.col("kind") != "skip", gone))
    for c in {"intent", "target"} & set(d.columns):
        d = d.withColumn(c, F.when(F.col("_gone").isNull(), F.col(c)))
    return d.withColumn("reason", F.coalesce("_gone", "reason")).withColumn("kind", F.when(F.col("_gone").isNotNull(), "skip").otherwise(F.col("kind"))).select(*decisions.columns)


def pre_shrink_measures(inventory: DataFrame, physical: DataFrame, estate: tuple[str, ...] = ESTATE) -> DataFrame:
    """Per object and index: pages, and the worst density of partitions that have pages (100: all are empty)."""
    j = inventory.join(physical, [*estate, "part_key", "partition_number"], "left")
    low = F.coalesce(F.min(F.when(F.col("page_count") > 0, F.col("density"))), F.lit(100.0))
    return j.groupBy(*estate, "object_id", "index_id", "type").agg(F.coalesce(F.sum("page_count"), F.lit(0)).alias("page_count"), low.alias("density"), F.sum(truncated(F.col("size_mb"))).alias("size_mb"))


def pre_shrink_plan(measures: DataFrame, confirmed: DataFrame, min_pages: int, low_density: float, keys: tuple[str, ...] = ESTATE) -> DataFrame:
    """Candidates of a database, confirmed ones first: by tail position before by lock, nearest the end, most blocked. ``ord`` is the place."""
    c = confirmed.where("confirmed_by <> 'transient'").select(*keys, "object_id", F.col("confirmed_by"), "times_blocked", "page_from_end")
    d = measures.where("type <> 0").join(c, [*keys, "object_id"], "left").where((F.col("page_count") >= min_pages) & ((F.col("density") < low_density) | F.col("confirmed_by").isNotNull()))
    order = W.partitionBy(*keys).orderBy(F.col("confirmed_by").isNull(), F.coalesce(F.col("confirmed_by") != "tail", F.lit(True)), F.asc_nulls_last("page_from_end"), F.desc_nulls_last("times_blocked"), "object_id", "index_id")
    return d.withColumn("ord", F.row_number().over(order))


def expand_all(operations: DataFrame, indexes: DataFrame, estate: tuple[str, ...] = ESTATE, manifest: tuple[str, ...] = ()) -> DataFrame:
    """index = ALL becomes one row per index, clustered first; the rest stays; compression goes for anything but rowstore.

    An operation is one op_index of a database, and of a manifest if its columns are named.
    """
    own = [*estate, "object_id"]
    i = indexes.select(*(F.col(k).alias(f"_{k}") for k in own), F.col("index_name").alias("_i"), F.col("type").alias("_type"), F.col("index_id").alias("_id")).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in own])
    every = operations.join(i, (F.col("index") == "ALL") & same, "left")
    place = F.row_number().over(W.partitionBy(*estate, *manifest, "op_index").orderBy(F.col("_type") != 1, "_id"))
    every = every.withColumn("place", place).withColumn("index", F.coalesce("_i", "index")).withColumn("compression", F.when(~F.coalesce("_type", F.lit(1)).isin(0, 1, 2), None).otherwise(F.col("compression")))
    return every.drop(*(f"_{k}" for k in own), "_i", "_type", "_id")


def compression_satisfied(ops: DataFrame, inventory: DataFrame, estate: tuple[str, ...] = ESTATE) -> DataFrame:
    """A compression rebuild is satisfied if there are partitions and all have the target."""
    same, own = F.bool_and(F.col("compression") == F.col("target")), [*estate, "object_id", "index_id"]
    return ops.join(inventory.select(*own, "compression"), own, "left").groupBy(*own, "target").agg(F.coalesce(same, F.lit(False)).alias("satisfied"))


def stranded_resumables(resumables: DataFrame, queued: DataFrame, estate: tuple[str, ...] = ESTATE) -> DataFrame:
    """Paused builds, and whether a queued operation of their database names the same index."""
    q = queued.select(*estate, F.lower("table_name").alias("_t"), F.lower("index_name").alias("_i")).distinct().withColumn("_q", F.lit(True))
    d = resumables.where("state = 'PAUSED'").withColumn("_t", F.lower("table_name")).withColumn("_i", F.lower("index_name"))
    return d.join(q, [*estate, "_t", "_i"], "left").withColumn("covered", F.coalesce("_q", F.lit(False))).drop("_t", "_i", "_q")


def same_statement(pairs: DataFrame) -> DataFrame:
    """Of (stored, planned): equal after white space is collapsed and one semicolon dropped; blank never is."""
    norm = lambda c: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), ";$", ""), r"\s+$", "")
    return pairs.withColumn("same", (norm("stored") == norm("planned")) & (norm("stored") != ""))


def trend_report(history: DataFrame, days: int = 30, often: int = 3, estate: tuple[str, ...] = ESTATE) -> DataFrame:
    """Of recorded decisions (server, database, plan_id, generated_at, target, decision, fragmentation, current_compression, chosen_compression): each with what came before.

    rebuilds: of the target in the ``days`` up to it, itself included; oscillates: it is a rebuild, and they are
    ``often`` at least; held: the compression that was chosen last is the current one (NULL: none was chosen before);
    slope: points of fragmentation a day since the measurement before (NULL without one, or on the same second).
    """
    of = [*estate, "target"]
    w = W.partitionBy(*of).orderBy(F.unix_timestamp("generated_at"))
    before = W.partitionBy(*of).orderBy("generated_at", "plan_id").rowsBetween(W.unboundedPreceding, -1)
    rebuild = F.col("decision").isin("rebuild", "rebuild_heap")
    d = history.withColumn("rebuilds", F.count_if(rebuild).over(w.rangeBetween(-days * 86400, 0)))
    d = d.withColumn("oscillates", rebuild & (F.col("rebuilds") >= often))
    d = d.withColumn("held", F.last("chosen_compression", ignorenulls=True).over(before) == F.col("current_compression"))
    last = F.last(F.when(F.col("fragmentation").isNotNull(), F.struct("generated_at", "fragmentation")), ignorenulls=True).over(before)
    d = d.withColumn("_last", last).withColumn("_s", F.unix_timestamp("generated_at") - F.unix_timestamp("_last.generated_at"))
    return d.withColumn("slope", F.when(F.col("_s") > 0, (F.col("fragmentation") - F.col("_last.fragmentation")) * 86400 / F.col("_s"))).drop("_last", "_s")


def trend_summary(history: DataFrame, days: int = 30, often: int = 3, estate: tuple[str, ...] = ESTATE) -> DataFrame:
    """Per target: records, rebuilds, the most of them in ``days``, compressions that did not hold, and the trend of fragmentation in points a day."""
    t = trend_report(history, days, often, estate)
    day = F.unix_timestamp("generated_at") / 86400
    sums = [F.count("*").alias("records"), F.count_if(F.col("decision").isin("rebuild", "rebuild_heap")).alias("total_rebuilds"), F.max("rebuilds").alias("most_rebuilds"), F.bool_or("oscillates").alias("oscillates"), F.count_if(~F.col("held")).alias("lost")]
    return t.groupBy(*estate, "target").agg(*sums, F.regr_slope("fragmentation", day).alias("trend"))
