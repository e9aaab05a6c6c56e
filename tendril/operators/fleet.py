"""Compatibility rules and option resolution for many servers, and preflight checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVERGREEN, EVERGREEN_MAJOR = "azure", 9999
#: Options that are on where they apply, commands that build anew and that need elevated rights, minutes that a shrink may block.
SAFETY = ("online", "resumable", "wait_at_low_priority")
HEAVY = ("rebuild_index", "rebuild_heap", "create_index", "alter_column", "add_constraint")
ELEVATED, SHRINK_BLOCK_MINUTES = ("check_db", "shrink", "shrink_log", "shrink_tempdb"), 2
#: Release years of major versions.
YEARS = {9: 2005, 10: 2008, 11: 2012, 12: 2014, 13: 2016, 14: 2017, 15: 2019, 16: 2022, 17: 2025}


#: A document of compatibility rules: a command's options, from which version, in which editions, with which other options.
RULES = "command string, options map<string, struct<min_major: int, editions: array<string>, requires: array<string>>>"


def compat_rules(documents: DataFrame) -> DataFrame:
    """Of documents (command, options): (command, option, min_major, editions, requires), a row per command and option; requires may be empty."""
    d = documents.select("command", F.explode("options").alias("option", "r"))
    return d.select("command", "option", "r.min_major", "r.editions", F.coalesce("r.requires", F.array().cast("array<string>")).alias("requires"))


def compat_source(spark: SparkSession, path: str) -> DataFrame:
    """Rules of JSON documents, one a line; a field of another type fails the read."""
    return compat_rules(spark.read.schema(RULES).option("mode", "FAILFAST").json(path))


def applicable_options(servers: DataFrame, rules: DataFrame) -> DataFrame:
    """Options that a server's version and tier allow; an evergreen tier has every version, an unknown one nothing."""
    major = F.when(F.col("tier") == EVERGREEN, EVERGREEN_MAJOR).otherwise(F.col("major"))
    s = servers.withColumn("_major", major)
    return s.join(rules, (F.col("_major") >= F.col("min_major")) & F.array_contains("editions", F.col("tier"))).select("server", "command", "option", "requires")


def resolve_options(operations: DataFrame, servers: DataFrame, rules: DataFrame) -> DataFrame:
    """Of operations (server, op_index, command, index, partition, rowstore, overrides map<string,boolean>) on servers (with policy map):
    a row per option with value and reason. Override, then policy, then safety on where applicable and tuning off."""
    ok = applicable_options(servers, rules).withColumn("applicable", F.lit(True)).drop("requires")
    every = operations.join(rules.select("command", "option"), "command").join(servers.select("server", "policy", "database"), "server")
    d = every.join(ok, ["server", "command", "option"], "left").withColumn("applicable", F.coalesce("applicable", F.lit(False)))
    asked = F.coalesce(F.try_element_at("overrides", F.col("option")), F.try_element_at("policy", F.col("option")))
    d = d.withColumn("asked", asked)
    value = F.when(~F.col("applicable"), False).when(F.col("asked").isNotNull(), F.col("asked")).otherwise(F.col("option").isin(*SAFETY) | (F.col("option") == "maxdop"))
    why = F.when(~F.col("applicable") & F.coalesce("asked", F.lit(False)), "asked for but not supported").when(~F.col("applicable"), "not supported").when(F.col("asked").isNotNull(), "asked for").otherwise("automatic")
    drop = (F.col("option") == "resumable") & ((F.col("index") == "ALL") | (F.col("database") == "tempdb") | F.col("partition").isNotNull())
    family = ~F.col("rowstore") & F.col("option").isin(*SAFETY)
    d = d.withColumn("value", value & ~drop & ~family).withColumn("reason", F.when(value & drop, "not resumable here").when(value & family, "rowstore only").otherwise(why))
    w = W.partitionBy("server", "op_index")
    on = lambda o, c: F.coalesce(F.max(F.when(F.col("option") == o, F.col(c))).over(w), F.lit(False))
    d = d.withColumn("online_on", on("online", "value")).withColumn("online_off", ~on("online", "applicable") | ~F.coalesce(F.max(F.when(F.col("option") == "online", F.coalesce("asked", F.lit(True)))).over(w), F.lit(False)) | ~F.col("rowstore"))
    d = d.withColumn("needs", F.col("option").isin("resumable", "wait_at_low_priority") & F.col("value") & F.col("online_off"))
    d = d.withColumn("reason", F.when(F.col("needs"), "needs online").otherwise(F.col("reason"))).withColumn("value", F.col("value") & ~F.col("needs"))
    resumed = F.coalesce(F.max(F.when(F.col("option") == "resumable", F.col("value"))).over(w), F.lit(False))
    lose = (F.col("option") == "sort_in_tempdb") & F.col("value") & resumed
    return d.withColumn("lose", lose).select("server", "op_index", "command", "option", (F.col("value") & ~F.col("lose")).alias("value"), F.when(F.col("lose"), "resumable wins").otherwise(F.col("reason")).alias("reason"))


def resolve_special_options(operations: DataFrame, servers: DataFrame, rules: DataFrame) -> DataFrame:
    """Of operations (server, op_index, command, low_priority, max_block_minutes, maxdop, ignore_blocking) on servers (tier, major,
    low_priority, abort_blockers, maxdop): (server, op_index, command, option, value, reason) of shrinks and bulk changes.

    A shrink takes the low-priority wait alone, on where it applies unless asked otherwise; its end never stops others
    on tempdb, and elsewhere only if the server's policy says so. It yields after SHRINK_BLOCK_MINUTES if nothing else
    is asked for; 0 or less opts out. A bulk change takes maxdop where it applies, and what its reactions were asked.
    """
    ok = applicable_options(servers, rules).select("server", "command", F.col("option").alias("able")).where("able IN ('wait_at_low_priority', 'maxdop')")
    able = ok.groupBy("server", "command").agg(F.collect_set("able").alias("able"))
    policy = servers.select("server", F.col("low_priority").alias("p_low"), F.col("abort_blockers").alias("p_abort"), F.col("maxdop").alias("p_maxdop"))
    d = operations.join(policy, "server").join(able, ["server", "command"], "left").withColumn("able", F.coalesce("able", F.array().cast("array<string>")))
    has = lambda o: F.array_contains("able", o)
    shrink, bulk = F.col("command").startswith("shrink"), F.col("command").startswith("batch_")
    asked = F.coalesce("low_priority", "p_low")
    low = has("wait_at_low_priority") & F.coalesce(asked, F.lit(True))
    why = F.when(~has("wait_at_low_priority"), "asked for but not supported").when(asked.isNotNull(), "asked for").otherwise("automatic")
    minutes = F.greatest(F.coalesce("max_block_minutes", F.lit(SHRINK_BLOCK_MINUTES)), F.lit(0))
    cap = F.when(F.col("max_block_minutes").isNull(), "default").when(minutes > 0, "asked for").otherwise("no cap")
    dop = F.coalesce("maxdop", "p_maxdop")
    row = lambda when, o, v, w: F.when(when, F.struct(F.lit(o).alias("option"), v.cast("string").alias("value"), w.alias("reason")))
    rows = F.array_compact(
        F.array(
            row(shrink & (has("wait_at_low_priority") | F.coalesce(asked, F.lit(False))), "wait_at_low_priority", F.when(low, "ON").otherwise("OFF"), why),
            row(shrink & low, "abort_after_wait", F.when(F.col("p_abort") & (F.col("command") != "shrink_tempdb"), "BLOCKERS").otherwise("SELF"), F.lit("policy")),
            row(shrink, "max_block_minutes", minutes, cap),
            row(bulk & has("maxdop") & dop.isNotNull(), "maxdop", dop, F.lit("asked for")),
            row(bulk & F.coalesce("ignore_blocking", F.lit(False)), "ignore_blocking", F.lit("ON"), F.lit("asked for")),
            row(bulk & (F.col("max_block_minutes") > 0), "max_block_minutes", F.col("max_block_minutes"), F.lit("asked for")),
        )
    )
    return d.select("server", "op_index", "command", F.explode(rows).alias("r")).select("server", "op_index", "command", "r.*")


def version_years(servers: DataFrame) -> DataFrame:
    years = F.create_map(*(F.lit(x) for pair in YEARS.items() for x in pair))
    return servers.withColumn("year", F.try_element_at(years, "major"))


def rollback_on_cancel(planned: DataFrame) -> DataFrame:
    """Per manifest: heavy builders that a cancel rolls back, and all operations."""
    heavy = F.col("command").isin(*HEAVY) & ~F.col("resumable")
    return planned.groupBy("manifest").agg(F.count_if(heavy).alias("at_risk"), F.count("*").alias("operations"))


def advisories(planned: DataFrame, databases: DataFrame) -> DataFrame:
    d = planned.where("command = 'reorganize_index'").join(databases, "database")
    text = F.concat_ws("; ", F.when(~F.col("snapshot_reads"), "readers may block: snapshot reads are off"), F.when(F.col("async_statistics"), "statistics update in the background"))
    return d.withColumn("advice", text).where("advice <> ''")


# Preflight: each check is (server, name, severity, detail).


def check_server(servers: DataFrame) -> DataFrame:
    ok = F.col("tier").isin("enterprise", "standard", "azure")
    return servers.select("server", F.lit("server").alias("name"), F.when(ok, "PASS").otherwise("FAIL").alias("severity"), F.coalesce("tier", F.lit("unknown")).alias("detail"))


def check_log(latest: DataFrame, max_bytes: int, max_pct: int) -> DataFrame:
    used, pct = F.floor(F.col("total_bytes") * F.col("used_percent") / 100).cast("long"), F.floor("used_percent").cast("long")
    severity = F.when(used >= max_bytes, "FAIL").when(pct >= max_pct, "FAIL").when(F.col("reuse_wait") != "NOTHING", "WARN").otherwise("PASS")
    return latest.select("server", F.lit("log").alias("name"), severity.alias("severity"), F.concat(F.lit("reuse wait "), F.col("reuse_wait")).alias("detail"))


def check_blocking(sessions: DataFrame, keys: tuple[str, ...] = ("server",)) -> DataFrame:
    g = sessions.groupBy(*keys, "poll_ts").agg(F.count_if(F.col("blocking_spid") != 0).alias("blocked"))
    return g.withColumn("severity", F.when(F.col("blocked") > 0, "WARN").otherwise("PASS"))


def check_free_space(need: DataFrame, files: DataFrame) -> DataFrame:
    """Of (server, need_mb; NULL or 0: unread) and files (server, free_mb, headroom_mb; NULL: unlimited or unknown).

    Only space that is free now passes: what growth would have to add warns, and so does what can't be told. need may
    hold ``unsized``, the number of disabled indexes of unknown size, which the detail names.
    """
    f = files.groupBy("server").agg(F.sum("free_mb").alias("free"), F.coalesce(F.sum("headroom_mb"), F.lit(0)).alias("head"), F.bool_or(F.col("headroom_mb").isNull()).alias("open"))
    d = need.join(f, "server", "left")
    free = F.coalesce("free", F.lit(0))
    unread = F.col("need_mb").isNull() | (F.col("need_mb") <= 0)
    severity = F.when(unread, "WARN").when(free >= F.col("need_mb"), "PASS").when(F.coalesce("open", F.lit(True)), "WARN").when(F.col("head") >= F.col("need_mb") - free, "WARN").otherwise("FAIL")
    unsized = F.when(F.col("unsized") > 0, F.concat(F.lit("; "), F.col("unsized").cast("string"), F.lit(" disabled of unknown size"))) if "unsized" in need.columns else F.lit(None).cast("string")
    detail = F.concat(F.when(unread, "unread").otherwise(F.concat_ws("/", F.col("need_mb").cast("string"), free.cast("string"))), F.coalesce(unsized, F.lit("")))
    return d.select("server", F.lit("free space").alias("name"), severity.alias("severity"), detail.alias("detail"))


def check_file_growth(files: DataFrame, shrunk: DataFrame) -> DataFrame:
    """Of files (server, file_name, file_type, growth, is_percent) and shrunk (server, file_type): growth by percent, and growth
    that is off for a type of file that is being shrunk, warn; the files are listed by name."""
    s = shrunk.select("server", "file_type").distinct().withColumn("_s", F.lit(True))
    d = files.join(s, ["server", "file_type"], "left")
    note = F.when(F.col("is_percent"), F.concat("file_name", F.lit(" grows by percent"))).when(F.col("_s") & (F.col("growth") == 0), F.concat("file_name", F.lit(" can't grow back")))
    g = d.groupBy("server").agg(F.array_sort(F.collect_list(note)).alias("notes"), F.count("*").alias("n"))
    bad = F.size("notes") > 0
    return g.select("server", F.lit("file growth").alias("name"), F.when(bad, "WARN").otherwise("PASS").alias("severity"), F.when(bad, F.array_join("notes", "; ")).otherwise(F.concat(F.col("n").cast("string"), F.lit(" files"))).alias("detail"))


def check_permissions(operations: DataFrame, grants: DataFrame) -> DataFrame:
    """Of operations (server, command, table_name, kills) and grants (server, grant, table_name; NULL: of the server): what is missing.

    Shrinks and database checks need owner or sysadmin, a shrink of tempdb sysadmin, a bulk change its right on its
    table: these fail. A policy that kills blockers needs kill, without which it does nothing: that warns.
    """
    g = grants.where("table_name IS NULL").groupBy("server").agg(F.collect_set("grant").alias("have"))
    t = grants.where("table_name IS NOT NULL").select("server", "table_name", "grant").distinct().withColumn("_t", F.lit(True))
    verb = F.when(F.col("command") == "batch_delete", "DELETE").when(F.col("command") == "batch_update", "UPDATE")
    d = operations.withColumn("grant", verb).join(g, "server", "left").join(t, ["server", "table_name", "grant"], "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    has = lambda *names: F.arrays_overlap("have", F.array(*map(F.lit, names)))
    one = lambda name, ok, bad: F.struct(F.lit(name).alias("name"), F.when(ok, "PASS").otherwise(bad).alias("severity"))
    checks = F.array_compact(
        F.array(
            F.when(F.col("command").isin(*ELEVATED), one("elevated", has("owner", "sysadmin"), "FAIL")),
            F.when(F.col("command") == "shrink_tempdb", one("tempdb", has("sysadmin"), "FAIL")),
            F.when(F.col("kills"), one("kill", has("kill", "sysadmin", "processadmin"), "WARN")),
            F.when(verb.isNotNull(), one("table", F.coalesce("_t", F.lit(False)), "FAIL")),
        )
    )
    c = d.select("server", F.explode(checks).alias("c"), F.concat_ws(" ", "grant", "table_name").alias("detail"))
    return c.select("server", "c.name", "c.severity", F.when(F.col("c.name") == "table", F.col("detail")).otherwise("").alias("detail")).distinct()


def check_reenabled_indexes(heaps: DataFrame, structures: DataFrame) -> DataFrame:
    """Of heaps that are to be rewritten (server, object_id, allowed, readable) and structures (server, object_id, index_id, name,
    kb, is_disabled): a rewrite re-enables disabled indexes, which fails unless allowed; what can't be read fails."""
    named = F.transform(F.array_sort(F.collect_list(F.when(F.col("is_disabled"), F.struct("index_id", F.col("name").alias("n"))))), lambda x: x["n"])
    s = structures.groupBy("server", "object_id").agg(named.alias("names"))
    d = heaps.join(s, ["server", "object_id"], "left")
    none = F.coalesce(F.size("names"), F.lit(0)) <= 0
    severity = F.when(~F.col("readable"), "FAIL").when(none, "PASS").when(F.col("allowed"), "WARN").otherwise("FAIL")
    return d.select("server", "object_id", F.lit("re-enabled indexes").alias("name"), severity.alias("severity"), F.when(~F.col("readable"), "unread").otherwise(F.coalesce(F.array_join("names", ", "), F.lit(""))).alias("detail"))


def check_heap_scope(heaps: DataFrame, structures: DataFrame) -> DataFrame:
    """What a heap's rewrite rewrites beside it: its other structures, and all KB; nothing else passes, anything warns."""
    other = F.col("index_id") != 0
    s = structures.groupBy("server", "object_id").agg(F.count_if(other).alias("others"), F.sum("kb").alias("kb"))
    d = heaps.join(s, ["server", "object_id"], "left").withColumn("others", F.coalesce("others", F.lit(0)))
    return d.select("server", "object_id", F.lit("heap scope").alias("name"), F.when(F.col("others") > 0, "WARN").otherwise("PASS").alias("severity"), F.concat_ws("/", F.col("others").cast("string"), F.coalesce("kb", F.lit(0)).cast("string")).alias("detail"))


def check_operations(ops: DataFrame, catalog: DataFrame) -> DataFrame:
    """Of (server, command, table_name, index_name): what must exist, or must not yet."""
    t = catalog.select("server", "table_name").distinct().withColumn("_t", F.lit(True))
    i = catalog.select("server", "table_name", "index_name").distinct().withColumn("_i", F.lit(True))
    d = ops.join(t, ["server", "table_name"], "left").join(i, ["server", "table_name", "index_name"], "left")
    adds = F.col("command").rlike("^(create|add)_")
    severity = F.when(F.col("_t").isNull(), "FAIL").when(adds & F.col("_i"), "WARN").when(~adds & F.col("_i").isNull() & F.col("index_name").isNotNull(), "FAIL").otherwise("PASS")
    return d.select("server", F.lit("operations").alias("name"), severity.alias("severity"), F.concat_ws(".", "table_name", "index_name").alias("detail"))


def preflight_checks(manifests: DataFrame, checks: dict[str, DataFrame]) -> DataFrame:
    """(manifest, server, name, severity, detail): every check of every manifest (manifest, server).

    A check (server, severity, detail if there) without a manifest holds for all manifests of its server, one with a
    manifest for that one on that server.
    """
    every = None
    for name, c in checks.items():
        own = ["server", *(["manifest"] if "manifest" in c.columns else [])]
        detail = F.col("detail").cast("string") if "detail" in c.columns else F.lit(None).cast("string")
        d = manifests.join(c.select(*own, "severity", detail.alias("detail")), own).select("manifest", "server", F.lit(name).alias("name"), "severity", "detail")
        every = d if every is None else every.unionByName(d)
    return every


def preflight(manifests: DataFrame, checks: dict[str, DataFrame]) -> DataFrame:
    """Per manifest and server: the worst severity, how many checks failed or warned, and what blocks: failed checks with their details, in order."""
    c = preflight_checks(manifests, checks)
    failed = F.col("severity") == "FAIL"
    blocking = F.array_join(F.array_sort(F.collect_list(F.when(failed, F.concat_ws(": ", "name", "detail")))), "; ")
    g = c.groupBy("manifest", "server").agg(F.count_if(failed).alias("fails"), F.count_if(F.col("severity") == "WARN").alias("warns"), blocking.alias("blocking"))
    d = manifests.join(g, ["manifest", "server"], "left").na.fill({"fails": 0, "warns": 0, "blocking": ""})
    return d.select("manifest", "server", F.when(F.col("fails") > 0, "FAIL").when(F.col("warns") > 0, "WARN").otherwise("PASS").alias("severity"), "fails", "warns", "blocking")
