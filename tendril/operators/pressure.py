"""Gauges, alarms and event-time logic."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import latched, over, truncated


def log_usage(samples: DataFrame) -> DataFrame:
    return samples.withColumn("used_bytes", truncated(F.col("total_bytes") * F.col("used_percent") / 100))


def log_breach(samples: DataFrame, max_bytes: int, max_pct: int) -> DataFrame:
    """Samples at or over a cap; the percentage is cut to an integer first."""
    d = log_usage(samples).withColumn("over_bytes", F.col("used_bytes") >= max_bytes).withColumn("over_pct", truncated(F.col("used_percent")) >= max_pct)
    fired = F.concat_ws(",", F.when(F.col("over_bytes"), "bytes"), F.when(F.col("over_pct"), "percent"))
    return d.where("over_bytes OR over_pct").withColumn("fired", fired)


def log_full_alarm(samples: DataFrame, fire: float = 90, rearm: float = 85) -> DataFrame:
    """Rows at which the alarm fires: at ``fire`` or more, silent until a reading below ``rearm``."""
    return samples.withColumn("fires", latched(F.col("used_percent"), fire, rearm, over(["server"], "poll_ts", "used_percent"))).where("fires").drop("fires")


def cpu_pressure_alarm(samples: DataFrame, fire: float = 1.0, rearm: float = 0.5) -> DataFrame:
    """The same latch on runnable tasks a scheduler; rows without schedulers neither fire nor re-arm."""
    d = samples.where("schedulers > 0").withColumn("ratio", F.col("runnable_tasks") / F.col("schedulers"))
    return d.withColumn("fires", latched(F.col("ratio"), fire, rearm, over(["server"], "poll_ts", "runnable_tasks"))).where("fires").drop("fires")


def log_peak(samples: DataFrame, operations: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """Per operation the highest used bytes inside it, with the reuse wait then; the first of ties.

    Samples and operations meet by server and bucket of time, so that a sample is compared only with operations that
    run in its bucket.
    """
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / bucket_s)
    o = operations.select("op_id", "server", "start_ts", "end_ts", F.explode(F.sequence(bucket("start_ts"), bucket("end_ts"))).alias("bucket"))
    j = log_usage(samples).withColumn("bucket", bucket("poll_ts")).join(o, ["server", "bucket"]).where((F.col("poll_ts") >= F.col("start_ts")) & (F.col("poll_ts") <= F.col("end_ts")))
    top = F.max_by(F.struct("used_bytes", "reuse_wait", "poll_ts"), F.struct("used_bytes", -F.unix_micros(F.col("poll_ts").cast("timestamp"))))
    return j.groupBy("op_id", "server").agg(top.alias("t")).select("op_id", "server", "t.*")


def server_load(samples: DataFrame) -> DataFrame:
    """Newest sample of each server: runnable tasks a scheduler, NULL without schedulers."""
    s = samples.groupBy("server").agg(F.max_by(F.struct("poll_ts", "runnable_tasks", "schedulers"), F.struct("poll_ts", "runnable_tasks", "schedulers")).alias("s")).select("server", "s.*")
    return s.withColumn("load", F.when(F.col("schedulers") > 0, F.col("runnable_tasks") / F.col("schedulers")))


def busy_share(records: DataFrame) -> DataFrame:
    """Of ring-buffer records (server, ts, payload XML): the newest one's busy and process share, clamped; NULL if a field lacks."""
    shape = "SchedulerMonitorEvent struct<SystemHealth: struct<ProcessUtilization: int, SystemIdle: int>>"
    h = F.from_xml("payload", shape)["SchedulerMonitorEvent"]["SystemHealth"]
    d = records.groupBy("server").agg(F.max_by("payload", "ts").alias("payload")).select("server", h.alias("h"))
    busy = F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.col("h.SystemIdle")))
    both = F.col("h.SystemIdle").isNotNull() & F.col("h.ProcessUtilization").isNotNull()
    return d.select("server", F.when(both, busy).alias("busy"), F.when(both, F.greatest(F.lit(0), F.least(busy, F.col("h.ProcessUtilization")))).alias("process"))


def log_history_ages(databases: DataFrame, transactions: DataFrame, now: Column) -> DataFrame:
    """Seconds since the last log backup (1900-01-01: never) and since the oldest open transaction."""
    t = transactions.groupBy("database").agg(F.min("begin_ts").alias("oldest"))
    never = F.year("last_log_backup") <= 1900
    age = lambda c: F.unix_timestamp(now) - F.unix_timestamp(c)
    return databases.join(t, "database", "left").select("database", F.when(~never, age("last_log_backup")).alias("backup_age_s"), age("oldest").alias("transaction_age_s"))


def active_log_floor(vlfs: DataFrame) -> DataFrame:
    return vlfs.where("active").agg(F.ceil(F.coalesce(F.sum("size_mb"), F.lit(0.0))).cast("long").alias("floor_mb"))


def islands(polls: DataFrame, flag: str, keys: list[str]) -> DataFrame:
    """Runs of polls with the flag set: adds island, its start, and seconds since."""
    w = over(keys, "poll_ts")
    d = polls.withColumn("_off", F.sum((~F.col(flag)).cast("int")).over(w)).where(flag)
    start = F.min("poll_ts").over(W.partitionBy(*keys, "_off"))
    return d.withColumn("start_ts", start).withColumn("held_s", F.unix_timestamp("poll_ts") - F.unix_timestamp("start_ts")).withColumnRenamed("_off", "island")


def blocking_debounce(polls: DataFrame, flag: str, timeout_s: int, keys: list[str]) -> DataFrame:
    """The first poll of each run of the flag that has lasted timeout_s."""
    d = islands(polls, flag, keys).where(F.col("held_s") >= timeout_s)
    return d.groupBy(*keys, "island", "start_ts").agg(F.min("poll_ts").alias("fired_ts")).drop("island")


def block_alarms(polls: DataFrame, timeout_s: int, max_block_s: int, keys: list[str]) -> DataFrame:
    """Of polls with ``unignored`` and ``any``: where blocking must be reacted to, and whether the cap asks for it.

    ``unignored`` that has lasted timeout_s fires; so does ``any`` that has lasted max_block_s, whoever is ignored:
    then ``capped`` is true. max_block_s 0: no cap.
    """
    fired = blocking_debounce(polls, "unignored", timeout_s, keys).withColumn("capped", F.lit(False))
    return fired.unionByName(blocking_debounce(polls, "any", max_block_s, keys).withColumn("capped", F.lit(True))) if max_block_s > 0 else fired


def decide_reaction(pressure: DataFrame) -> DataFrame:
    """Of (blocked, log_over, blind, resumable) and, if there, capped: what to do, and why; what the cap asks for says so first."""
    action = F.when(~F.col("blocked") & ~F.col("log_over") & ~F.col("blind"), "continue").when(F.col("blind"), "cancel").when(F.col("resumable"), "pause").otherwise("cancel")
    capped = F.col("blocked") & F.col("capped") if "capped" in pressure.columns else F.lit(False)
    why = F.concat_ws(",", F.when(F.col("blind"), "blind"), F.when(capped, "cap"), F.when(F.col("blocked"), "blocking"), F.when(F.col("log_over"), "log"))
    return pressure.withColumn("action", action).withColumn("detail", why)


def time_to_relief(pauses: DataFrame, samples: DataFrame, drain_timeout_s: int = 0, blind_s: int = 0) -> DataFrame:
    """Per pause the first later sample without pressure, the seconds to it, and how the wait ended.

    drain_timeout_s: a log that stays over its cap so long, without a break, from the pause on ends the wait as
    ``drain``; blind_s: so does a silence so long as ``blind``. Otherwise ``relief``, or NULL while it lasts. Pauses
    and samples of a server are ordered together once; no pause meets all samples.
    """
    p = pauses.select("server", F.col("pause_ts").alias("ts"), F.lit(0).alias("side"), F.lit(None).cast("boolean").alias("blocked"), F.lit(None).cast("boolean").alias("log_over"))
    both = p.unionByName(samples.select("server", F.col("poll_ts").alias("ts"), F.lit(1).alias("side"), "blocked", "log_over"))
    later = W.partitionBy("server").orderBy(F.desc("ts"), "side").rowsBetween(W.unboundedPreceding, -1)  # rows of a later time
    on = F.col("side") == 1
    seen = lambda c: F.last(F.when(on & c, F.col("ts")), ignorenulls=True).over(later)
    d = both.withColumn("relief_ts", seen(~F.col("blocked") & ~F.col("log_over"))).withColumn("drained_ts", seen(~F.col("log_over"))).withColumn("next_ts", seen(F.lit(True)))
    d = d.where("side = 0").select("server", F.col("ts").alias("pause_ts"), "relief_ts", "drained_ts", "next_ts").distinct()
    wait = lambda c: F.unix_timestamp(c) - F.unix_timestamp("pause_ts")
    blind = (wait("next_ts") >= blind_s) | F.col("next_ts").isNull() if blind_s else F.lit(False)
    drain = (wait("drained_ts") > drain_timeout_s) | (F.col("drained_ts").isNull() & F.col("next_ts").isNotNull()) if drain_timeout_s else F.lit(False)
    ended = F.when(blind, "blind").when(drain, "drain").when(F.col("relief_ts").isNotNull(), "relief")
    return d.select("server", "pause_ts", "relief_ts", wait("relief_ts").alias("relief_s"), ended.alias("ended"))


def merge_channels(block: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """A row per poll of either channel, with the other's latest known value; a failed poll (NULL) keeps the old one."""
    both = block.unionByName(log, allowMissingColumns=True)
    w = over(keys, "poll_ts").rowsBetween(W.unboundedPreceding, 0)
    return both.select(*keys, "poll_ts", *(F.last(c, ignorenulls=True).over(w).alias(c) for c in both.columns if c not in (*keys, "poll_ts")))


def channel_outages(polls: DataFrame, keys: list[str]) -> DataFrame:
    """A row at the start of each outage, and one at its end with the number of missed polls."""
    w = over(keys, "poll_ts")
    d = polls.withColumn("was", F.lag("failed", 1, False).over(w)).withColumn("good", F.sum((~F.col("failed")).cast("int")).over(w))
    missed = F.sum(F.col("failed").cast("long")).over(W.partitionBy(*keys, "_before"))
    d = d.withColumn("_before", F.when(F.col("failed"), F.col("good")).otherwise(F.col("good") - 1)).withColumn("missed", missed)
    started = d.where("failed AND NOT was").select(*keys, "poll_ts", F.lit("failed").alias("event"), F.lit(0).cast("long").alias("missed"))
    ended = d.where("NOT failed AND was").select(*keys, "poll_ts", F.lit("recovered").alias("event"), "missed")
    return started.unionByName(ended)


def blind_channels(polls: DataFrame, keys: list[str], now: Column, after_s: int = 120) -> DataFrame:
    """Of (keys, poll_ts, failed, cadence_s): each time a channel turned blind, when, since which good poll, and when it answered again.

    A channel is blind once no good poll has come for max(after_s, 2 of its cadences), up to ``now``: one that stays
    silent has no recovered_ts, and silent_s up to now. A failed poll is no answer. A channel that never answered isn't
    known, and a NULL cadence is 0.
    """
    good = polls.where(~F.coalesce("failed", F.lit(False)))
    w = over(keys, "poll_ts")
    back, limit = F.lead("poll_ts").over(w), F.greatest(F.lit(after_s), 2 * F.coalesce("cadence_s", F.lit(0))).cast("long")
    d = good.select(*keys, F.col("poll_ts").alias("last_ok_ts"), back.alias("recovered_ts"), limit.alias("limit_s"))
    d = d.withColumn("silent_s", F.unix_timestamp(F.coalesce("recovered_ts", now)) - F.unix_timestamp("last_ok_ts")).where("silent_s >= limit_s")
    return d.select(*keys, "last_ok_ts", F.expr("last_ok_ts + make_dt_interval(0, 0, 0, limit_s)").alias("blind_ts"), "recovered_ts", "silent_s")


def next_eta(anchor: tuple[float, float] | None, elapsed: float, pct: float) -> tuple[tuple[float, float] | None, int | None]:
    """The anchor after a reading, and the remaining whole seconds that it tells."""
    if pct <= 0:
        return None, None
    if anchor is None or elapsed < anchor[0] or pct < anchor[1]:
        return (elapsed, pct), None
    took, gained = elapsed - anchor[0], pct - anchor[1]
    return anchor, int(took * (100 - pct) // gained) if gained > 0 and took > 0 else None


def progress_eta(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Of (poll_ts, elapsed_s, pct): remaining seconds from an anchor reading, cut to whole ones.

    The first reading with progress is the anchor; it moves where elapsed or pct fall below it, and goes where pct
    is 0 or less. Where it moves depends on where it was, which no window function tells: each request's readings are
    taken in order, once, by the step that the streaming form takes. NULL readings have no answer and change nothing.
    """
    kinds = dict(samples.dtypes)

    def fold(rows: pa.Table) -> pa.Table:
        anchor, etas = None, []
        for e, q in zip(rows["elapsed_s"].to_pylist(), rows["pct"].to_pylist(), strict=True):
            eta = None
            if e is not None and q is not None:
                anchor, eta = next_eta(anchor, e, q)
            etas.append(eta)
        return rows.select([*keys, "poll_ts"]).append_column("eta_s", pa.array(etas, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:  # sorted by request, then time: a request ends where the next one begins
            held.append(batch)
            rows = pa.Table.from_batches(held).combine_chunks()
            edge = _last_group(rows, keys)
            for part in _groups(rows.slice(0, edge), keys):
                yield from fold(part).to_batches()
            held = rows.slice(edge).to_batches()
        if held:
            for part in _groups(pa.Table.from_batches(held), keys):
                yield from fold(part).to_batches()

    d = samples.select(*keys, "poll_ts", F.col("elapsed_s").cast("double").alias("elapsed_s"), F.col("pct").cast("double").alias("pct"))
    shape = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", poll_ts {kinds['poll_ts']}, eta_s long"
    return d.repartition(*keys).sortWithinPartitions(*keys, "poll_ts").mapInArrow(run, shape)


def _edges(rows: pa.Table, keys: list[str]) -> list[int]:
    """Where a row's keys differ from those of the one before."""
    if not len(rows):
        return []
    shown = list(zip(*(rows[k].to_pylist() for k in keys), strict=True))
    return [0] + [i for i in range(1, len(shown)) if shown[i] != shown[i - 1]]


def _last_group(rows: pa.Table, keys: list[str]) -> int:
    edges = _edges(rows, keys)
    return edges[-1] if edges else 0


def _groups(rows: pa.Table, keys: list[str]) -> Iterator[pa.Table]:
    edges = [*_edges(rows, keys), len(rows)]
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        yield rows.slice(a, z - a)


def counter_rate(samples: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Change a second; NULL at the first reading, after a reset and where the clock stands."""
    w = over(keys, "poll_ts")
    dv, dt = F.col(value) - F.lag(value).over(w), F.unix_timestamp("poll_ts") - F.unix_timestamp(F.lag("poll_ts").over(w))
    return samples.withColumn("rate", F.when((dv >= 0) & (dt > 0), dv / dt))


def campaign_eta(progress: DataFrame) -> DataFrame:
    """Of (start_mb, current_mb, final_mb, chunks_done, elapsed_s, blocked_s): chunks left, ETA with and without blocked time, seconds a chunk.

    What is left is scaled by the rate of what is done, and rounded up; 0 where nothing is done or left. Without time
    that wasn't blocked, the second ETA is the first.
    """
    done, left = F.col("start_mb") - F.col("current_mb"), F.col("current_mb") - F.col("final_mb")
    known, n, elapsed = (done > 0) & (left > 0), F.col("chunks_done"), F.col("elapsed_s")
    eta = lambda s: F.when(known & (s > 0), F.ceil(left * s / done)).otherwise(0).cast("long")
    free = eta(elapsed - F.col("blocked_s"))
    chunks = F.when(known & (n > 0), F.ceil(left * n / done)).otherwise(0).cast("long")
    each = F.when((n > 0) & (elapsed > 0), F.round(elapsed / n)).otherwise(0).cast("long")
    return progress.select("*", chunks.alias("chunks_left"), eta(elapsed).alias("eta_s"), F.when(free == 0, eta(elapsed)).otherwise(free).alias("eta_free_s"), each.alias("chunk_s"))


def movable_target(files: DataFrame, percent: int, floor_mb: int = 0) -> DataFrame:
    """Of (used_mb, size_mb): target with ``percent`` free, not under what is used or the floor; what shrinking would give back."""
    target = F.greatest(F.ceil(F.col("used_mb") * (100 + percent) / 100), F.col("used_mb"), F.lit(floor_mb)).cast("long")
    d = files.withColumn("target_mb", target)
    d = d.withColumn("no_op", (F.col("size_mb") <= F.col("used_mb")) | (F.col("target_mb") >= F.col("size_mb")))
    return d.withColumn("reclaimable_mb", F.when(F.col("no_op"), 0).otherwise(F.col("size_mb") - F.col("target_mb")).cast("long"))


def window_filter(df: DataFrame, ts: str, start: str, end: str, days: list[int] | None = None) -> DataFrame:
    """Rows inside a recurring window; an overnight one belongs to the day on which it opens. days: 1 is Sunday; none: all."""
    minutes = lambda t: int(t[:2]) * 60 + int(t[3:])
    a, b = minutes(start), minutes(end)
    m = F.hour(ts) * 60 + F.minute(ts)
    day = F.dayofweek(ts)
    on = lambda d: d.isin(*days) if days else F.lit(True)
    yesterday = F.when(day == 1, 7).otherwise(day - 1)
    if a < b:
        return df.where((m >= a) & (m < b) & on(day))
    return df.where(((m >= a) & on(day)) | ((m < b) & on(yesterday)))
