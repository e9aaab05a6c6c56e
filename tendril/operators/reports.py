"""Run reports: sizes before and after, totals, summaries, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fleet import HEAVY


def size_lines(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Of structures (keys with index_id, name, is_disabled, kb) of either side: name (``heap`` for index 0), was_disabled, and -1 where a side wasn't measured."""
    b = before.select(*keys, F.col("name").alias("b_name"), F.col("is_disabled").alias("was_disabled"), F.col("kb").alias("before_kb"))
    d = b.join(after.select(*keys, "name", F.col("kb").alias("after_kb")), keys, "full")
    name = F.when(F.col("index_id") == 0, "heap").otherwise(F.coalesce("b_name", "name")).alias("name")
    return d.select(*keys, name, F.coalesce("was_disabled", F.lit(False)).alias("was_disabled"), *(F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("before_kb", "after_kb")))


def size_totals(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Each structure once: its first measured size before and its last after; their sums and number."""
    first = F.min_by("before_kb", F.when(F.col("before_kb") >= 0, F.col("op_index")))
    last = F.max_by("after_kb", F.when(F.col("after_kb") >= 0, F.col("op_index")))
    g = lines.where("before_kb >= 0 OR after_kb >= 0").groupBy(*keys).agg(first.alias("b"), last.alias("a"))
    return g.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("before_kb"), F.coalesce(F.sum("a"), F.lit(0)).alias("after_kb"), F.count("*").alias("structures"))


def humanized(kb: Column) -> Column:
    """KB up to 1 MB, then MB, GB with a digit and TB with two."""
    step = lambda k, n, unit: F.format_string(f"%.{n}f {unit}", F.bround(kb / float(1 << k), n))  # noqa: E731  halves go to the even digit
    return F.when(kb < 1 << 10, F.format_string("%d KB", kb)).when(kb < 1 << 20, step(10, 1, "MB")).when(kb < 1 << 30, step(20, 1, "GB")).otherwise(step(30, 2, "TB"))


def size_change(lines: DataFrame) -> DataFrame:
    """Adds change_pct (NULL if a side is unknown, -1, or nothing was there before) and text: both sides, and the change if it is known."""
    known = (F.col("before_kb") > 0) & (F.col("after_kb") >= 0)
    d = lines.withColumn("change_pct", F.when(known, 100.0 * (F.col("after_kb") - F.col("before_kb")) / F.col("before_kb")))
    side = lambda c: F.when(F.col(c) == -1, "unknown").otherwise(humanized(F.col(c)))
    return d.withColumn("text", F.concat(side("before_kb"), F.lit(" -> "), side("after_kb"), F.when(known, F.format_string(" (%+.1f%%)", F.bround("change_pct", 1))).otherwise("")))


def size_changes(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Per operation (keys): structures, how many were measured on both sides, and the sums and change of these."""
    both = (F.col("before_kb") >= 0) & (F.col("after_kb") >= 0)
    total = lambda c: F.coalesce(F.sum(F.when(both, F.col(c))), F.lit(0)).alias(c)
    return size_change(lines.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(both).alias("measured"), total("before_kb"), total("after_kb")))


def run_summary(runs: DataFrame) -> DataFrame:
    names = ("done", "failed", "incomplete", "interrupted", "deferred", "skipped")
    return runs.groupBy("manifest").agg(*(F.count_if(F.col("outcome") == n).alias(n) for n in names))


def run_record(reports: DataFrame) -> DataFrame:
    """Of reports (run_id, operations: array of (command, outcome, peak_blocked, resumed) and, if there, size_before_kb, size_after_kb): one row a run.

    Sizes are those of ``size_totals``, carried by the report; without them they are NULL.
    """
    sizes = [c for c in ("size_before_kb", "size_after_kb") if c in reports.columns]
    o = reports.select("run_id", *sizes, F.explode_outer("operations").alias("o"))
    kept = [F.any_value(c).alias(c) if c in sizes else F.lit(None).cast("long").alias(c) for c in ("size_before_kb", "size_after_kb")]
    skipped = F.count_if((F.col("o.outcome") == "skipped") & ~F.coalesce("o.resumed", F.lit(False))).alias("skipped")
    return o.groupBy("run_id").agg(F.count("o").alias("operations"), F.coalesce(F.max("o.peak_blocked"), F.lit(0)).alias("peak_blocked"), skipped, *kept)


def cancel_only_summary(ops: DataFrame, reactions: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Per run, of operations (run_id, op_id, command, resumable, outcome) that a cancel rolls back: those canceled, saved by a retry, and failed.

    Only operations that rebuild as a whole and can't be resumed count, and of these only those with a cancel among
    their reactions (run_id, op_id, kind). Done is saved; anything else failed. Runs without any have no row.
    """
    heavy = F.col("command").isin(*HEAVY) & ~F.coalesce("resumable", F.lit(False))
    c = ops.where(heavy).join(reactions.where("kind = 'cancel'").select(*keys, "op_id").distinct(), [*keys, "op_id"], "left_semi")
    return c.groupBy(*keys).agg(F.count("*").alias("canceled"), F.count_if(F.col("outcome") == "done").alias("saved"), F.count_if(~F.coalesce(F.col("outcome") == "done", F.lit(False))).alias("failed"))


def plan_fingerprint(planned: DataFrame) -> DataFrame:
    """SHA-256 of each manifest's ordered list of command and target."""
    rows = F.array_sort(F.collect_list(F.struct("op_index", "command", "target")))
    return planned.groupBy("manifest").agg(F.sha2(F.array_join(F.transform(rows, lambda r: F.concat_ws(" ", r["command"], r["target"])), "\n"), 256).alias("fingerprint"))
