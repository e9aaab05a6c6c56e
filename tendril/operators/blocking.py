"""Blocking analytics: victims, chains, rules, identities, debt, episodes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scratch
from ..functions.columns import over

#: Verbs whose blocked request turns into an outage of the table, and maintenance verbs.
AMPLIFYING = ("ALTER INDEX", "ALTER TABLE", "CREATE INDEX", "CREATE STATISTICS", "UPDATE STATISTIC", "DROP INDEX", "DROP TABLE", "TRUNCATE TABLE", "DBCC")
MAINTENANCE = ("ALTER INDEX", "DBCC")
#: Ids of sessions are unique in one server only.
SERVER = ("server",)
#: Most waits of a poll whose queues one task counts.
POLL = 100_000
JOB = r"^SQLAgent - TSQL JobStep \(Job 0x([0-9A-Fa-f]+) : Step (\d+)\)$"


def direct_victims(sessions: DataFrame, runs: DataFrame, keys: tuple[str, ...] = SERVER) -> DataFrame:
    """Sessions that the run of their server and poll blocks directly; session 0 blocks nobody."""
    r = runs.where("run_spid <> 0").select(*keys, "poll_ts", "run_spid")
    return sessions.join(r, [*keys, "poll_ts"]).where(F.col("blocking_spid") == F.col("run_spid"))


def self_block(sessions: DataFrame, runs: DataFrame, keys: tuple[str, ...] = SERVER) -> DataFrame:
    """Is the run itself blocked, by whom, and with what at work: its statement or, without one, its batch. The blocker's row may be missing."""
    on = [*keys, "poll_ts"]
    me = sessions.join(runs.select(*on, F.col("run_spid").alias("spid")), [*on, "spid"]).where("blocking_spid <> 0").select(*on, "spid", F.col("blocking_spid").alias("blocker_spid"), "wait_ms")
    query = F.coalesce(F.nullif(F.trim("statement"), F.lit("")), F.col("batch"))
    b = sessions.select(*on, F.col("spid").alias("blocker_spid"), F.col("login").alias("blocker_login"), F.col("program").alias("blocker_program"), query.alias("blocker_query"))
    return me.join(b, [*on, "blocker_spid"], "left")


def _sizes(group: np.ndarray, waiter: np.ndarray, blocker: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of waits, one a waiter: (session, a row that has its group, sessions behind it) of all with any behind them."""
    groups, names = np.r_[group, group], np.r_[waiter, blocker]
    order = np.lexsort((names, groups))
    new = np.r_[True, (np.diff(groups[order]) != 0) | (np.diff(names[order]) != 0)]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    n = int(new.sum())
    up, size = np.full(n, -1, np.int64), np.ones(n, np.int64)
    up[of[: len(waiter)]] = of[len(waiter) :]
    waiting = np.bincount(up[up >= 0], minlength=n)
    now = np.flatnonzero(waiting == 0)
    while len(now := now[up[now] >= 0]):  # sessions whom nobody is behind any more pass on what they have counted
        at = up[now]
        np.add.at(size, at, size[now])
        np.subtract.at(waiting, at, 1)
        now = np.unique(at)
        now = now[waiting[now] == 0]
    ring = np.flatnonzero(waiting > 0)
    if len(ring):
        place = np.empty(n, np.int64)
        place[ring] = np.arange(len(ring))
        ahead, low = place[up[ring]], np.arange(len(ring))
        for _ in range(len(ring).bit_length()):
            low, ahead = np.minimum(low, low[ahead]), ahead[ahead]
        total = np.zeros(len(ring), np.int64)
        np.add.at(total, low, size[ring])
        size[ring] = total[low]
    found = np.flatnonzero(size > 1)
    first = order[new][found]
    return names[first], first % max(len(waiter), 1), size[found] - 1


def _polls(keys: list[str]):
    """Of waits sorted by keys: who has how many behind, of whole polls, a few at a time."""

    def counted(rows: pa.Table, edge: np.ndarray) -> pa.RecordBatch:
        waiter, blocker = (rows[x].to_numpy().astype(np.int64) for x in ("spid", "ptr"))
        session, at, behind = _sizes(np.cumsum(edge), waiter, blocker)
        of = rows.select(keys).take(pa.array(at)).combine_chunks()
        columns = [*(of[k].combine_chunks() for k in keys), pa.array(session).cast(rows.schema.field("spid").type), pa.array(behind)]
        return pa.RecordBatch.from_arrays(columns, [*keys, "spid", "behind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]).combine_chunks() if rest is not None else rows
            edge = np.zeros(len(rows), bool)
            for k in keys:
                edge[1:] |= pc.not_equal(rows[k][1:], rows[k][:-1]).to_numpy()
            last = int(np.flatnonzero(edge)[-1]) if edge.any() else 0
            rest = rows.slice(last)
            if last:
                yield counted(rows.slice(0, last), edge[:last])
        if rest is not None:
            yield counted(rest, np.zeros(len(rest), bool))

    return run


def blocked_behind(sessions: DataFrame, keys: tuple[str, ...] = SERVER, poll: int = POLL) -> DataFrame:
    """Distinct sessions of a server and poll queued behind each other one over any number of steps, itself left out.

    A session waits for one blocker (of several rows: the smallest id), so a poll is trees that hang on roots or
    cycles. Polls of at most ``poll`` waits are each counted in one task; larger ones by joins, which give the same.
    """
    on = [*keys, "poll_ts"]
    waits = scratch.table(sessions.where("blocking_spid <> 0 AND spid IS NOT NULL").dropna(subset=on).groupBy(*on, "spid").agg(F.min("blocking_spid").alias("ptr")), "waits")
    large = scratch.table(waits.groupBy(*on).count().where(F.col("count") > poll).select(*on), "large")
    some = not large.isEmpty()
    small = waits.join(large, on, "left_anti") if some else waits
    types = {f.name: f.dataType.simpleString() for f in waits.schema}
    shape = ", ".join(f"`{x}` {types[x]}" for x in [*on, "spid"]) + ", behind long"
    counted = small.repartition(*on).sortWithinPartitions(*on).select(*on, "spid", "ptr").mapInArrow(_polls(on), shape)
    return counted.unionByName(_behind_by_joins(waits.join(large, on, "left_semi"), on)) if some else counted


def _behind_by_joins(waits: DataFrame, on: list[str]) -> DataFrame:
    """``blocked_behind`` of polls of any size.

    Pointers are doubled until only cycles are pointed at; a cycle becomes one node, and sums are doubled up the trees.
    Both take as many rounds as the longest chain has binary digits, and each round writes a row a session.
    """
    nodes = waits.select(*on, F.explode(F.array("spid", "ptr")).alias("spid")).distinct().join(waits, [*on, "spid"], "left")
    first = d = scratch.table(nodes.withColumn("low", F.col("spid")).withColumn("moved", F.lit(True)), "waits")
    pointed = lambda t: t.where("ptr IS NOT NULL").select(*on, F.col("ptr").alias("spid")).distinct()
    left = pointed(d).count()
    while left:
        ahead = d.select(*on, F.col("spid").alias("ptr"), F.col("ptr").alias("next"), F.col("low").alias("far"))
        low = F.least("low", "far")  # of all that a session waits for so far: in a cycle, its name
        new = scratch.table(d.join(ahead, [*on, "ptr"], "left").select(*on, "spid", F.col("next").alias("ptr"), low.alias("low"), ((low < F.col("low")) & F.col("next").isNotNull()).alias("moved")), "waits")
        was, left = left, pointed(new).count()
        d = new
        if left == was and d.where("moved").isEmpty():
            break
    cycles = scratch.table(pointed(d).join(d.select(*on, "spid", F.col("low").alias("rep")), [*on, "spid"]), "cycles")
    named = first.select(*on, "spid", "ptr").join(cycles, [*on, "spid"], "left")
    above = cycles.select(*on, F.col("spid").alias("ptr"), F.col("rep").alias("above"))
    named = named.join(above, [*on, "ptr"], "left").select(*on, "spid", F.coalesce("rep", "spid").alias("rep"), F.when(F.col("rep").isNull(), F.coalesce("above", "ptr")).alias("ptr"))
    named = scratch.table(named, "named")
    f = scratch.table(named.groupBy(*on, "rep").agg(F.max("ptr").alias("ptr"), F.count("*").alias("n")), "sums")
    while not f.where("ptr IS NOT NULL").isEmpty():
        more = f.where("ptr IS NOT NULL").groupBy(*on, F.col("ptr").alias("rep")).agg(F.sum("n").alias("more"))
        ahead = f.select(*on, F.col("rep").alias("ptr"), F.col("ptr").alias("next"))
        f = scratch.table(f.join(more, [*on, "rep"], "left").join(ahead, [*on, "ptr"], "left").select(*on, "rep", F.col("next").alias("ptr"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "sums")
    return named.select(*on, "spid", "rep").join(f.select(*on, "rep", "n"), [*on, "rep"]).where("n > 1").select(*on, "spid", (F.col("n") - 1).alias("behind"))


def active_request_count(sessions: DataFrame, keys: tuple[str, ...] = SERVER) -> DataFrame:
    return sessions.groupBy(*keys, "poll_ts").agg(F.count_if(F.lower("status") != "sleeping").alias("active"))


def rule_match(rule: dict) -> Column:
    """A rule's set fields all match: spid exactly; login, host, program and command as unanchored expressions, and

    statement as one on the active statement or its whole batch.
    """
    hit = lambda c, x: F.coalesce(F.col(c).rlike(x), F.lit(False))
    parts = [F.col("spid") == rule["spid"]] if rule.get("spid") is not None else []
    parts += [hit(k, rule[k]) for k in ("login", "host", "program", "command") if rule.get(k)]
    parts += [hit("statement", rule["statement"]) | hit("batch", rule["statement"])] if rule.get("statement") else []
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(False)


def first_matching_rule(sessions: DataFrame, rules: list[dict], default_delay: int = 60) -> DataFrame:
    """The first rule in list order that matches, with its delay, or the default where that isn't above 0. At most 1,000 rules."""
    if len(rules) > 1000:
        raise ValueError("more than 1,000 rules")
    ord_ = reduce(lambda acc, i: F.when(rule_match(rules[i]), i).otherwise(acc), range(len(rules) - 1, -1, -1), F.lit(None).cast("int"))
    delay = reduce(lambda acc, i: F.when(F.col("rule") == i, rules[i].get("after") if (rules[i].get("after") or 0) > 0 else default_delay).otherwise(acc), range(len(rules)), F.lit(None).cast("int"))
    return sessions.withColumn("rule", ord_).withColumn("delay", delay)


def match_session_rules(sessions: DataFrame, rules: list[dict]) -> DataFrame:
    return first_matching_rule(sessions, rules).where("rule IS NOT NULL").drop("rule", "delay")


def block_state(sessions: DataFrame, runs: DataFrame, rules: list[dict], keys: tuple[str, ...] = SERVER) -> DataFrame:
    """Per server and poll: blocks anyone; blocks someone whom no rule allows."""
    on = [*keys, "poll_ts"]
    v = first_matching_rule(direct_victims(sessions, runs, keys), rules).select(*on, F.col("rule").isNull().alias("free"))
    s = v.groupBy(*on).agg(F.bool_or("free").alias("unignored"))
    return runs.select(*on).distinct().join(s, on, "left").select(*on, F.col("unignored").isNotNull().alias("any_blocked"), F.coalesce("unignored", F.lit(False)).alias("unignored"))


def suppress_recent(victims: DataFrame, actions: DataFrame, grace_s: int = 15, keys: tuple[str, ...] = SERVER) -> DataFrame:
    """Victims without an action that is pending, or was done less than grace_s before, on their server.

    actions: (server, spid, action_ts, done_ts, failed); without done_ts it is pending, from action_ts on. A failed
    one suppresses nothing. Actions of a session meet its victims by server, session and what time they cover.
    """
    end = F.col("done_ts") + F.expr(f"INTERVAL {grace_s} SECONDS")
    a = actions.where("NOT coalesce(failed, false)").select(*keys, "spid", "action_ts", end.alias("end_ts"))
    on = [victims[k] == a[k] for k in (*keys, "spid")]
    late = (a["action_ts"] <= victims["poll_ts"]) & (a["end_ts"].isNull() | (victims["poll_ts"] < a["end_ts"]))
    return victims.join(a, reduce(lambda x, y: x & y, on) & late, "left_anti")


def classify_commands(sessions: DataFrame, allow: list[str] | None = None) -> DataFrame:
    verb = F.upper(F.trim("command"))
    listed = [a.strip().upper() for a in (allow if allow is not None else AMPLIFYING) if a.strip()]
    amplifying = reduce(lambda a, b: a | b, [verb.startswith(a) for a in listed], F.lit(False))
    return sessions.withColumn("is_maintenance", verb.isin(*MAINTENANCE)).withColumn("is_amplifying", amplifying)


def amplifying_victims(sessions: DataFrame, runs: DataFrame, rules: list[dict], own_program: str = "tendril", min_behind: int = 1, keys: tuple[str, ...] = SERVER) -> DataFrame:
    """Direct victims with an amplifying verb: not ours, not ignored, not our own blocker, with enough sessions behind."""
    on = [*keys, "poll_ts", "spid"]
    near = sessions.join(runs.select(*on[:-1], "run_spid"), on[:-1]).where("(blocking_spid = run_spid AND run_spid <> 0) OR (spid = run_spid AND blocking_spid <> 0)")
    own = F.collect_set(F.when(F.col("spid") == F.col("run_spid"), F.col("blocking_spid"))).over(over(on[:-1]))
    near = near.withColumn("own", own).where("blocking_spid = run_spid AND run_spid <> 0 AND NOT array_contains(own, spid)").drop("own")
    v = classify_commands(first_matching_rule(near, rules).where("rule IS NULL").drop("rule", "delay")).where("is_amplifying")
    v = v.where(~F.col("program").startswith(own_program))
    return v.join(blocked_behind(sessions, keys), on).where(F.col("behind") >= max(1, min_behind))


def offender_identity(sessions: DataFrame) -> DataFrame:
    job, step = F.regexp_extract("program", JOB, 1), F.regexp_extract("program", JOB, 2)
    who = F.when(job != "", F.concat(F.lit("job:"), F.lower(job), F.lit(":"), step)).otherwise(F.concat(F.lit("sess:"), F.concat_ws("|", "login", "host", "program")))
    return sessions.withColumn("identity", who)


def attribute_jobs(offenders: DataFrame, jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """Names of the job and step of job identities; the others, and unknown ones, stay with the raw identity."""
    part = F.split("identity", ":")
    o = offenders.withColumn("job", F.when(F.col("identity").startswith("job:"), F.get(part, 1))).withColumn("step", F.when(F.col("identity").startswith("job:"), F.get(part, 2).cast("int")))
    return o.join(jobs, "job", "left").join(steps, ["job", "step"], "left").withColumn("resolved", F.col("job_name").isNotNull())


def offender_debt(observed: DataFrame, polls: DataFrame, idle_s: int = 300, keys: tuple[str, ...] = ("server",)) -> DataFrame:
    """Blocking time of each identity and bucket on a server: a gap counts if the identity was seen at the previous poll too;
    idle for strictly longer than idle_s starts a new bucket."""
    order = polls.select(*keys, "poll_ts").distinct()
    order = order.withColumn("prev_ts", F.lag("poll_ts").over(over([*keys], "poll_ts")))
    d = observed.select(*keys, "identity", "poll_ts").distinct().join(order, [*keys, "poll_ts"])
    w = over([*keys, "identity"], "poll_ts")
    gap = F.unix_timestamp("poll_ts") - F.unix_timestamp("last")
    d = d.withColumn("last", F.lag("poll_ts").over(w)).withColumn("gap", gap)
    d = d.withColumn("bucket", F.sum((F.col("gap") > idle_s).cast("long")).over(w)).withColumn("bucket", F.coalesce("bucket", F.lit(0)))
    banked = F.when((F.col("last") == F.col("prev_ts")) & (F.col("gap") <= idle_s), F.col("gap")).otherwise(0)
    return d.groupBy(*keys, "identity", "bucket").agg(F.sum(banked).alias("debt_s"), F.count("*").alias("polls"), F.min("poll_ts").alias("first_seen"), F.max("poll_ts").alias("last_seen"))


def rule_debt(blocks: DataFrame, idle_s: int = 300, keys: tuple[str, ...] = ("server",)) -> DataFrame:
    """Of (server, poll_ts, blocker_spid, rule): seconds per rule and bucket.

    A gap counts inside one blocker's episode where a rule matched; a poll without a rule moves on, and its interval
    counts nowhere. A rule that was idle for longer than idle_s starts a new bucket.
    """
    w = over([*keys], "poll_ts")
    d = blocks.withColumn("was", F.lag("blocker_spid").over(w)).withColumn("at", F.lag("poll_ts").over(w))
    gap = F.when(F.col("was") == F.col("blocker_spid"), F.unix_timestamp("poll_ts") - F.unix_timestamp("at")).otherwise(0)
    d = d.withColumn("gap", gap).where("rule IS NOT NULL")
    own = over([*keys, "rule"], "poll_ts")
    idle = F.unix_timestamp("poll_ts") - F.unix_timestamp(F.lag("poll_ts").over(own)) > idle_s
    d = d.withColumn("idle", F.coalesce(idle, F.lit(False)).cast("long")).withColumn("bucket", F.sum("idle").over(own))
    return d.groupBy(*keys, "rule", "bucket").agg(F.sum("gap").alias("debt_s"), F.count("*").alias("polls"))


def action_candidates(debt: DataFrame, after_s: int, cap: int = 3, keys: tuple[str, ...] = SERVER) -> DataFrame:
    """Of running debts (server, identity, bucket, episode, poll_ts, debt_s): each episode's first row at or over the delay is due.

    The first ``cap`` due rows of a bucket act, the next one escalates, the rest are silent.
    """
    of = [*keys, "identity", "bucket"]
    d = debt.where(F.col("debt_s") >= after_s).withColumn("n", F.row_number().over(over([*of, "episode"], "poll_ts"))).where("n = 1")
    d = d.withColumn("n", F.row_number().over(over(of, "poll_ts", "episode")))
    return d.where(F.col("n") <= cap + 1).withColumn("action", F.when(F.col("n") <= cap, "act").otherwise("escalate"))


def blocker_capture(victims: DataFrame, keys: tuple[str, ...] = SERVER) -> DataFrame:
    """Distinct victims of a server with first and last sight and count; ``seq`` is their order of first sight."""
    who = ["spid", "login", "host", "program", "command"]
    g = victims.groupBy(*keys, *who).agg(F.min("poll_ts").alias("first_seen"), F.max("poll_ts").alias("last_seen"), F.count("*").alias("times_seen"))
    return g.withColumn("seq", F.row_number().over(over([*keys], "first_seen", *who)).cast("long"))


def peak_blocked(victims: DataFrame, operations: DataFrame, keys: tuple[str, ...] = SERVER) -> DataFrame:
    """Of operations (server, op_id, run_spid, start_ts, end_ts): the largest number of victims at one poll, 0 if there were none."""
    n = victims.groupBy(*keys, "run_spid", "poll_ts").agg(F.countDistinct("spid").alias("n"))
    o = operations.select(*keys, "run_spid", "op_id", "start_ts", "end_ts")
    at = reduce(lambda a, b: a & b, [o[k] == n[k] for k in (*keys, "run_spid")]) & n["poll_ts"].between(o["start_ts"], o["end_ts"])
    return o.join(n, at, "left").groupBy(*(o[k] for k in keys), "op_id").agg(F.coalesce(F.max("n"), F.lit(0)).alias("peak"))


def held_through(victims: DataFrame, rules: list[dict], keys: tuple[str, ...] = SERVER) -> DataFrame:
    """First time that each ignored session was held through."""
    return match_session_rules(victims, rules).groupBy(*keys, "spid", "login", "program").agg(F.min("poll_ts").alias("first_seen"))


def suspension_episodes(sessions: DataFrame, runs: DataFrame, keys: tuple[str, ...] = SERVER) -> DataFrame:
    """Who blocked the runs of a server: (server, blocking_spid, login, host, episodes, blocked_ms, first_seen).

    An episode is a change into a blocker; the time to the next poll goes to the poll's blocker. Login and host are
    those at the first poll that has the blocker's row.
    """
    on = [*keys, "poll_ts"]
    s = runs.join(sessions.select(*on, F.col("spid").alias("run_spid"), "blocking_spid"), [*on, "run_spid"]).select(*on, "blocking_spid")
    w = over([*keys], "poll_ts")
    s = s.withColumn("ms", (F.unix_timestamp(F.lead("poll_ts").over(w)) - F.unix_timestamp("poll_ts")) * 1000).withColumn("was", F.lag("blocking_spid", 1, 0).over(w))
    who = sessions.select(*on, F.col("spid").alias("blocking_spid"), "login", "host", F.lit(True).alias("there"))
    s = s.where("blocking_spid <> 0").join(who, [*on, "blocking_spid"], "left")
    known = lambda c: F.min_by(c, F.when(F.col("there"), F.col("poll_ts"))).alias(c)
    return s.groupBy(*keys, "blocking_spid").agg(
        known("login"), known("host"), F.count_if(F.col("was") != F.col("blocking_spid")).alias("episodes"), F.coalesce(F.sum("ms"), F.lit(0)).alias("blocked_ms"), F.min("poll_ts").alias("first_seen")
    )


def suspension_roster(blockers: DataFrame, by: str = "login", keys: tuple[str, ...] = SERVER) -> DataFrame:
    """Of ``suspension_episodes``: episodes and ms by login or host, ``seq`` their order of first sight; blank is the unknown group."""
    who = F.coalesce(F.nullif(F.trim(by), F.lit("")), F.lit("unknown"))
    g = blockers.groupBy(*keys, who.alias("who")).agg(F.sum("episodes").alias("episodes"), F.sum("blocked_ms").alias("blocked_ms"), F.min("first_seen").alias("first_seen"))
    return g.withColumn("seq", F.row_number().over(over([*keys], "first_seen", "who")).cast("long"))


def suspension_groups(blockers: DataFrame, actions: DataFrame, keys: tuple[str, ...] = SERVER) -> DataFrame:
    """Of ``suspension_episodes``, per login (or lone session): its sessions in order of first sight, episodes, ms and actions (server, spid)."""
    key = F.coalesce(F.nullif("login", F.lit("")), F.concat(F.lit("spid:"), F.col("blocking_spid").cast("string")))
    taken = actions.groupBy(*keys, F.col("spid").alias("blocking_spid")).agg(F.count("*").alias("actions"))
    d = blockers.join(taken, [*keys, "blocking_spid"], "left")
    spids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_seen", "blocking_spid"))), lambda x: x["blocking_spid"].cast("string")), ",")
    sums = [F.sum("episodes").alias("episodes"), F.sum("blocked_ms").alias("blocked_ms"), F.coalesce(F.sum("actions"), F.lit(0)).alias("actions")]
    return d.groupBy(*keys, key.alias("who")).agg(spids.alias("spids"), F.count("*").alias("sessions"), *sums)


def amplifier_sources(actions: DataFrame, keys: tuple[str, ...] = SERVER) -> DataFrame:
    """A server's actions by source: the job step, else the program."""
    source = F.when(F.col("identity").startswith("job:"), F.col("identity")).otherwise(F.col("program"))
    return actions.groupBy(*keys, source.alias("source")).agg(F.count("*").alias("actions"), F.min("poll_ts").alias("first_seen"))


def contended_objects(seen: DataFrame, keys: tuple[str, ...] = SERVER) -> DataFrame:
    """Of (server, object_id, poll_ts, kind: lock, tail or transient): first and last sight, lock sightings, strongest kind."""
    rank = F.max(F.when(F.col("kind") == "transient", 3).when(F.col("kind") == "tail", 2).otherwise(1))
    g = seen.groupBy(*keys, "object_id").agg(F.min("poll_ts").alias("first_seen"), F.max("poll_ts").alias("last_seen"), F.count_if(F.col("kind") == "lock").alias("locks"), rank.alias("rank"))
    return g.withColumn("confirmed_by", F.element_at(F.array(F.lit("lock"), F.lit("tail"), F.lit("transient")), F.col("rank"))).drop("rank")


def held_object_locks(locks: DataFrame) -> DataFrame:
    return locks.where((F.col("status") == "GRANT") & F.col("mode").startswith("Sch-M") & (F.col("resource") == "OBJECT"))
