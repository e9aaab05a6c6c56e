"""Registered queries of the library, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import view, with_views
from .operators import blocking as b
from .operators import changes as c
from .operators import fleet
from .operators import maintenance as m
from .operators import pressure as p
from .operators import reports as r
from .operators import waits as w
from .plans.analysis import analyze
from .sources import catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RULES = [{"login": "login1$"}, {"program": "^app3", "after": 90}, {"spid": 7}, {"statement": "p4$|^view t5", "host": "host2"}]
RULE_SQL = "CASE WHEN regexp_matches(login, 'login1$') THEN 0 WHEN regexp_matches(program, '^app3') THEN 1 WHEN spid = 7 THEN 2 WHEN (regexp_matches(statement, 'p4$|^view t5') OR regexp_matches(batch, 'p4$|^view t5')) AND host LIKE '%host2%' THEN 3 END"
SESSION = "server, poll_ts, spid, login, host, program, command, status, blocking_spid, wait_ms"
VICTIMS = "SELECT s.*, run_spid FROM session_snapshots s JOIN runs r ON s.server = r.server AND s.poll_ts = r.poll_ts AND s.blocking_spid = r.run_spid AND run_spid <> 0"


def query(views: str, sql: str | None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        names = views.split()
        QUERIES[key] = lambda spark, sf_dir: f(*(view(spark, sf_dir, n) for n in names))
        if sql:
            ORACLES[key] = with_views(views, sql)
        return f

    return add


def on_tables(*tables: str, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


STEPS = """SELECT * FROM (SELECT poll_ts, spid, wait_type, wait_time_ms - lag(wait_time_ms, 1, 0) OVER v AS wait_time_ms, waiting_tasks - lag(waiting_tasks, 1, 0) OVER v AS waiting_tasks, max_wait_ms
  FROM wait_snapshots WINDOW v AS (PARTITION BY spid, wait_type ORDER BY poll_ts)) x WHERE wait_time_ms > 0 OR waiting_tasks > 0"""
CATEGORY = "CASE WHEN wait_type LIKE 'LCK_M_%' THEN 'Locking' WHEN wait_type LIKE 'PAGEIOLATCH_%' THEN 'Data I/O' WHEN wait_type = 'WRITELOG' THEN 'Transaction log' WHEN wait_type = 'CXPACKET' THEN 'Parallelism' END"


@query("wait_snapshots", STEPS)
def diff_waits(s):
    return w.wait_steps(s)


@query("wait_snapshots", f"SELECT *, {CATEGORY} AS category FROM ({STEPS}) y WHERE {CATEGORY} IS NOT NULL")
def classify_waits(s):
    return w.classify_waits(w.wait_steps(s))


@query("wait_snapshots", f"""SELECT spid, category, CAST(sum(wait_time_ms) AS BIGINT) AS wait_time_ms, CAST(sum(waiting_tasks) AS BIGINT) AS waiting_tasks,
  CAST(sum(sum(wait_time_ms)) OVER (PARTITION BY spid) AS BIGINT) AS total_ms FROM (SELECT *, {CATEGORY} AS category FROM ({STEPS}) y) z WHERE category IS NOT NULL GROUP BY spid, category""")
def categorize_waits(s):
    return w.categorize_waits(w.wait_steps(s))


def _operations(s):
    return s.groupBy("spid").agg(F.min("poll_ts").alias("t0"), F.max("poll_ts").alias("t1")).select(F.col("spid").alias("op_id"), "spid", (F.col("t0") + F.expr("INTERVAL 10 DAYS")).alias("start_ts"), (F.col("t1") - F.expr("INTERVAL 1 DAY")).alias("end_ts"))


@query("wait_snapshots", f"""SELECT op_id, spid, category, CAST(sum(t) AS BIGINT) AS wait_time_ms, CAST(sum(n) AS BIGINT) AS waiting_tasks, CAST(sum(sum(t)) OVER (PARTITION BY op_id) AS BIGINT) AS total_ms FROM (
  SELECT e.spid AS op_id, e.spid, {CATEGORY.replace("wait_type", "e.wait_type")} AS category, e.wait_time_ms - coalesce(a.wait_time_ms, 0) AS t, e.waiting_tasks - coalesce(a.waiting_tasks, 0) AS n FROM
   (SELECT x.spid, wait_type, max(wait_time_ms) AS wait_time_ms, max(waiting_tasks) AS waiting_tasks FROM wait_snapshots x JOIN (SELECT spid, max(poll_ts) - INTERVAL 1 DAY AS t FROM wait_snapshots GROUP BY spid) o ON x.spid = o.spid AND poll_ts <= t GROUP BY x.spid, wait_type) e
   LEFT JOIN (SELECT x.spid, wait_type, max(wait_time_ms) AS wait_time_ms, max(waiting_tasks) AS waiting_tasks FROM wait_snapshots x JOIN (SELECT spid, min(poll_ts) + INTERVAL 10 DAY AS t FROM wait_snapshots GROUP BY spid) o ON x.spid = o.spid AND poll_ts <= t GROUP BY x.spid, wait_type) a
   ON a.spid = e.spid AND a.wait_type = e.wait_type) z WHERE category IS NOT NULL AND (t > 0 OR n > 0) GROUP BY op_id, spid, category""")
def operation_waits(s):
    return w.operation_waits(s, _operations(s))


@query("wait_snapshots", f"""SELECT spid, max(CASE WHEN wait_type = 'WRITELOG' AND waiting_tasks > 0 THEN wait_time_ms / waiting_tasks END) AS log_ms,
  max(CASE WHEN wait_type LIKE 'PAGEIOLATCH_EX%' AND waiting_tasks > 0 THEN wait_time_ms / waiting_tasks END) AS read_ms FROM ({STEPS}) x GROUP BY spid""")
def latency_gate(s):
    return w.latency_gate(w.wait_steps(s))


@query("session_snapshots runs", f"SELECT {SESSION}, run_spid FROM ({VICTIMS}) x")
def direct_victims(s, runs):
    return b.direct_victims(s, runs).select(*SESSION.split(", "), "run_spid")


@query("session_snapshots runs", """SELECT m.server, m.poll_ts, m.blocking_spid AS blocker_spid, m.spid, m.wait_ms, b.login AS blocker_login, b.program AS blocker_program, CASE WHEN b.statement = '' THEN b.batch ELSE b.statement END AS blocker_query
  FROM session_snapshots m JOIN runs r ON m.server = r.server AND m.poll_ts = r.poll_ts AND m.spid = r.run_spid LEFT JOIN session_snapshots b ON b.server = m.server AND b.poll_ts = m.poll_ts AND b.spid = m.blocking_spid WHERE m.blocking_spid <> 0""")
def self_block(s, runs):
    return b.self_block(s, runs)


CLOSURE = """closure AS (SELECT server, poll_ts, blocking_spid AS root, spid AS node FROM session_snapshots WHERE blocking_spid <> 0
  UNION SELECT c.server, c.poll_ts, c.root, s.spid FROM closure c JOIN session_snapshots s ON s.server = c.server AND s.poll_ts = c.poll_ts AND s.blocking_spid = c.node)"""


def _recursive(sql: str) -> str:
    """The closure beside the views, before the statement itself."""
    return sql.replace("WITH session_snapshots", "WITH RECURSIVE session_snapshots", 1).replace(" /*closure*/", f", {CLOSURE}", 1)


QUERIES["blocked_behind"] = lambda spark, sf_dir: b.blocked_behind(view(spark, sf_dir, "session_snapshots"))
ORACLES["blocked_behind"] = _recursive(with_views("session_snapshots", "/*closure*/ SELECT server, poll_ts, root AS spid, count(DISTINCT node) AS behind FROM closure WHERE node <> root GROUP BY server, poll_ts, root"))


@query("session_snapshots", "SELECT server, poll_ts, count(*) FILTER (WHERE lower(status) <> 'sleeping') AS active FROM session_snapshots GROUP BY server, poll_ts")
def active_request_count(s):
    return b.active_request_count(s)


@query("session_snapshots", f"SELECT {SESSION} FROM session_snapshots WHERE {RULE_SQL} IS NOT NULL")
def match_session_rules(s):
    return b.match_session_rules(s, RULES).select(*SESSION.split(", "))


@query("session_snapshots", f"SELECT server, poll_ts, spid, rule, CASE WHEN rule = 1 THEN 90 WHEN rule IS NOT NULL THEN 60 END AS delay FROM (SELECT *, {RULE_SQL} AS rule FROM session_snapshots) x")
def first_matching_rule(s):
    return b.first_matching_rule(s, RULES).select("server", "poll_ts", "spid", "rule", "delay")


@query("session_snapshots runs", f"""SELECT r.server, r.poll_ts, v.poll_ts IS NOT NULL AS any_blocked, coalesce(v.u, false) AS unignored FROM (SELECT DISTINCT server, poll_ts FROM runs) r
  LEFT JOIN (SELECT server, poll_ts, bool_or({RULE_SQL} IS NULL) AS u FROM ({VICTIMS}) x GROUP BY server, poll_ts) v ON r.server = v.server AND r.poll_ts = v.poll_ts""")
def block_state(s, runs):
    return b.block_state(s, runs, RULES)


@query("session_snapshots runs", f"""SELECT server, poll_ts, spid FROM ({VICTIMS}) v WHERE NOT EXISTS (SELECT 1 FROM session_snapshots a WHERE a.spid % 3 = 0 AND a.first_event % 2 = 0 AND a.server = v.server AND a.spid = v.spid AND a.poll_ts <= v.poll_ts
  AND (a.first_event % 5 = 0 OR v.poll_ts < a.poll_ts + INTERVAL 1 HOUR + INTERVAL 15 SECOND))""")
def suppress_recent(s, runs):
    done = F.when(F.col("first_event") % 5 != 0, F.col("poll_ts") + F.expr("INTERVAL 1 HOUR"))
    a = s.where("spid % 3 = 0").select("server", "spid", F.col("poll_ts").alias("action_ts"), done.alias("done_ts"), (F.col("first_event") % 2 != 0).alias("failed"))
    return b.suppress_recent(b.direct_victims(s, runs), a).select("server", "poll_ts", "spid")


@query("session_snapshots", "SELECT server, poll_ts, spid, command IN ('ALTER INDEX', 'DBCC') AS is_maintenance, command IN ('ALTER INDEX', 'DBCC') OR command LIKE 'UPDATE STATISTIC%' AS is_amplifying FROM session_snapshots")
def classify_commands(s):
    return b.classify_commands(s).select("server", "poll_ts", "spid", "is_maintenance", "is_amplifying")


IDENTITY = r"CASE WHEN program LIKE 'SQLAgent%' THEN concat('job:', lower(regexp_extract(program, 'Job 0x([0-9A-Fa-f]+)', 1)), ':', regexp_extract(program, 'Step (\d+)', 1)) ELSE concat('sess:', login, '|', host, '|', program) END"


@query("session_snapshots", f"SELECT server, poll_ts, spid, {IDENTITY} AS identity FROM session_snapshots")
def offender_identity(s):
    return b.offender_identity(s).select("server", "poll_ts", "spid", "identity")


@query("session_snapshots", f"""SELECT server, identity, bucket, CAST(sum(CASE WHEN last = prev_ts AND gap <= 7200 THEN gap ELSE 0 END) AS BIGINT) AS debt_s, count(*) AS polls, min(poll_ts) AS first_seen, max(poll_ts) AS last_seen FROM (
  SELECT *, coalesce(sum(CASE WHEN gap > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY server, identity ORDER BY poll_ts), 0) AS bucket FROM (
   SELECT o.server, o.identity, o.poll_ts, q.prev_ts, lag(o.poll_ts) OVER v AS last, CAST(epoch(o.poll_ts) - epoch(lag(o.poll_ts) OVER v) AS BIGINT) AS gap
   FROM (SELECT DISTINCT server, {IDENTITY} AS identity, poll_ts FROM session_snapshots WHERE blocking_spid <> 0) o
   JOIN (SELECT server, poll_ts, lag(poll_ts) OVER (PARTITION BY server ORDER BY poll_ts) AS prev_ts FROM (SELECT DISTINCT server, poll_ts FROM session_snapshots) d) q ON o.poll_ts = q.poll_ts AND o.server = q.server
   WINDOW v AS (PARTITION BY o.server, identity ORDER BY o.poll_ts)) x) y GROUP BY server, identity, bucket""".replace("coalesce(sum(CASE", "CAST(coalesce(sum(CASE").replace("ORDER BY poll_ts), 0) AS bucket", "ORDER BY poll_ts), 0) AS BIGINT) AS bucket"))
def offender_debt(s):
    return b.offender_debt(b.offender_identity(s.where("blocking_spid <> 0")), s, idle_s=7200)


@query("session_snapshots runs", f"""SELECT *, row_number() OVER (PARTITION BY server ORDER BY first_seen, spid, login, host, program, command) AS seq FROM (
  SELECT server, spid, login, host, program, command, min(poll_ts) AS first_seen, max(poll_ts) AS last_seen, count(*) AS times_seen FROM ({VICTIMS}) v WHERE {RULE_SQL} IS NULL GROUP BY server, spid, login, host, program, command) x""")
def blocker_capture(s, runs):
    return b.blocker_capture(b.first_matching_rule(b.direct_victims(s, runs), RULES).where("rule IS NULL"))


@query("session_snapshots runs", f"""SELECT o.server, o.op_id, coalesce(max(n), 0) AS peak FROM (SELECT server, concat(run_spid, '/', extract(day FROM poll_ts)) AS op_id, run_spid, min(poll_ts) AS a, max(poll_ts) AS z FROM runs GROUP BY server, run_spid, extract(day FROM poll_ts)) o
  LEFT JOIN (SELECT server, run_spid, poll_ts, count(*) AS n FROM ({VICTIMS}) v GROUP BY server, run_spid, poll_ts) v ON v.server = o.server AND v.run_spid = o.run_spid AND v.poll_ts BETWEEN o.a AND o.z GROUP BY o.server, o.op_id""")
def peak_blocked(s, runs):
    day = F.dayofmonth("poll_ts")
    o = runs.groupBy("server", "run_spid", day.alias("day")).agg(F.min("poll_ts").alias("start_ts"), F.max("poll_ts").alias("end_ts")).withColumn("op_id", F.concat("run_spid", F.lit("/"), "day"))
    return b.peak_blocked(b.direct_victims(s, runs), o)


@query("session_snapshots runs", f"SELECT server, spid, login, program, min(poll_ts) AS first_seen FROM ({VICTIMS}) v WHERE {RULE_SQL} IS NOT NULL GROUP BY server, spid, login, program")
def held_through(s, runs):
    return b.held_through(b.direct_victims(s, runs), RULES)


BLOCKERS = """SELECT server, blocking_spid, min_by(login, CASE WHEN there THEN poll_ts END) AS login, min_by(host, CASE WHEN there THEN poll_ts END) AS host, count(*) FILTER (WHERE was <> blocking_spid) AS episodes, CAST(coalesce(sum(ms), 0) AS BIGINT) AS blocked_ms, min(poll_ts) AS first_seen FROM (
  SELECT x.*, q.login, q.host, q.spid IS NOT NULL AS there FROM (
   SELECT s.server, s.poll_ts, s.blocking_spid, CAST((epoch(lead(s.poll_ts) OVER v) - epoch(s.poll_ts)) * 1000 AS BIGINT) AS ms, lag(s.blocking_spid, 1, 0) OVER v AS was
   FROM session_snapshots s JOIN runs r ON s.server = r.server AND s.poll_ts = r.poll_ts AND s.spid = r.run_spid WINDOW v AS (PARTITION BY s.server ORDER BY s.poll_ts)) x
  LEFT JOIN session_snapshots q ON q.server = x.server AND q.poll_ts = x.poll_ts AND q.spid = x.blocking_spid WHERE x.blocking_spid <> 0) y GROUP BY server, blocking_spid"""


@query("session_snapshots runs", BLOCKERS)
def suspension_episodes(s, runs):
    return b.suspension_episodes(s, runs)


@query("session_snapshots runs", f"""SELECT *, row_number() OVER (PARTITION BY server ORDER BY first_seen, who) AS seq FROM (
  SELECT server, CASE WHEN coalesce(trim(login), '') = '' THEN 'unknown' ELSE login END AS who, CAST(sum(episodes) AS BIGINT) AS episodes, CAST(sum(blocked_ms) AS BIGINT) AS blocked_ms, min(first_seen) AS first_seen FROM ({BLOCKERS}) z GROUP BY 1, 2) g""")
def suspension_roster(s, runs):
    return b.suspension_roster(b.suspension_episodes(s, runs))


@query("session_snapshots runs", f"""SELECT z.server, CASE WHEN coalesce(login, '') = '' THEN concat('spid:', blocking_spid) ELSE login END AS who, string_agg(CAST(blocking_spid AS VARCHAR), ',' ORDER BY first_seen, blocking_spid) AS spids, count(*) AS sessions,
  CAST(sum(episodes) AS BIGINT) AS episodes, CAST(sum(blocked_ms) AS BIGINT) AS blocked_ms, CAST(coalesce(sum(a.n), 0) AS BIGINT) AS actions FROM ({BLOCKERS}) z
  LEFT JOIN (SELECT server, spid, count(*) AS n FROM session_snapshots WHERE wait_ms > 9000 GROUP BY server, spid) a ON a.server = z.server AND a.spid = z.blocking_spid GROUP BY 1, 2""")
def suspension_groups(s, runs):
    return b.suspension_groups(b.suspension_episodes(s, runs), s.where("wait_ms > 9000"))


@query("session_snapshots", f"SELECT server, CASE WHEN program LIKE 'SQLAgent%' THEN {IDENTITY} ELSE program END AS source, count(*) AS actions, min(poll_ts) AS first_seen FROM session_snapshots WHERE wait_ms > 5000 GROUP BY 1, 2")
def amplifier_sources(s):
    return b.amplifier_sources(b.offender_identity(s.where("wait_ms > 5000")))


USED = "CAST(floor(total_bytes * used_percent / 100) AS BIGINT)"


@query("log_samples", f"SELECT server, poll_ts, {USED} AS used_bytes FROM log_samples")
def log_usage(s):
    return p.log_usage(s).select("server", "poll_ts", "used_bytes")


@query("log_samples", f"SELECT server, poll_ts, used_percent, concat_ws(',', CASE WHEN {USED} >= 90000000000 THEN 'bytes' END, CASE WHEN floor(used_percent) >= 80 THEN 'percent' END) AS fired FROM log_samples WHERE {USED} >= 90000000000 OR floor(used_percent) >= 80")
def log_breach(s):
    return p.log_breach(s, 90_000_000_000, 80).select("server", "poll_ts", "used_percent", "fired")


def _latch(value, fire, rearm, order, source):
    return f"""SELECT server, poll_ts, {value} AS reading FROM (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY server ORDER BY poll_ts, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM (
      SELECT *, CASE WHEN {value} >= {fire} THEN 'F' WHEN {value} < {rearm} THEN 'R' END AS mark FROM {source}) x) y WHERE mark = 'F' AND (was IS NULL OR was <> 'F')"""


@query("log_samples", _latch("used_percent", 90, 85, "used_percent", "log_samples"))
def log_full_alarm(s):
    return p.log_full_alarm(s).select("server", "poll_ts", F.col("used_percent").alias("reading"))


@query("log_samples", _latch("(runnable_tasks / schedulers)", 1.0, 0.5, "runnable_tasks", "(SELECT * FROM log_samples WHERE schedulers > 0)"))
def cpu_pressure_alarm(s):
    return p.cpu_pressure_alarm(s).select("server", "poll_ts", F.col("ratio").alias("reading"))


@query("log_samples", f"""SELECT op_id, server, used_bytes, reuse_wait, poll_ts FROM (SELECT o.server AS op_id, s.server, {USED} AS used_bytes, reuse_wait, poll_ts, row_number() OVER (PARTITION BY o.server ORDER BY {USED} DESC, poll_ts, reuse_wait DESC) AS rn
  FROM log_samples s JOIN (SELECT server, min(poll_ts) + INTERVAL 1 DAY AS a, min(poll_ts) + INTERVAL 9 DAY AS b FROM log_samples GROUP BY server) o ON s.server = o.server AND poll_ts BETWEEN a AND b) x WHERE rn = 1""")
def log_peak(s):
    o = s.groupBy("server").agg(F.min("poll_ts").alias("t")).select(F.col("server").alias("op_id"), "server", (F.col("t") + F.expr("INTERVAL 1 DAY")).alias("start_ts"), (F.col("t") + F.expr("INTERVAL 9 DAYS")).alias("end_ts"))
    return p.log_peak(s, o)


@query("log_samples", "SELECT server, poll_ts, runnable_tasks, schedulers, CASE WHEN schedulers > 0 THEN runnable_tasks / schedulers END AS load FROM (SELECT *, row_number() OVER (PARTITION BY server ORDER BY poll_ts DESC, runnable_tasks DESC, schedulers DESC) AS rn FROM log_samples) x WHERE rn = 1")
def server_load(s):
    return p.server_load(s)


@query("log_samples", """SELECT server, start_ts, min(poll_ts) AS fired_ts FROM (SELECT *, min(poll_ts) OVER (PARTITION BY server, island) AS start_ts FROM (
  SELECT *, sum(CASE WHEN used_percent >= 40 THEN 0 ELSE 1 END) OVER (PARTITION BY server ORDER BY poll_ts) AS island FROM (SELECT server, poll_ts, max(used_percent) AS used_percent FROM log_samples GROUP BY server, poll_ts) g) x WHERE used_percent >= 40) y
  WHERE floor(epoch(poll_ts)) - floor(epoch(start_ts)) >= 3600 GROUP BY server, island, start_ts""")
def blocking_debounce(s):
    g = s.groupBy("server", "poll_ts").agg((F.max("used_percent") >= 40).alias("over"))
    return p.blocking_debounce(g, "over", 3600, ["server"])


@query("log_samples", "SELECT server, poll_ts, CASE WHEN NOT (runnable_tasks > 20) AND NOT (used_percent >= 80) AND NOT (schedulers = 0) THEN 'continue' WHEN schedulers = 0 THEN 'cancel' WHEN reuse_wait = 'NOTHING' THEN 'pause' ELSE 'cancel' END AS action, concat_ws(',', CASE WHEN schedulers = 0 THEN 'blind' END, CASE WHEN runnable_tasks > 26 THEN 'cap' END, CASE WHEN runnable_tasks > 20 THEN 'blocking' END, CASE WHEN used_percent >= 80 THEN 'log' END) AS detail FROM log_samples")
def decide_reaction(s):
    d = s.select("server", "poll_ts", (F.col("runnable_tasks") > 20).alias("blocked"), (F.col("used_percent") >= 80).alias("log_over"), (F.col("schedulers") == 0).alias("blind"), (F.col("reuse_wait") == "NOTHING").alias("resumable"), (F.col("runnable_tasks") > 26).alias("capped"))
    return p.decide_reaction(d).select("server", "poll_ts", "action", "detail")


@query("log_samples", """SELECT a.server, a.poll_ts AS pause_ts, min(f.poll_ts) AS relief_ts, CAST(floor(epoch(min(f.poll_ts))) - floor(epoch(a.poll_ts)) AS BIGINT) AS relief_s,
  CASE WHEN (SELECT count(*) FROM log_samples g WHERE g.server = a.server AND g.poll_ts > a.poll_ts AND floor(epoch(g.poll_ts)) - floor(epoch(a.poll_ts)) < 7200) = 0 THEN 'blind'
    WHEN (SELECT count(*) FROM log_samples g WHERE g.server = a.server AND g.poll_ts > a.poll_ts AND NOT g.used_percent >= 80 AND floor(epoch(g.poll_ts)) - floor(epoch(a.poll_ts)) <= 3600) = 0 THEN 'drain' WHEN min(f.poll_ts) IS NOT NULL THEN 'relief' END AS ended FROM (SELECT DISTINCT server, poll_ts FROM log_samples WHERE used_percent >= 95) a
  LEFT JOIN log_samples f ON f.server = a.server AND f.poll_ts > a.poll_ts AND NOT f.runnable_tasks > 20 AND NOT f.used_percent >= 80 GROUP BY a.server, a.poll_ts""")
def time_to_relief(s):
    q = s.select("server", "poll_ts", (F.col("runnable_tasks") > 20).alias("blocked"), (F.col("used_percent") >= 80).alias("log_over"))
    return p.time_to_relief(s.where("used_percent >= 95").select("server", F.col("poll_ts").alias("pause_ts")).distinct(), q, 3600, 7200)


GOOD = "SELECT server, poll_ts, min(schedulers) AS s, max(used_percent) AS u FROM log_samples GROUP BY server, poll_ts"


@query("log_samples", f"""SELECT server, poll_ts, last_value(CASE WHEN s = 0 THEN NULL ELSE u END IGNORE NULLS) OVER (PARTITION BY server ORDER BY poll_ts ROWS UNBOUNDED PRECEDING) AS used FROM ({GOOD}) x""")
def merge_channels(s):
    g = s.groupBy("server", "poll_ts").agg(F.min("schedulers").alias("s"), F.max("used_percent").alias("u"))
    return p.merge_channels(g.where("s > 0").select("server", "poll_ts", F.col("u").alias("used")), g.where("s = 0").select("server", "poll_ts"), ["server"])


@query("log_samples", f"""SELECT server, poll_ts, event, missed FROM (SELECT server, poll_ts, f, was, CASE WHEN f AND NOT was THEN 'failed' WHEN NOT f AND was THEN 'recovered' END AS event, CASE WHEN f THEN 0 ELSE n - lag_n END AS missed FROM (
   SELECT *, lag(f, 1, false) OVER v AS was, row_number() OVER v - 1 AS n, coalesce(max(CASE WHEN NOT f THEN rn END) OVER (PARTITION BY server ORDER BY poll_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lag_n FROM (
     SELECT *, s = 0 AS f, row_number() OVER (PARTITION BY server ORDER BY poll_ts) AS rn FROM ({GOOD}) g) x WINDOW v AS (PARTITION BY server ORDER BY poll_ts)) y) z WHERE event IS NOT NULL""")
def channel_outages(s):
    g = s.groupBy("server", "poll_ts").agg((F.min("schedulers") == 0).alias("failed"))
    return p.channel_outages(g, ["server"])


@query("log_samples", f"""SELECT server, last_ok_ts, last_ok_ts + limit_s * INTERVAL 1 SECOND AS blind_ts, recovered_ts, silent_s FROM (
  SELECT server, poll_ts AS last_ok_ts, back AS recovered_ts, greatest(7200, 2 * c) AS limit_s, CAST(floor(epoch(coalesce(back, TIMESTAMP '2024-02-01'))) - floor(epoch(poll_ts)) AS BIGINT) AS silent_s
  FROM (SELECT *, CASE server WHEN 'srv1' THEN 9000 ELSE 60 END AS c, lead(poll_ts) OVER (PARTITION BY server ORDER BY poll_ts) AS back FROM ({GOOD}) g WHERE s > 0 AND NOT (server = 'srv2' AND poll_ts > TIMESTAMP '2024-01-20')) x) y WHERE silent_s >= limit_s""")
def blind_channels(s):
    g = s.groupBy("server", "poll_ts").agg((F.min("schedulers") <= 0).alias("failed")).where("NOT (server = 'srv2' AND poll_ts > TIMESTAMP_NTZ '2024-01-20')")
    return p.blind_channels(g.withColumn("cadence_s", F.when(F.col("server") == "srv1", 9000).otherwise(60)), ["server"], F.expr("TIMESTAMP_NTZ '2024-02-01'"), 7200)


@query("wait_snapshots", """SELECT spid, wait_type, poll_ts, CASE WHEN dv >= 0 AND dt > 0 THEN dv / dt END AS rate FROM (SELECT *, CAST(wait_time_ms - lag(wait_time_ms) OVER v AS DOUBLE) AS dv, CAST(floor(epoch(poll_ts)) - floor(epoch(lag(poll_ts) OVER v)) AS BIGINT) AS dt FROM wait_snapshots WINDOW v AS (PARTITION BY spid, wait_type ORDER BY poll_ts)) x""")
def counter_rate(s):
    return p.counter_rate(s, "wait_time_ms", ["spid", "wait_type"]).select("spid", "wait_type", "poll_ts", "rate")


@query("log_samples", "SELECT server, poll_ts FROM log_samples WHERE (extract(hour FROM poll_ts) * 60 + extract(minute FROM poll_ts) >= 1350 AND extract(dow FROM poll_ts) IN (0, 6)) OR (extract(hour FROM poll_ts) * 60 + extract(minute FROM poll_ts) < 300 AND (extract(dow FROM poll_ts) + 6) % 7 IN (0, 6))")
def window_filter(s):
    return p.window_filter(s, "poll_ts", "22:30", "05:00", [1, 7]).select("server", "poll_ts")


MEASURED = """SELECT i.server, i.database, i.object_id, i.schema_name, i.table_name, i.index_id, i.index_name, i.part_key, CAST(sum(CAST(floor(size_mb) AS BIGINT)) AS BIGINT) AS size_mb, CAST(sum(page_count) AS BIGINT) AS page_count, max(fragmentation) AS fragmentation, min_by(compression, i.partition_number) AS compression
  FROM object_inventory i LEFT JOIN physical_stats p ON i.server = p.server AND i.database = p.database AND i.part_key = p.part_key AND i.partition_number = p.partition_number WHERE type IN (1, 2) GROUP BY ALL"""


@query("object_inventory physical_stats", MEASURED.replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5, 6, 7, 8"))
def index_measurements(i, ph):
    return m.index_measurements(i, ph)


HEAPS = """SELECT g.*, f.forwarded, f.records, f.fragmentation, f.density, heap_mb + index_mb AS rewrite_mb FROM (SELECT server, database, object_id, schema_name, table_name, CAST(sum(CASE WHEN type = 0 THEN CAST(floor(size_mb) AS BIGINT) END) AS BIGINT) AS heap_mb,
   CAST(coalesce(sum(CASE WHEN type <> 0 THEN CAST(floor(size_mb) AS BIGINT) END), 0) AS BIGINT) AS index_mb, count(DISTINCT CASE WHEN type <> 0 THEN index_id END) AS indexes FROM object_inventory GROUP BY 1, 2, 3, 4, 5) g
  LEFT JOIN (SELECT i.server, i.database, i.object_id, CAST(sum(forwarded_count) AS BIGINT) AS forwarded, CAST(sum(record_count) AS BIGINT) AS records, max(fragmentation) AS fragmentation, least(min(density), 100.0) AS density FROM object_inventory i JOIN physical_stats p ON i.server = p.server AND i.database = p.database AND i.part_key = p.part_key AND i.partition_number = p.partition_number WHERE type = 0 GROUP BY 1, 2, 3) f
  ON g.server = f.server AND g.database = f.database AND g.object_id = f.object_id WHERE heap_mb >= 100"""


@query("object_inventory physical_stats", HEAPS)
def heap_measurements(i, ph):
    return m.heap_measurements(i, ph, 100)


PROFILE = m.Profile(max_rebuild_mb=1500, overrides=(("dbo.T?", "skip"), ("dbo.T1*", "no_rebuild"), ("dbo.t2*", "PAGE")), heap_min_mb=100)
OVERRIDE = "CASE WHEN regexp_matches(table_name, '^T.$') THEN 'skip' WHEN table_name LIKE 'T1%' THEN 'no_rebuild' WHEN table_name LIKE 'T2%' THEN 'PAGE' END"
DECIDED = f"""SELECT server, database, object_id, schema_name, table_name, index_name, size_mb, CASE WHEN ov = 'skip' OR fragmentation IS NULL OR page_count < 1000 THEN 'skip' WHEN want AND NOT barred THEN 'rebuild' WHEN fragmentation >= 5 THEN 'reorganize' ELSE 'skip' END AS kind,
   CASE WHEN ov = 'skip' OR fragmentation IS NULL OR page_count < 1000 THEN NULL WHEN want AND NOT barred THEN CASE WHEN fragmentation >= 30 THEN 'fragmentation' ELSE 'compression' END WHEN fragmentation >= 5 THEN 'fragmentation' END AS intent,
   CASE WHEN NOT (ov = 'skip') IS TRUE AND fragmentation IS NOT NULL AND page_count >= 1000 AND want AND NOT barred THEN target END AS target,
   CASE WHEN ov = 'skip' THEN 'override' WHEN fragmentation IS NULL THEN 'not measured' WHEN page_count < 1000 THEN 'too small' WHEN want AND barred THEN 'rebuild not allowed' WHEN fragmentation >= 30 THEN 'fragmented' WHEN want THEN 'compression' WHEN fragmentation >= 5 THEN 'slightly fragmented' ELSE 'healthy' END AS reason
  FROM (SELECT *, fragmentation >= 30 OR target IS NOT NULL AS want, coalesce(ov = 'no_rebuild', false) OR size_mb > 1500 AS barred FROM (SELECT *, CASE WHEN ov = 'PAGE' AND compression <> 'PAGE' THEN 'PAGE' END AS target FROM (SELECT *, {OVERRIDE} AS ov FROM ({MEASURED.replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5, 6, 7, 8")}) a) b) b2) c"""


@query("object_inventory physical_stats", DECIDED)
def decide_index(i, ph):
    d = m.match_overrides(m.index_measurements(i, ph), PROFILE.overrides).withColumn("target", F.when((F.col("override") == "PAGE") & (F.col("compression") != "PAGE"), "PAGE"))
    return m.decide_index(d, PROFILE).select("server", "database", "object_id", "schema_name", "table_name", "index_name", "size_mb", "kind", "intent", "target", "reason")


HEAP_DECIDED = f"""SELECT server, database, object_id, schema_name, table_name, heap_mb, CASE WHEN gate IS NULL AND hit IS NOT NULL THEN 'rebuild_heap' ELSE 'skip' END AS kind, coalesce(gate, hit, 'healthy') AS reason FROM (
  SELECT *, CASE WHEN {OVERRIDE} = 'skip' THEN 'override' WHEN {OVERRIDE} = 'no_rebuild' THEN 'rebuild not allowed' WHEN heap_mb < 100 THEN 'too small' WHEN object_id % 9 = 0 THEN 'would re-enable IX_a, IX_b' WHEN records IS NULL THEN 'not measured' END AS gate,
   CASE WHEN 100 * forwarded / nullif(records, 0) >= 10 THEN 'forwarded records' WHEN fragmentation >= 30 THEN 'fragmented' WHEN 100 - density >= 30 THEN 'free space' END AS hit FROM ({HEAPS}) h) x"""


def _disabled(i):
    return i.where("object_id % 9 = 0").select("server", "database", "object_id", F.array(F.lit("IX_a"), F.lit("IX_b")).alias("names")).distinct()


@query("object_inventory physical_stats", HEAP_DECIDED)
def decide_heap(i, ph):
    return m.decide_heap(m.match_overrides(m.heap_measurements(i, ph, 100, disabled=_disabled(i)), PROFILE.overrides), PROFILE).select("server", "database", "object_id", "schema_name", "table_name", "heap_mb", "kind", "reason")


#: Compression measures of a whole index, or of each partition of one that has several.
def _grain(part):
    return f"CASE WHEN {part} THEN partition_number END"


def _estimate_sql(several):
    return f"""SELECT server, database, object_id, index_id, pn, CAST(sum(c) AS BIGINT) AS cur, CAST(sum(floor(c * (part_key % 10) / 10)) AS BIGINT) AS row_kb, CAST(sum(floor(c * (part_key % 7) / 10)) AS BIGINT) AS page_kb, CAST(sum(40 * (part_key % 5 + part_key % 7)) AS BIGINT) AS w, CAST(sum(40 * (part_key % 11 + part_key % 4)) AS BIGINT) AS r
      FROM (SELECT *, {several} AS pn, floor(size_mb * 1024) AS c FROM object_inventory) s GROUP BY 1, 2, 3, 4, 5"""


TIER = """CASE WHEN ov IN ('NONE', 'ROW', 'PAGE') THEN ov WHEN compression = 'PAGE' OR cur IS NULL THEN NULL ELSE CASE WHEN row_kb > 0 AND 100 * (row_kb - page_kb) / row_kb >= 10 AND cur > 0 AND 100 * (cur - page_kb) / cur >= 10
  THEN CASE WHEN w + r >= 100 AND w / (w + r) >= 0.3 THEN 'ROW' ELSE 'PAGE' END WHEN cur > 0 AND 100 * (cur - row_kb) / cur >= 10 THEN 'ROW' END END"""


def _plan_sql(several):
    """Index and heap decisions with estimates; several: the partition number where an index has several and they are asked for."""
    measured = f"""SELECT server, database, schema_name, table_name, index_name AS name, object_id, index_id, pn, CAST(sum(CAST(floor(size_mb) AS BIGINT)) AS BIGINT) AS size_mb, CAST(sum(page_count) AS BIGINT) AS pages, max(fragmentation) AS frag, min_by(compression, partition_number) AS compression
      FROM (SELECT i.*, {several} AS pn, p.page_count, p.fragmentation FROM (SELECT *, count(*) OVER (PARTITION BY server, database, part_key) AS parts FROM object_inventory) i LEFT JOIN physical_stats p ON i.server = p.server AND i.database = p.database AND i.part_key = p.part_key AND i.partition_number = p.partition_number WHERE type IN (1, 2)) x GROUP BY 1, 2, 3, 4, 5, 6, 7, 8"""
    measured = measured.replace("CASE WHEN parts > 1 THEN partition_number END", "CASE WHEN parts > 1 THEN i.partition_number END")
    whole = several.startswith("CAST(NULL")
    estimates = _estimate_sql("CAST(NULL AS INTEGER)") if whole else f"{_estimate_sql('CAST(NULL AS INTEGER)')} UNION ALL {_estimate_sql('partition_number')}"
    return f"""SELECT server, database, schema_name, table_name, name, 'index' AS category, CASE WHEN ov = 'skip' OR frag IS NULL OR pages < 1000 THEN 'skip' WHEN want AND NOT barred THEN 'rebuild' WHEN frag >= 5 THEN 'reorganize' ELSE 'skip' END AS kind, pn AS partition_number,
      CASE WHEN ov = 'skip' THEN 'override' WHEN frag IS NULL THEN 'not measured' WHEN pages < 1000 THEN 'too small' WHEN want AND barred THEN 'rebuild not allowed' WHEN frag >= 30 THEN 'fragmented' WHEN want THEN 'compression' WHEN frag >= 5 THEN 'slightly fragmented' ELSE 'healthy' END AS reason, frag, CASE WHEN NOT (ov = 'skip') IS TRUE AND pages >= 1000 AND frag IS NOT NULL AND want AND NOT barred THEN target END AS target, size_mb
     FROM (SELECT *, frag >= 30 OR target IS NOT NULL AS want, coalesce(ov = 'no_rebuild', false) OR size_mb > 1500 AS barred FROM (SELECT *, CASE WHEN {TIER} <> compression THEN {TIER} END AS target FROM (
      SELECT m.*, {OVERRIDE} AS ov, cur, row_kb, page_kb, w, r FROM ({measured}) m LEFT JOIN ({estimates}) e ON m.server = e.server AND m.database = e.database AND m.object_id = e.object_id AND m.index_id = e.index_id AND m.pn IS NOT DISTINCT FROM e.pn) a) b) c
     UNION ALL SELECT h.server, h.database, h.schema_name, h.table_name, 'heap', 'heap', h.kind, CAST(NULL AS INTEGER), h.reason, CAST(NULL AS DOUBLE), CASE WHEN h.kind = 'rebuild_heap' AND {TIER} <> compression THEN {TIER} END, h.heap_mb FROM (
      SELECT d.*, {OVERRIDE} AS ov, compression, cur, row_kb, page_kb, w, r FROM ({HEAP_DECIDED}) d JOIN (SELECT server, database, object_id AS o, min_by(compression, partition_number) AS compression FROM object_inventory WHERE type = 0 GROUP BY 1, 2, 3) n ON n.o = d.object_id AND n.server = d.server AND n.database = d.database
      LEFT JOIN ({_estimate_sql("CAST(NULL AS INTEGER)")}) e ON e.server = d.server AND e.database = d.database AND e.object_id = d.object_id AND e.index_id = 0) h
     UNION ALL SELECT server, database, schema_name, table_name, name, 'statistics', CASE WHEN NOT coalesce({OVERRIDE} = 'skip', false) AND mods >= sqrt(1000 * rows) THEN 'update_statistics' ELSE 'skip' END, CAST(NULL AS INTEGER),
      CASE WHEN {OVERRIDE} = 'skip' THEN 'override' WHEN mods >= sqrt(1000 * rows) THEN 'modified' ELSE 'few modifications' END, CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT) FROM ({STATISTICS}) s"""


STATISTICS = "SELECT DISTINCT server, database, schema_name, table_name, index_name AS name, part_key * 100 AS rows, part_key * 13 % 9000 AS mods FROM object_inventory WHERE part_key % 6 <> 0"


def _suppressed(plan):
    gone = """CASE WHEN kind <> 'skip' AND category IN ('index', 'statistics') AND heap THEN 'heap rebuilt' WHEN kind <> 'skip' AND category = 'statistics' AND whole THEN 'index rebuilt' END"""
    return f"""SELECT server, database, schema_name, table_name, name, category, CASE WHEN gone IS NOT NULL THEN 'skip' ELSE kind END AS kind, partition_number, coalesce(gone, reason) AS reason, CASE WHEN gone IS NULL THEN intent END AS intent, CASE WHEN gone IS NULL THEN target END AS target, size_mb FROM (SELECT *, {gone} AS gone FROM (
      SELECT *, CASE WHEN category <> 'index' OR kind = 'skip' THEN NULL WHEN kind = 'reorganize' OR frag >= 30 THEN 'fragmentation' ELSE 'compression' END AS intent,
       bool_or(kind = 'rebuild_heap') OVER (PARTITION BY server, database, lower(table_name)) AS heap, bool_or(kind = 'rebuild' AND partition_number IS NULL) OVER (PARTITION BY server, database, lower(table_name), lower(name)) AS whole FROM ({plan}) p) q) r"""


PLAN_INDEX = _plan_sql("CAST(NULL AS INTEGER)")
CHECKED = "SELECT DISTINCT server, database, CAST(NULL AS VARCHAR) AS schema_name, CAST(NULL AS VARCHAR) AS table_name, database AS name, 'checkdb' AS category, 'check_db' AS kind, CAST(NULL AS INTEGER) AS partition_number, 'scheduled integrity check' AS reason, CAST(NULL AS VARCHAR) AS intent, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS BIGINT) AS size_mb FROM object_inventory"


def _measures(i):
    kb = F.floor(F.col("size_mb") * 1024).cast("long")
    savings = i.select("server", "database", "object_id", "index_id", "partition_number", "part_key", kb.alias("current_kb"), F.explode(F.array(F.lit("ROW"), F.lit("PAGE"))).alias("setting"))
    savings = savings.withColumn("estimated_kb", F.expr("CAST(floor(current_kb * (CASE setting WHEN 'ROW' THEN part_key % 10 ELSE part_key % 7 END) / 10) AS BIGINT)"))
    activity = i.selectExpr("server", "database", "object_id", "index_id", "partition_number", "40 * (part_key % 5) AS inserts", "40 * (part_key % 7) AS updates", "0 AS deletes", "40 * (part_key % 11) AS scans", "40 * (part_key % 4) AS lookups")
    statistics = i.where("part_key % 6 <> 0").selectExpr("server", "database", "schema_name", "table_name", "index_name AS name", "part_key * 100 AS rows", "part_key * 13 % 9000 AS modifications").distinct()
    return {"savings": savings, "activity": activity, "statistics": statistics, "disabled": _disabled(i)}


@query("object_inventory physical_stats", f"{_suppressed(_plan_sql('CAST(NULL AS INTEGER)'))} UNION ALL {CHECKED}", "analyze")
def _analyze(i, ph):
    return analyze(i, ph, PROFILE, **_measures(i))


@query("object_inventory physical_stats", f"{_suppressed(_plan_sql(_grain('parts > 1')))} UNION ALL {CHECKED}", "analyze_partitions")
def _analyze_partitions(i, ph):
    return analyze(i, ph, replace(PROFILE, per_partition=True), **_measures(i))


@query("object_inventory physical_stats", f"SELECT * FROM ({_suppressed(_plan_sql('CAST(NULL AS INTEGER)'))}) x WHERE category = 'statistics' AND reason NOT LIKE '%rebuilt' UNION ALL SELECT * REPLACE ('update_statistics' AS kind, 'modified' AS reason) FROM ({_suppressed(_plan_sql('CAST(NULL AS INTEGER)'))}) x WHERE category = 'statistics' AND reason LIKE '%rebuilt' UNION ALL {CHECKED}", "analyze_statistics")
def _analyze_statistics(i, ph):
    return analyze(i, ph, PROFILE, ("statistics", "checkdb"), **_measures(i))


@query("object_inventory physical_stats", f"SELECT server, database, schema_name, table_name, name, category, 'skip' AS kind, CAST(NULL AS INTEGER) AS partition_number, CASE WHEN reason IN ('override', 'not measured') THEN reason ELSE 'too small' END AS reason, CAST(NULL AS VARCHAR) AS intent, CAST(NULL AS VARCHAR) AS target, size_mb FROM ({_plan_sql('CAST(NULL AS INTEGER)')}) x WHERE category = 'index'", "analyze_compression")
def _analyze_compression(i, ph):
    return analyze(i, ph, PROFILE, ("compression",), **_measures(i))


@query("object_inventory", "SELECT object_id, index_name, partition_number FROM object_inventory WHERE (lower(concat(schema_name, '.', table_name)) LIKE 'dbo.t3%' OR lower(concat(schema_name, '.', table_name, '.', index_name)) LIKE '%ix_77') AND NOT regexp_matches(lower(table_name), '^t3.$')")
def object_scope(i):
    return m.object_scope(i, ("dbo.t3*", "*IX_77"), ("dbo.T3?",)).select("object_id", "index_name", "partition_number")


@query("object_inventory physical_stats", """SELECT i.server, i.database, i.object_id, index_id, type, CAST(coalesce(sum(page_count), 0) AS BIGINT) AS page_count, coalesce(min(CASE WHEN page_count > 0 THEN density END), 100.0) AS density, CAST(sum(CAST(floor(size_mb) AS BIGINT)) AS BIGINT) AS size_mb
  FROM object_inventory i LEFT JOIN physical_stats p ON i.server = p.server AND i.database = p.database AND i.part_key = p.part_key AND i.partition_number = p.partition_number GROUP BY 1, 2, 3, 4, 5""")
def pre_shrink_measures(i, ph):
    return m.pre_shrink_measures(i, ph)


@query("object_inventory", "SELECT server, database, object_id, index_id, target, bool_and(compression = target) AS satisfied FROM (SELECT server, database, object_id, index_id, compression, CASE WHEN object_id % 2 = 0 THEN 'PAGE' ELSE 'ROW' END AS target FROM object_inventory) x GROUP BY 1, 2, 3, 4, 5")
def compression_satisfied(i):
    ops = i.select("server", "database", "object_id", "index_id", F.when(F.col("object_id") % 2 == 0, "PAGE").otherwise("ROW").alias("target")).distinct()
    return m.compression_satisfied(ops, i)


HISTORY = """SELECT concat('srv', o_custkey % 2) AS server, concat('db', o_custkey % 3) AS database, o_orderkey AS plan_id, o_orderdate AS generated_at, concat('dbo.T', o_custkey % 40) AS target,
  CASE WHEN o_orderkey % 5 < 2 THEN 'rebuild' WHEN o_orderkey % 5 = 2 THEN 'rebuild_heap' ELSE 'reorganize' END AS decision, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey % 100 AS DOUBLE) END AS fragmentation,
  CASE o_orderkey % 3 WHEN 0 THEN 'NONE' WHEN 1 THEN 'ROW' ELSE 'PAGE' END AS current_compression, CASE o_orderkey % 4 WHEN 0 THEN 'PAGE' WHEN 1 THEN 'ROW' END AS chosen_compression FROM orders"""
TREND = f"""SELECT server, database, plan_id, target, decision LIKE 'rebuild%' AS r, rebuilds, decision LIKE 'rebuild%' AND rebuilds >= 3 AS oscillates, was = current_compression AS held, generated_at, fragmentation, CASE WHEN secs > 0 THEN (fragmentation - prev.f) * 86400 / secs END AS slope FROM (
  SELECT *, epoch(generated_at) - epoch(prev.t) AS secs FROM (SELECT *, count(*) FILTER (WHERE decision LIKE 'rebuild%') OVER (PARTITION BY server, database, target ORDER BY CAST(epoch(generated_at) AS BIGINT) RANGE BETWEEN 2592000 PRECEDING AND CURRENT ROW) AS rebuilds,
   last_value(chosen_compression IGNORE NULLS) OVER w AS was, last_value(CASE WHEN fragmentation IS NOT NULL THEN {{'t': generated_at, 'f': fragmentation}} END IGNORE NULLS) OVER w AS prev
   FROM ({HISTORY}) h WINDOW w AS (PARTITION BY server, database, target ORDER BY generated_at, plan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x) y"""


def _history(o):
    o.createOrReplaceTempView("orders")
    return o.sparkSession.sql(HISTORY)


@on_tables("orders", sql=f"SELECT server, database, plan_id, rebuilds, oscillates, held, slope FROM ({TREND}) t")
def trend_report(o):
    return m.trend_report(_history(o)).select("server", "database", "plan_id", "rebuilds", "oscillates", "held", "slope")


@on_tables("orders", sql=f"""SELECT server, database, target, count(*) AS records, count(*) FILTER (WHERE r) AS total_rebuilds, max(rebuilds) AS most_rebuilds, bool_or(oscillates) AS oscillates, count(*) FILTER (WHERE NOT held) AS lost,
  round(regr_slope(fragmentation, epoch(generated_at) / 86400), 6) AS trend FROM ({TREND}) t GROUP BY 1, 2, 3""")
def trend_summary(o):
    return m.trend_summary(_history(o)).withColumn("trend", F.round("trend", 6))


@query("run_history", "SELECT manifest, " + ", ".join(f"count(*) FILTER (WHERE outcome = '{n}') AS {n}" for n in ("done", "failed", "incomplete", "interrupted", "deferred", "skipped")) + " FROM run_history GROUP BY manifest")
def run_summary(runs):
    return r.run_summary(runs)


@query("run_history", "SELECT manifest, sha256(string_agg(concat(outcome, ' ', CAST(duration_ms AS VARCHAR)), chr(10) ORDER BY run_id)) AS fingerprint FROM run_history GROUP BY manifest")
def plan_fingerprint(runs):
    return r.plan_fingerprint(runs.select("manifest", F.col("run_id").alias("op_index"), F.col("outcome").alias("command"), F.col("duration_ms").cast("string").alias("target")))


SET, WHERE = {"o_orderstatus": "X", "o_orderpriority": "0-NONE"}, [("o_totalprice", ">", 200000.0), ("o_orderstatus", "<>", "P")]
HIT = "(o_totalprice > 200000.0 AND o_orderstatus <> 'P' AND (o_orderstatus IS NULL OR o_orderstatus <> 'X' OR o_orderpriority IS NULL OR o_orderpriority <> '0-NONE'))"


@on_tables("orders", sql=f"SELECT o_orderkey, CASE WHEN {HIT} THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN {HIT} THEN '0-NONE' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def batch_update(o):
    return c.batch_update(o, SET, c.where(WHERE))[0].select("o_orderkey", "o_orderstatus", "o_orderpriority")


@on_tables("lineitem", sql="SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT coalesce(l_quantity < 25 AND l_returnflag = 'R', false)")
def batch_delete(li):
    return c.batch_delete(li, c.where([("l_quantity", "<", 25), ("l_returnflag", "=", "R")])).select("l_orderkey", "l_linenumber", "l_quantity")


@on_tables("orders", sql="SELECT CAST(floor((rn - 1) / 500) AS BIGINT) AS batch, min(k) AS lo, max(k) AS hi, count(*) AS rows FROM (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders WHERE o_totalprice > 100000) x GROUP BY 1")
def key_ranges(o):
    return c.key_ranges(o, "o_orderkey", 500, F.col("o_totalprice") > 100000)


@on_tables("orders", sql=f"SELECT o_orderkey, CASE WHEN {HIT} AND o_orderkey > 100 AND o_orderkey <= 5000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def key_range_update(o):
    return c.key_range_update(o, "o_orderkey", 100, 5000, SET, c.where(WHERE))[0].select("o_orderkey", "o_orderstatus")


@on_tables("orders", sql="SELECT 'o_orderkey' AS column_name, count(*) AS rows, count(*) FILTER (WHERE o_orderkey IS NULL) AS nulls, CAST(min(o_orderkey) AS VARCHAR) AS low, CAST(max(o_orderkey) AS VARCHAR) AS high FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(*) FILTER (WHERE o_orderstatus IS NULL), min(o_orderstatus), max(o_orderstatus) FROM orders")
def update_statistics(o):
    return c.update_statistics(o, ["o_orderkey", "o_orderstatus"]).drop("distinct", "median")


@on_tables("lineitem", sql="SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 OR l_orderkey IS NULL")
def add_constraint(li):
    return c.add_constraint(li, ["l_orderkey"])


@on_tables("orders", "customer", sql="""SELECT 'null key' AS rule, count(*) FILTER (WHERE o_orderkey IS NULL) AS bad FROM orders UNION ALL SELECT 'range o_totalprice', count(*) FILTER (WHERE NOT o_totalprice BETWEEN 1000 AND 300000) FROM orders
  UNION ALL SELECT 'repeated key', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) x UNION ALL SELECT 'orphan', count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)""")
def integrity_check(o, cu):
    return c.integrity_check(o, "o_orderkey", {"o_totalprice": (1000, 300000)}, cu, "c_custkey", "o_custkey")


@query("log_samples", f"""SELECT server, CASE WHEN {USED} >= 100000000000 OR floor(used_percent) >= 90 THEN 'FAIL' WHEN reuse_wait <> 'NOTHING' THEN 'WARN' ELSE 'PASS' END AS severity, poll_ts FROM log_samples""")
def check_log(s):
    d = fleet.check_log(s.withColumn("server", F.struct("server", "poll_ts")), 100_000_000_000, 90)
    return d.select("server.server", "severity", "server.poll_ts")


@query("session_snapshots", "SELECT server, poll_ts, count(*) FILTER (WHERE blocking_spid <> 0) AS blocked, CASE WHEN count(*) FILTER (WHERE blocking_spid <> 0) > 0 THEN 'WARN' ELSE 'PASS' END AS severity FROM session_snapshots GROUP BY server, poll_ts")
def check_blocking(s):
    return fleet.check_blocking(s)


@query("object_inventory", """SELECT server, database, object_id, index_id, CASE WHEN index_id = 0 THEN 'heap' ELSE index_name END AS name, was_disabled, before_kb, after_kb FROM (
  SELECT coalesce(b.server, a.server) AS server, coalesce(b.database, a.database) AS database, coalesce(b.object_id, a.object_id) AS object_id, coalesce(b.index_id, a.index_id) AS index_id, coalesce(b.index_name, a.index_name) AS index_name, coalesce(b.off, false) AS was_disabled, coalesce(b.kb, -1) AS before_kb, coalesce(a.kb, -1) AS after_kb
  FROM (SELECT server, database, object_id, index_id, index_name, part_key % 3 = 0 AS off, CAST(floor(size_mb * 1024) AS BIGINT) AS kb FROM object_inventory WHERE partition_number = 1 AND part_key % 4 <> 1) b
  FULL JOIN (SELECT server, database, object_id, index_id, index_name, CAST(floor(size_mb * 512) AS BIGINT) AS kb FROM object_inventory WHERE partition_number = 1 AND compression <> 'NONE') a ON a.server = b.server AND a.database = b.database AND a.object_id = b.object_id AND a.index_id = b.index_id) x""")
def size_lines(i):
    one = i.where("partition_number = 1").withColumnRenamed("index_name", "name").withColumn("is_disabled", F.col("part_key") % 3 == 0)
    kb = lambda k: F.floor(F.col("size_mb") * k).cast("long").alias("kb")
    keys = ["server", "database", "object_id", "index_id"]
    return r.size_lines(one.where("part_key % 4 <> 1").select(*keys, "name", "is_disabled", kb(1024)), one.where("compression <> 'NONE'").select(*keys, "name", "is_disabled", kb(512)), keys)


@query("object_inventory", "SELECT i.server, i.database, object_id, index_id, keys, partition_number, size_mb FROM object_inventory i JOIN (SELECT server AS s, database AS d, object_id AS o, index_id AS i, string_agg(DISTINCT index_name, ', ' ORDER BY index_name) AS keys FROM object_inventory GROUP BY 1, 2, 3, 4) k ON s = i.server AND d = i.database AND o = object_id AND k.i = index_id WHERE compression = 'NONE' AND table_name LIKE 'T1%'")
def uncompressed_objects(i):
    k = i.select("server", "database", "object_id", "index_id", F.col("index_name").alias("column"), F.col("index_name").alias("ordinal")).distinct()
    return catalog.uncompressed_objects(i, k, "T1%").select("server", "database", "object_id", "index_id", "keys", "partition_number", "size_mb")


@query("object_inventory", """SELECT server, database, file_id, object_id, page, size - 1 - page AS from_end FROM (SELECT *, row_number() OVER (PARTITION BY server, database, file_id ORDER BY page DESC) AS rn FROM (
  SELECT server, database, object_id % 7 AS file_id, object_id, part_key * 10 + partition_number AS page, (SELECT max(part_key) * 10 FROM object_inventory) + 40 AS size FROM object_inventory) x WHERE page >= size - 1 - 150) y WHERE rn = 1""")
def tail_object(i):
    own = ["server", "database", (F.col("object_id") % 7).alias("file_id")]
    pages = i.select(*own, "object_id", (F.col("part_key") * 10 + F.col("partition_number")).alias("page"))
    free = i.select(*own, F.lit(None).cast("long").alias("object_id"), (F.col("part_key") * 10 + 9).alias("page"))
    size = i.agg((F.max("part_key") * 10 + 40).alias("size_pages"))
    return catalog.tail_object(pages.unionByName(free), i.select(*own).distinct().join(F.broadcast(size)), 150)


from . import estate_queries  # noqa: E402, F401  (registers its queries above; it needs the names defined here)
