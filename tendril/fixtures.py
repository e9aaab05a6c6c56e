"""Views that give the driver's tables the shapes of landed telemetry; the same text runs on Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "session_snapshots": """
        WITH s AS (SELECT concat('srv', CAST(user_id % 2 AS VARCHAR(9))) AS server, date_trunc('hour', ts) AS poll_ts, CAST(floor(user_id / 2.0) AS BIGINT) + 1 AS spid, min(event_id) AS first_event,
                          max(value) AS v, min(event_type) AS et FROM events GROUP BY 1, 2, 3)
        SELECT server, poll_ts, spid, first_event,
          CASE WHEN first_event % 5 = 0 THEN 'sleeping' ELSE 'running' END AS status,
          CASE et WHEN 'click' THEN 'SELECT' WHEN 'error' THEN 'UPDATE STATISTICS' WHEN 'purchase' THEN 'ALTER INDEX'
                  WHEN 'signup' THEN 'DBCC' ELSE 'INSERT' END AS command,
          CASE WHEN first_event % 4 = 0 THEN '' ELSE concat(et, ' t', CAST(spid % 6 AS VARCHAR(9))) END AS statement, concat('EXEC p', CAST(spid % 9 AS VARCHAR(9))) AS batch,
          CASE WHEN spid % 11 = 0 THEN '' ELSE concat('login', CAST(spid % 7 AS VARCHAR(9))) END AS login, concat('host', CAST(spid % 5 AS VARCHAR(9))) AS host,
          CASE WHEN spid % 4 = 0 THEN concat('SQLAgent - TSQL JobStep (Job 0x00', CAST(spid % 10 AS VARCHAR(9)), ' : Step ', CAST(spid % 3 AS VARCHAR(9)), ')')
               ELSE concat('app', CAST(spid % 6 AS VARCHAR(9))) END AS program,
          CASE WHEN first_event % 3 = 0 THEN 0
               WHEN first_event % 7 = 0 THEN coalesce(lead(spid, 2) OVER (PARTITION BY server, poll_ts ORDER BY first_event), 0)
               ELSE coalesce(lag(spid) OVER (PARTITION BY server, poll_ts ORDER BY first_event), 0) END AS blocking_spid,
          CAST(floor(v * 100) AS BIGINT) AS wait_ms
        FROM s
    """,
    "runs": """
        SELECT server, poll_ts, spid AS run_spid
        FROM (SELECT server, poll_ts, spid, row_number() OVER (PARTITION BY server, poll_ts ORDER BY first_event) AS rn, count(*) OVER (PARTITION BY server, poll_ts) AS n FROM session_snapshots) x WHERE rn = least(3, n)
    """,
    "wait_snapshots": """
        SELECT ts AS poll_ts, user_id + 1 AS spid, wait_type,
          CAST(sum(ms) OVER (PARTITION BY user_id, wait_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS wait_time_ms,
          count(*) OVER (PARTITION BY user_id, wait_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS waiting_tasks,
          ms AS max_wait_ms
        FROM (SELECT ts, user_id, CAST(floor(value * 100) AS BIGINT) AS ms,
          CASE event_type WHEN 'click' THEN 'LCK_M_IX' WHEN 'view' THEN 'PAGEIOLATCH_EX' WHEN 'purchase' THEN 'WRITELOG'
                          WHEN 'signup' THEN 'SLEEP_TASK' ELSE 'CXPACKET' END AS wait_type FROM events) e
    """,
    "log_samples": """
        SELECT concat('srv', CAST(user_id % 5 AS VARCHAR(9))) AS server, ts AS poll_ts, CAST(107374182400 AS BIGINT) AS total_bytes,
          CAST(CAST(floor(value * 7) AS BIGINT) % 101 AS DOUBLE) AS used_percent,
          CASE WHEN event_id % 4 = 0 THEN 'LOG_BACKUP' ELSE 'NOTHING' END AS reuse_wait,
          CAST(event_id * 13 % 29 AS INT) AS runnable_tasks, CASE WHEN event_id % 17 = 0 THEN 0 ELSE 8 END AS schedulers
        FROM events
    """,
    "object_inventory": """
        SELECT concat('srv', CAST(t % 2 AS VARCHAR(9))) AS server, concat('db', CAST(CAST(floor(t / 2.0) AS BIGINT) % 2 AS VARCHAR(9))) AS database,
          CAST(floor(t / 4.0) AS BIGINT) AS object_id, 'dbo' AS schema_name, concat('T', CAST(CAST(floor(t / 4.0) AS BIGINT) AS VARCHAR(12))) AS table_name,
          CAST(CASE WHEN k % 4 = 0 THEN CAST(floor(t / 4.0) AS BIGINT) % 2 ELSE k % 4 + 1 END AS INT) AS index_id,
          CAST(CASE WHEN k % 4 = 0 THEN CAST(floor(t / 4.0) AS BIGINT) % 2 ELSE 2 END AS INT) AS type,
          concat('IX_', CAST(CAST(floor(t / 4.0) AS BIGINT) * 4 + k % 4 AS VARCHAR(12))) AS index_name, CAST(g.n AS INT) AS partition_number,
          CASE p_size % 3 WHEN 0 THEN 'NONE' WHEN 1 THEN 'ROW' ELSE 'PAGE' END AS compression,
          CAST(floor(t / 4.0) AS BIGINT) * 4 + k % 4 AS part_key, p_retailprice / g.n AS size_mb
        FROM (SELECT p_partkey AS k, CAST(floor(p_partkey / 4.0) AS BIGINT) AS t, p_size, p_retailprice FROM part) q CROSS JOIN (VALUES (1), (2), (3)) AS g(n) WHERE g.n <= p_size % 3 + 1
    """,
    "physical_stats": """
        SELECT concat('srv', CAST(t % 2 AS VARCHAR(9))) AS server, concat('db', CAST(CAST(floor(t / 2.0) AS BIGINT) % 2 AS VARCHAR(9))) AS database, CAST(floor(t / 4.0) AS BIGINT) * 4 + k % 4 AS part_key, partition_number, fragmentation, page_count, record_count, forwarded_count, density
        FROM (SELECT l_partkey AS k, CAST(floor(l_partkey / 4.0) AS BIGINT) AS t, CAST(l_linenumber % 3 + 1 AS INT) AS partition_number,
          CAST(count(*) * 7 % 100 AS DOUBLE) AS fragmentation, CAST(sum(l_quantity) AS BIGINT) * 20 AS page_count,
          count(*) * 100 AS record_count, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 30 ELSE 0 END) AS BIGINT) AS forwarded_count,
          CAST(100 - CAST(sum(l_quantity) AS BIGINT) % 60 AS DOUBLE) AS density
          FROM lineitem GROUP BY l_partkey, l_linenumber % 3 + 1) q
    """,
    "run_history": """
        SELECT o_orderkey AS run_id, concat('m', CAST(o_custkey % 50 AS VARCHAR(9))) AS manifest,
          CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'done' ELSE 'incomplete' END AS outcome,
          o_orderdate AS started_at, CAST(floor(o_totalprice) AS BIGINT) AS duration_ms FROM orders
    """,
}
NEEDS = {"runs": ("session_snapshots",)}


def with_views(names: str, body: str) -> str:
    """body after the named views as common table expressions."""
    order: list[str] = []
    for name in names.split():
        order += [n for n in (*NEEDS.get(name, ()), name) if n not in order]
    return ("WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in order) + " " if order else "") + body


def tables(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables(spark, sf_dir)
    return spark.sql(with_views(name, f"SELECT * FROM {name}"))
