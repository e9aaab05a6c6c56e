"""Cases as literal rows: what each operator must give, on small inputs that name the edge."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tendril.functions.columns import glob
from tendril.operators import blocking as b
from tendril.operators import changes as c
from tendril.operators import fleet
from tendril.operators import maintenance as m
from tendril.operators import pressure as p
from tendril.operators import reports as r
from tendril.operators import waits as w
from tendril.queries import QUERIES
from tendril.sources import catalog

T0 = dt.datetime(2026, 1, 5, 22, 0, 0)  # a Monday
at = lambda s: T0 + dt.timedelta(seconds=s)


def test_wait_differences_and_categories(spark):
    s = "spid int, wait_type string, wait_time_ms long, waiting_tasks long, max_wait_ms long"
    before = spark.createDataFrame([(1, "WRITELOG", 100, 5, 9), (1, "GONE", 5, 1, 1), (1, "LCK_M_IX", 7, 1, 2)], s)
    after = spark.createDataFrame([(1, "WRITELOG", 400, 20, 11), (1, "LCK_M_IX", 7, 1, 2), (1, "PAGEIOLATCH_SH", 80, 4, 3), (1, "SLEEP_TASK", 9, 9, 9)], s)
    d = w.diff_waits(before, after)
    assert {(x.wait_type, x.wait_time_ms, x.waiting_tasks, x.max_wait_ms) for x in d.collect()} == {("WRITELOG", 300, 15, 11), ("PAGEIOLATCH_SH", 80, 4, 3), ("SLEEP_TASK", 9, 9, 9)}
    assert {(x.category, x.wait_time_ms, x.total_ms) for x in w.categorize_waits(d).collect()} == {("Transaction log", 300, 380), ("Data I/O", 80, 380)}


def search(edges, root):
    seen, todo = set(), [root]
    while todo:
        x = todo.pop()
        for a, up in edges:
            if up == x and a not in seen:
                seen.add(a)
                todo.append(a)
    return len(seen - {root})


def test_blocked_behind_on_cycles(spark):
    rng = random.Random(1)
    rows = [(0, a, u) for a, u in [(2, 1), (3, 2), (4, 3)]] + [(1, 1, 2), (1, 2, 1)] + [(2, 1, 2), (2, 2, 3), (2, 3, 1)] + [(3, i, rng.randrange(15)) for i in range(1, 15)]
    rows += [(4, i + 1, i) for i in range(1, 40)] + [(5, i, i % 3 + 1) for i in range(1, 4)] + [(5, i, rng.randrange(1, i)) for i in range(4, 60)] + [(6, 9, 9)]  # a long chain, a ring with trees, a session that waits for itself
    both = [("x", *r) for r in rows] + [("y", k, a + 1 if a else 0, u + 1 if u else 0) for k, a, u in rows]  # another server's ids clash
    found = b.blocked_behind(spark.createDataFrame(both, "server string, poll_ts int, spid int, blocking_spid int")).collect()
    got = {(x.poll_ts, x.spid): x.behind for x in found if x.server == "x"}
    assert got == {(x.poll_ts, x.spid - 1): x.behind for x in found if x.server == "y"}
    for t in range(7):
        edges = [(a, u) for k, a, u in rows if k == t and u]
        assert {k[1]: v for k, v in got.items() if k[0] == t} == {u: n for u in {u for _, u in edges} if (n := search(edges, u))}


def test_debt(spark):
    polls = spark.createDataFrame([("s", at(s)) for s in (0, 10, 20, 30, 330, 631, 641)] + [("t", at(15))], "server string, poll_ts timestamp")
    seen = [("a", 0), ("a", 10), ("a", 10), ("a", 30), ("a", 330), ("a", 631), ("a", 641), ("b", 20)]
    got = {(x.identity, x.bucket): x.debt_s for x in b.offender_debt(spark.createDataFrame([("s", i, at(s)) for i, s in seen], "server string, identity string, poll_ts timestamp"), polls).collect()}
    assert got == {("a", 0): 310, ("a", 1): 10, ("b", 0): 0}  # 300 s of idling keep a bucket, 301 s end it


def test_latch_boundaries(spark):
    rows = [("s", at(i), float(v)) for i, v in enumerate([89.9, 90, 95, 85, 91, 84.9, 90])]
    assert [x.poll_ts for x in p.log_full_alarm(spark.createDataFrame(rows, "server string, poll_ts timestamp, used_percent double")).orderBy("poll_ts").collect()] == [at(1), at(6)]


def test_windows_over_midnight(spark):
    rows = [(dt.datetime(2026, 1, d, h, n),) for d, h, n in ((5, 22, 0), (5, 21, 59), (6, 2, 59), (6, 3, 0), (6, 22, 30), (7, 1, 0))]
    df = spark.createDataFrame(rows, "ts timestamp")
    assert [x.ts.day * 100 + x.ts.hour for x in p.window_filter(df, "ts", "22:00", "03:00", [2]).orderBy("ts").collect()] == [522, 602]
    assert p.window_filter(df, "ts", "22:00", "03:00").count() == 4


def test_progress_and_campaign(spark):
    rows = [(1, at(0), 0.0, 0.0), (1, at(10), 10.0, 10.0), (1, at(20), 20.0, 30.0), (1, at(30), 30.0, 5.0), (1, at(40), 40.0, 10.0)]
    got = p.progress_eta(spark.createDataFrame(rows, "req int, poll_ts timestamp, elapsed_s double, pct double"), ["req"]).orderBy("poll_ts").collect()
    assert [x.eta_s for x in got] == [None, None, 35, None, 180]
    x = p.campaign_eta(spark.createDataFrame([(141, 101, 0, 4, 100, 20), (100, 100, 0, 0, 5, 9)], "start_mb int, current_mb int, final_mb int, chunks_done int, elapsed_s int, blocked_s int")).orderBy("elapsed_s").collect()
    assert [(y.chunks_left, y.eta_s, y.eta_free_s, y.chunk_s) for y in x] == [(0, 0, 0, 0), (11, 253, 202, 25)]  # 40 MB in 100 s, 101 MB left


def test_outages(spark):
    rows = [("s", at(i), f) for i, f in enumerate([False, True, True, False, False, True])]
    got = {(x.poll_ts, x.event, x.missed) for x in p.channel_outages(spark.createDataFrame(rows, "server string, poll_ts timestamp, failed boolean"), ["server"]).collect()}
    assert got == {(at(1), "failed", 0), (at(3), "recovered", 2), (at(5), "failed", 0)}


def test_index_decisions(spark):
    s = "page_count long, size_mb long, fragmentation double, override string, target string"
    rows = [(5000, 40, 42.0, None, None), (5000, 40, 12.0, None, None), (5000, 40, 2.0, None, None), (500, 4, 99.0, None, None), (5000, 900, 42.0, None, "PAGE"), (5000, 40, 42.0, "skip", None), (None, 40, None, None, None)]
    got = m.decide_index(spark.createDataFrame(rows, s), m.Profile(max_rebuild_mb=500)).collect()
    assert [x.kind for x in got] == ["rebuild", "reorganize", "skip", "skip", "reorganize", "skip", "skip"]
    assert [x.reason for x in got][3:] == ["too small", "rebuild not allowed", "override", "not measured"] and got[4].target is None


def test_compression_decisions(spark):
    s = "current_kb double, row_kb double, page_kb double, writes long, reads long, compression string, override string"
    rows = [(100.0, 70.0, 50.0, 0, 0, "NONE", None), (100.0, 70.0, 68.0, 0, 0, "NONE", None), (100.0, 98.0, 97.0, 0, 0, "NONE", None), (100.0, 70.0, 50.0, 0, 0, "PAGE", None), (100.0, 70.0, 50.0, 500, 500, "NONE", None), (None, None, None, 0, 0, "NONE", None), (None, None, None, 0, 0, "NONE", "PAGE")]
    assert [x.target for x in m.decide_compression(spark.createDataFrame(rows, s), m.Profile()).collect()] == ["PAGE", "ROW", None, None, "ROW", None, "PAGE"]


def test_suppression(spark):
    s = "server string, database string, schema_name string, table_name string, name string, category string, kind string, partition_number int, reason string"
    rows = [("d", "A", "heap", "heap", "rebuild_heap", None, ""), ("d", "a", "i", "index", "rebuild", None, ""), ("d", "B", "I", "index", "rebuild", None, ""), ("d", "b", "i", "statistics", "update_statistics", None, ""), ("d", "C", "i", "index", "rebuild", 2, ""), ("d", "C", "i", "statistics", "update_statistics", None, "")]
    every = [("s", "a", *r) for r in rows] + [("s", "b", *r) for r in rows if r[4] != "rebuild_heap"] + [("t", "a", *r) for r in rows if r[3] != "index"]
    found = m.suppress_redundant(spark.createDataFrame(every, s)).collect()
    assert {(x.table_name, x.category): x.kind for x in found if x.database == "b"}["a", "index"] == "rebuild"  # its heap stays, another database's doesn't
    assert {(x.table_name, x.category): x.kind for x in found if x.server == "t"}["b", "statistics"] == "update_statistics"
    got = {(x.table_name, x.category): x.kind for x in found if (x.server, x.database) == ("s", "a")}
    assert got == {("A", "heap"): "rebuild_heap", ("a", "index"): "skip", ("B", "index"): "rebuild", ("b", "statistics"): "skip", ("C", "index"): "rebuild", ("C", "statistics"): "update_statistics"}


def test_updates_are_idempotent(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 5, "x") for i in range(100)], "k int, v int, s string")
    cond = c.where([("k", ">=", 10), ("s", "is not null")])
    once, hit = c.batch_update(df, {"v": 4}, cond)
    n = df.where(hit).count()
    again, hit2 = c.batch_update(once, {"v": 4}, cond)
    assert n == 90 - sum(1 for i in range(10, 100) if i % 3 and i % 5 == 4) and again.where(hit2).count() == 0
    cond = c.where([("v", "<", 3)])
    assert c.batch_delete(df, cond).count() == c.unmatched_rows(df, cond, 10**6)
    assert c.unmatched_rows(df, cond, 7) == 7
    for bad in ([("v", "like", 1)], [("v", "=")], [("v", "is null", 1)], [("v", "=", None)]):
        with pytest.raises(ValueError):
            c.where(bad)


def test_key_ranges_and_marks(spark):
    df = spark.range(1, 12346).withColumnRenamed("id", "k")
    got = c.key_ranges(df, "k", 1000, F.lit(True), watermark=345).orderBy("batch").collect()
    assert [(x.lo, x.hi, x.rows) for x in got] == [(346 + 1000 * i, 1345 + 1000 * i, 1000) for i in range(12)]
    marks = spark.createDataFrame([("j", 5, 1), ("j", 9, 2)], "job string, watermark int, ts int").withColumn("fingerprint", c.fingerprint("UPDATE  t"))
    assert c.resume_watermark(marks, "j", "UPDATE t") == 9 and c.resume_watermark(marks, "j", "UPDATE u") is None
    keys = spark.createDataFrame([("a", "k", True, True), ("b", "k", True, False), ("c", "x", True, True), ("c", "y", True, True), ("d", "k", False, True), ("e", None, None, None)], "table string, column string, is_integer boolean, is_unique boolean")
    assert {x.table: x.key or x.reason for x in c.key_range_key(keys).collect()} == {"a": "k", "b": "not unique", "c": "composite key", "d": "not an integer", "e": "heap"}


def test_layout_keeps_rows(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") * 37 % 5000).alias("k"), F.lit("x").alias("s"))
    c.rewrite_table(df, f"{tmp_path}/a", ["k"], files=3)
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("k", "s").cast("decimal(38,0)"))).first()
    assert mark(df) == mark(spark.read.parquet(f"{tmp_path}/a"))
    assert len(list((tmp_path / "a").glob("*.parquet"))) == 3


def test_alter_column(spark):
    df = spark.createDataFrame([("1",), (None,)], "v string")
    assert c.alter_column(df, "v", "int").collect() == [(1,), (None,)]
    for bad, nullable in ((spark.createDataFrame([("x",)], "v string"), True), (df, False)):
        with pytest.raises(Exception, match="convert"):
            c.alter_column(bad, "v", "int", nullable).collect()


def _rules(spark, matrix):
    full = [(k, {o: (r["min_major"], r["editions"], r.get("requires")) for o, r in options.items()}) for k, options in matrix.items()]
    return fleet.compat_rules(spark.createDataFrame(full, fleet.RULES))


def test_options(spark):
    ent = ["enterprise", "azure"]
    rules = _rules(spark, {"rebuild_index": {"online": {"min_major": 9, "editions": ent}, "resumable": {"min_major": 14, "editions": ent, "requires": ["online"]}, "sort_in_tempdb": {"min_major": 9, "editions": [*ent, "standard"]}}})
    servers = spark.createDataFrame([("new", 16, "enterprise", "db", {}), ("old", 13, "enterprise", "db", {"resumable": True}), ("std", 16, "standard", "db", {}), ("tmp", 16, "enterprise", "tempdb", {}), ("odd", 16, "?", "db", {}), ("az", 12, "azure", "db", {"sort_in_tempdb": True})], "server string, major int, tier string, database string, policy map<string,boolean>")
    ops = spark.createDataFrame([(0, "rebuild_index", "i", None, True, {}), (1, "rebuild_index", "i", None, True, {"online": False})], "op_index int, command string, index string, partition int, rowstore boolean, overrides map<string,boolean>")
    ops = servers.select("server").crossJoin(ops)
    got = {(x.server, x.op_index, x.option): (x.value, x.reason) for x in fleet.resolve_options(ops, servers, rules).collect()}
    assert got["new", 0, "resumable"][0] and got["new", 0, "online"][0]
    assert got["old", 0, "resumable"] == (False, "asked for but not supported")
    assert not got["std", 0, "online"][0] and got["tmp", 0, "resumable"] == (False, "not resumable here")
    assert not any(v[0] for k, v in got.items() if k[0] == "odd")
    assert got["new", 1, "resumable"] == (False, "needs online") and got["az", 0, "sort_in_tempdb"] == (False, "resumable wins") and got["az", 1, "sort_in_tempdb"][0]


def test_preflight(spark):
    s = spark.createDataFrame([("a", "enterprise"), ("b", None)], "server string, tier string")
    need = spark.createDataFrame([("a", 50), ("b", 50)], "server string, need_mb long")
    files = spark.createDataFrame([("a", 10, 20), ("b", 10, None)], "server string, free_mb long, headroom_mb long")
    runs = spark.createDataFrame([("m", "a"), ("m", "b")], "manifest string, server string")
    got = {x.server: (x.fails, x.warns, x.severity) for x in fleet.preflight(runs, {"tier": fleet.check_server(s), "space": fleet.check_free_space(need, files)}).collect()}
    assert got == {"a": (1, 0, "FAIL"), "b": (1, 1, "FAIL")}


def test_sizes(spark):
    lines = spark.createDataFrame([(0, 1, 100, 80), (1, 1, 80, 60), (2, 2, -1, 7), (3, 3, -1, -1)], "op_index int, id int, before_kb long, after_kb long")
    assert tuple(r.size_totals(lines, ["id"]).first()) == (100, 67, 2)
    assert [x.change_pct for x in r.size_change(lines).orderBy("op_index").collect()] == [-20.0, -25.0, None, None]
    assert [x.text for x in r.size_change(lines).orderBy("op_index").collect()] == ["100 KB -> 80 KB (-20.0%)", "80 KB -> 60 KB (-25.0%)", "unknown -> 7 KB", "unknown -> unknown"]
    big = spark.createDataFrame([(1, 461056, 1 << 31), (1, -1, 5)], "op int, before_kb long, after_kb long")
    assert {x.text for x in r.size_change(big).collect()} == {"450.2 MB -> 2.00 TB (+465675.0%)", "unknown -> 5 KB"}
    assert [(x.total, x.measured, x.before_kb) for x in r.size_changes(big, ["op"]).collect()] == [(2, 1, 461056)]
    side = "id int, index_id int, name string, is_disabled boolean, kb long"
    both = r.size_lines(spark.createDataFrame([(1, 0, None, False, 5), (1, 2, "a", True, 0)], side), spark.createDataFrame([(1, 2, "a", False, 9), (1, 3, "b", False, 1)], side), ["id", "index_id"])
    assert {(x.index_id, x.name, x.was_disabled, x.before_kb, x.after_kb) for x in both.collect()} == {(0, "heap", False, 5, -1), (2, "a", True, 0, 9), (3, "b", False, -1, 1)}


def test_cancels_that_roll_back(spark):
    ops = spark.createDataFrame([(1, 1, "rebuild_index", False, "done"), (1, 2, "create_index", False, "interrupted"), (1, 3, "create_index", True, "failed"), (1, 4, "update_statistics", False, "failed"), (1, 5, "alter_column", False, "failed"), (2, 1, "rebuild_heap", None, None)], "run_id int, op_id int, command string, resumable boolean, outcome string")
    reactions = spark.createDataFrame([(1, 1, "cancel"), (1, 1, "cancel"), (1, 2, "cancel"), (1, 3, "cancel"), (1, 4, "cancel"), (1, 5, "pause"), (2, 1, "cancel")], "run_id int, op_id int, kind string")
    assert {tuple(x) for x in r.cancel_only_summary(ops, reactions).collect()} == {(1, 2, 1, 1), (2, 1, 0, 1)}


def test_trends(spark):
    day = 86400
    rows = [("s", "d", i, at(i * 10 * day), "t", k, f, c1, c2) for i, (k, f, c1, c2) in enumerate([("rebuild", 10.0, "NONE", "PAGE"), ("reorganize", None, "PAGE", None), ("rebuild", 30.0, "NONE", None), ("rebuild", 40.0, "PAGE", None)])]
    d = spark.createDataFrame([*rows, ("s", "e", 9, at(0), "t", "rebuild", 1.0, "NONE", None)], "server string, database string, plan_id int, generated_at timestamp, target string, decision string, fragmentation double, current_compression string, chosen_compression string")
    got = {(x.database, x.plan_id): (x.rebuilds, x.oscillates, x.held, x.slope) for x in m.trend_report(d).collect()}
    assert got == {("d", 0): (1, False, None, None), ("d", 1): (1, False, True, None), ("d", 2): (2, False, False, 1.0), ("d", 3): (3, True, True, 1.0), ("e", 9): (1, False, None, None)}
    x = m.trend_summary(d).where("database = 'd'").first()
    assert (x.records, x.total_rebuilds, x.most_rebuilds, x.oscillates, x.lost, round(x.trend, 6)) == (4, 3, 3, True, 1, 1.0)


def test_one_server_is_not_another(spark):
    inv = "server string, database string, object_id int, schema_name string, table_name string, index_id int, type int, index_name string, partition_number int, compression string, part_key int, size_mb double"
    i = spark.createDataFrame([("a", d, 5, "dbo", "t", k, min(k, 1), "i", 1, "NONE", k, 500.0) for d in ("x", "y") for k in (0, 1)], inv)
    ph = spark.createDataFrame([("a", "x", 1, 1, 50.0, 2000, 10, 5, 90.0)], "server string, database string, part_key int, partition_number int, fragmentation double, page_count long, record_count long, forwarded_count long, density double")
    assert {(x.database, x.size_mb, x.fragmentation) for x in m.index_measurements(i, ph).collect()} == {("x", 500, 50.0), ("y", 500, None)}
    s = spark.createDataFrame([("a", T0, 55, 1, 60), ("b", T0, 55, 1, 0), ("a", T0, 60, 1, 0)], "server string, poll_ts timestamp, spid int, wait_ms int, blocking_spid int")
    runs = spark.createDataFrame([("a", T0, 60), ("b", T0, 60)], "server string, poll_ts timestamp, run_spid int")
    assert [(x.server, x.spid) for x in b.direct_victims(s, runs).collect()] == [("a", 55)]


def test_history(spark, tmp_path):
    one = spark.createDataFrame([(1, T0)], "run_id int, started_at timestamp")
    catalog.run_history_sink(one, f"{tmp_path}/h")
    catalog.run_history_sink(one.withColumn("peak", F.lit(5)), f"{tmp_path}/h")
    assert sorted((x.run_id, x.peak or 0) for x in catalog.run_history_source(spark, f"{tmp_path}/h").collect()) == [(1, 0), (1, 5)]
    d = spark.createDataFrame([("p1", 1), ("p2", 2)], "plan_id string, x int")
    catalog.plan_history_sink(spark.createDataFrame([("p1", T0)], "plan_id string, at timestamp"), d, f"{tmp_path}/p")
    assert [x.x for x in catalog.plan_history_source(spark, f"{tmp_path}/p").collect()] == [1]
    (tmp_path / "c.json").write_text('{"database": "d", "observed": [{"object_id": 1, "confirmed_by": ""}, {"object_id": 2, "confirmed_by": "tail"}]}')
    assert [x.confirmed_by for x in catalog.contended_source(spark, f"{tmp_path}/c.json").collect()] == ["lock", "tail"]


def test_glob():
    import re

    hit = lambda g, s: bool(re.search(glob(g), s))
    assert hit("dbo.*", "DBO.a.b") and not hit("a*", "a/b") and hit("t?[ab]", "txA") and not hit("a.b", "axb") and not hit("a", "ab")


def test_reactions(spark):
    rows = [(False, False, False, True), (True, False, False, True), (True, False, True, True), (False, True, False, False)]
    assert [x.action for x in p.decide_reaction(spark.createDataFrame(rows, "blocked boolean, log_over boolean, blind boolean, resumable boolean")).collect()] == ["continue", "pause", "cancel", "cancel"]


def test_alarm_stream_equals_batch(spark, tmp_path):
    from tendril.streaming.alarms import log_full_alarm_stream

    rng = random.Random(3)
    rows = [(f"s{i % 3}", at(i), float(rng.randrange(70, 100))) for i in range(120)]
    s = "server string, poll_ts timestamp, used_percent double"
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], s).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = log_full_alarm_stream(spark.readStream.schema(s).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("alarms").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(x.server, x.poll_ts) for x in p.log_full_alarm(spark.createDataFrame(rows, s)).collect()}
    assert {(x.server, x.poll_ts) for x in spark.table("alarms").collect()} == want


def test_rebuild_intents_and_ceilings(spark):
    shape = "name string, fragmentation double, page_count long, size_mb long, override string, target string"
    rows = [("both", 50.0, 5000, 10, None, "PAGE"), ("compression", 1.0, 5000, 10, None, "PAGE"), ("forbidden", 50.0, 5000, 10, "no_rebuild", "PAGE"), ("healthy and forbidden", 1.0, 5000, 10, "no_rebuild", "PAGE"), ("big", 50.0, 5000, 999, None, None), ("small", 90.0, 10, 1, None, "PAGE")]
    d = spark.createDataFrame(rows, shape)
    got = {x.name: (x.kind, x.intent, x.target) for x in m.decide_index(d, m.Profile(max_rebuild_mb=500)).collect()}
    assert got == {"both": ("rebuild", "fragmentation", "PAGE"), "compression": ("rebuild", "compression", "PAGE"), "forbidden": ("reorganize", "fragmentation", None), "healthy and forbidden": ("skip", None, None), "big": ("reorganize", "fragmentation", None), "small": ("skip", None, None)}
    assert {x.name: x.kind for x in m.decide_index(d, m.Profile(max_rebuild_mb=500, over_ceiling="skip")).collect()}["big"] == "skip"


def test_heap_gates_and_statistics(spark):
    shape = "name string, heap_mb long, rewrite_mb long, forwarded long, records long, fragmentation double, density double, override string, disabled array<string>, target string"
    rows = [("due", 10, 20, 50, 100, 0.0, 100.0, None, None, "ROW"), ("re-enables", 10, 20, 50, 100, 0.0, 100.0, None, ["a", "b"], None), ("healthy", 10, 20, 1, 100, 0.0, 100.0, None, [], "ROW")]
    got = {x.name: (x.kind, x.reason, x.target) for x in m.decide_heap(spark.createDataFrame(rows, shape), m.Profile()).collect()}
    assert got == {"due": ("rebuild_heap", "forwarded records", "ROW"), "re-enables": ("skip", "would re-enable a, b", None), "healthy": ("skip", "healthy", None)}
    s = spark.createDataFrame([("none", 0, 0), ("few", 1000, 999), ("many", 1000, 1000)], "name string, rows long, modifications long")
    assert {x.name: x.kind != "skip" for x in m.decide_statistics(s).collect()} == {"none": True, "few": False, "many": True}
    assert all(x.kind != "skip" for x in m.decide_statistics(s, 0.0).collect())


def test_free_space_that_must_grow_warns(spark):
    need = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10), ("d", 0), ("e", 10), ("f", None)], "server string, need_mb long")
    files = spark.createDataFrame([("a", 10, 0), ("b", 5, 5), ("c", 5, 4), ("d", 50, 0), ("e", 5, None), ("f", 50, 0)], "server string, free_mb long, headroom_mb long")
    assert {x.server: x.severity for x in fleet.check_free_space(need, files).collect()} == {"a": "PASS", "b": "WARN", "c": "FAIL", "d": "WARN", "e": "WARN", "f": "WARN"}


def test_relief_drain_and_silence(spark):
    pauses = spark.createDataFrame([(k, at(0)) for k in ("relief", "drain", "blind", "open")], "server string, pause_ts timestamp")
    rows = [("relief", 0, False, False), ("relief", 50, True, False), ("relief", 90, False, False), ("drain", 50, False, True), ("drain", 150, False, True), ("drain", 260, False, False), ("blind", 400, False, False), ("open", 60, True, False)]
    samples = spark.createDataFrame([(k, at(s), b_, log) for k, s, b_, log in rows], "server string, poll_ts timestamp, blocked boolean, log_over boolean")
    got = {x.server: (x.relief_s, x.ended) for x in p.time_to_relief(pauses, samples, 200, 300).collect()}
    assert got == {"relief": (90, "relief"), "drain": (260, "drain"), "blind": (400, "blind"), "open": (None, None)}


def test_the_cap_fires_whoever_is_ignored(spark):
    rows = [("s", at(60 * i), False, i >= 1) for i in range(8)]
    got = p.block_alarms(spark.createDataFrame(rows, "server string, poll_ts timestamp, unignored boolean, any boolean"), 60, 240, ["server"]).collect()
    assert [(x.start_ts, x.fired_ts, x.capped) for x in got] == [(at(60), at(300), True)]
    d = spark.createDataFrame([(True, False, False, True, True)], "blocked boolean, log_over boolean, blind boolean, resumable boolean, capped boolean")
    assert [(x.action, x.detail) for x in p.decide_reaction(d).collect()] == [("pause", "cap,blocking")]


def test_key_ranges_of_outlying_keys(spark):
    keys = [*range(100), 2**62, -(2**62)]
    got = c.key_ranges(spark.createDataFrame([(k,) for k in keys], "k long"), "k", 10, F.lit(True)).orderBy("batch").collect()
    want = [sorted(keys)[i : i + 10] for i in range(0, len(keys), 10)]
    assert [(x.lo, x.hi, x.rows) for x in got] == [(w[0], w[-1], len(w)) for w in want]
    assert c.key_ranges(spark.createDataFrame([], "k long"), "k", 10, F.lit(True)).collect() == []


def test_no_window_takes_all_rows_into_one_task(spark):
    shape = "server string, login string, host string, poll_ts timestamp, identity string, blocker_spid int, rule int, run_spid int, spid int, blocking_spid int, job string, batch int, rows int, seconds int, database string, object_id int, index_id int, type int, page_count int, density double, confirmed_by string, times_blocked int, page_from_end int"
    d = spark.createDataFrame([], shape)
    measures, confirmed = d.select("server", "database", "object_id", "index_id", "type", "page_count", "density"), d.select("server", "database", "object_id", "confirmed_by", "times_blocked", "page_from_end")
    plans = (b.offender_debt(d, d), b.rule_debt(d), b.suspension_episodes(d.select("server", "poll_ts", "spid", "blocking_spid", "login", "host"), d.select("server", "poll_ts", "run_spid")), c.batch_progress(d, 5), m.pre_shrink_plan(measures, confirmed, 1, 1.0))
    for x in plans:
        assert "SinglePartition" not in x._jdf.queryExecution().executedPlan().toString()


def test_preflight_by_manifest(spark):
    manifests = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 3)], "manifest string, server int")
    of_server = spark.createDataFrame([(1, "PASS"), (2, "FAIL")], "server int, severity string")
    own = spark.createDataFrame([("a", 1, "WARN", "x"), ("a", 1, "FAIL", "y"), ("b", 1, "WARN", "z"), ("b", 2, "FAIL", "another server's")], "manifest string, server int, severity string, detail string")
    rows = fleet.preflight_checks(manifests, {"tier": of_server, "targets": own})
    assert {(x.manifest, x.name, x.severity) for x in rows.collect()} == {("a", "tier", "PASS"), ("b", "tier", "PASS"), ("c", "tier", "FAIL"), ("a", "targets", "WARN"), ("a", "targets", "FAIL"), ("b", "targets", "WARN")}
    got = {x.manifest: (x.severity, x.fails, x.warns, x.blocking) for x in fleet.preflight(manifests, {"tier": of_server, "targets": own}).collect()}
    assert got == {"a": ("FAIL", 1, 1, "targets: y"), "b": ("WARN", 0, 1, ""), "c": ("FAIL", 1, 0, "tier"), "d": ("PASS", 0, 0, "")}


def test_rules_are_strict_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"command": "c", "options": {"o": {"min_major": 9, "editions": ["x"]}, "p": {"min_major": 14, "editions": ["x", "y"], "requires": ["o"]}}}')
    assert {(x.command, x.option, x.min_major, *x.editions, *x.requires) for x in fleet.compat_source(spark, str(tmp_path)).collect()} == {("c", "o", 9, "x"), ("c", "p", 14, "x", "y", "o")}
    (tmp_path / "b.json").write_text('{"command": "c", "options": {"o": {"min_major": "nine", "editions": ["x"]}}}')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|FAILED_READ"):
        fleet.compat_source(spark, str(tmp_path)).collect()


def test_permissions_and_disabled_indexes(spark):
    ops = spark.createDataFrame([("a", "shrink_tempdb", None, True), ("b", "batch_delete", "t", False), ("c", "shrink", None, False)], "server string, command string, table_name string, kills boolean")
    grants = spark.createDataFrame([("a", "owner", None), ("b", "DELETE", "t"), ("c", "owner", None)], "server string, grant string, table_name string")
    got = {(x.server, x.name): x.severity for x in fleet.check_permissions(ops, grants).collect()}
    assert got == {("a", "elevated"): "PASS", ("a", "tempdb"): "FAIL", ("a", "kill"): "WARN", ("b", "table"): "PASS", ("c", "elevated"): "PASS"}
    heaps = spark.createDataFrame([("s", 1, False, True), ("s", 2, True, True), ("s", 3, False, False), ("s", 4, False, True)], "server string, object_id int, allowed boolean, readable boolean")
    parts = spark.createDataFrame([("s", 1, 2, "b", 8, True), ("s", 1, 1, "a", 8, True), ("s", 2, 2, "b", 8, True), ("s", 4, 0, None, 8, False)], "server string, object_id int, index_id int, name string, kb long, is_disabled boolean")
    assert {x.object_id: (x.severity, x.detail) for x in fleet.check_reenabled_indexes(heaps, parts).collect()} == {1: ("FAIL", "a, b"), 2: ("WARN", "b"), 3: ("FAIL", "unread"), 4: ("PASS", "")}
    assert {x.object_id: (x.severity, x.detail) for x in fleet.check_heap_scope(heaps, parts).collect()} == {1: ("WARN", "2/16"), 2: ("WARN", "1/8"), 3: ("PASS", "0/0"), 4: ("PASS", "0/8")}


SPARED = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"


def test_unmatched_rows_beyond_the_limit(spark, tmp_path):
    spark.createDataFrame([(i, 1, "F", 1000.0 if i < 1500 else 300000.0, T0, "1-URGENT") for i in range(4000)], SPARED).write.parquet(str(tmp_path / "orders.parquet"))
    assert QUERIES["unmatched_rows"](spark, str(tmp_path)).first().few == 1500


def test_untouched_rows_beyond_the_limit(spark, tmp_path):
    spark.createDataFrame([(i, 1, "Z" if i % 2 else "F", 1000.0 if i < 1500 else 300000.0, T0, "1-URGENT") for i in range(4000)], SPARED).write.parquet(str(tmp_path / "orders.parquet"))
    assert QUERIES["untouched_rows"](spark, str(tmp_path)).first().few == 1500 + 1250  # too cheap, or at their target


def test_unmatched_rows_are_all_counted(spark, tmp_path):
    spark.createDataFrame([(i, 1, "P" if i % 2 else "F", 300000.0, T0, "1-URGENT") for i in range(5000)], SPARED).write.parquet(str(tmp_path / "orders.parquet"))
    assert tuple(QUERIES["unmatched_rows"](spark, str(tmp_path)).first()) == (2500, 0)


def test_queues_of_a_poll_take_no_rounds(spark, monkeypatch):
    rng = random.Random(2)
    rows = [("x", k, i, rng.randrange(1, 40)) for k in range(30) for i in range(1, 40) if rng.random() < 0.8] + [("y", 1, i + 1, i) for i in range(1, 300)] + [("y", 2, 5, 5), ("y", 2, None, 5), (None, 1, 2, 1)]
    sessions = spark.createDataFrame(rows, "server string, poll_ts int, spid int, blocking_spid int").repartition(3)
    written, real = [], b.scratch.table
    monkeypatch.setattr(b.scratch, "table", lambda df, name: written.append(name) or real(df, name))
    got = sorted(map(tuple, b.blocked_behind(sessions).collect()))
    assert written == ["waits", "large"]  # not one a round
    for limit in (0, 33):  # all polls, or some of them, by joins
        assert sorted(map(tuple, b.blocked_behind(sessions, poll=limit).collect())) == got
    for server, t in {(x, k) for x, k, *_ in rows if x}:
        edges = [(a, u) for x, k, a, u in rows if (x, k) == (server, t) and a]
        assert {x[2]: x[3] for x in got if x[:2] == (server, t)} == {u: n for u in {u for _, u in edges} if (n := search(edges, u))}


def test_amplifying_victims_take_no_rounds(spark, monkeypatch):
    s = "server string, poll_ts int, spid int, blocking_spid int, login string, host string, program string, command string, statement string, batch string, wait_ms long"
    chain = [("s", 1, i + 1, i, "l", "h", "app", "ALTER INDEX", "", "", 1) for i in range(1, 200)]
    written, real = [], b.scratch.table
    monkeypatch.setattr(b.scratch, "table", lambda df, name: written.append(name) or real(df, name))
    runs = spark.createDataFrame([("s", 1, 1)], "server string, poll_ts int, run_spid int")
    assert [(x.spid, x.behind) for x in b.amplifying_victims(spark.createDataFrame(chain, s), runs, []).collect()] == [(2, 198)]
    assert len(written) == 2


def test_amplifying_victims_read_sessions_once_beside_the_counting(spark, tmp_path):
    rng = random.Random(11)
    s = "server string, poll_ts int, spid int, blocking_spid int, login string, host string, program string, command string, statement string, batch string, wait_ms long"
    rows = [(rng.choice("ab"), rng.randrange(40), rng.randrange(1, 12), rng.randrange(12), rng.choice("lm"), "h", rng.choice(["app", "tendril x"]), rng.choice(["ALTER INDEX", "SELECT"]), "", "", 1) for _ in range(800)]
    told = [(x, t, rng.randrange(12)) for x in "ab" for t in range(40) for _ in range(2)]  # two runs a poll, also of session 0 and of the same session
    spark.createDataFrame(rows, s).write.parquet(f"{tmp_path}/sessions")
    sessions, runs = spark.read.parquet(f"{tmp_path}/sessions"), spark.createDataFrame(told, "server string, poll_ts int, run_spid int")
    rules = [{"login": "m"}]
    got = b.amplifying_victims(sessions, runs, rules)
    behind = {tuple(x)[:3]: x.behind for x in b.blocked_behind(sessions).collect()}
    own = {(x, t, r[3]) for x, t, run in told for r in rows if r[:3] == (x, t, run) and r[3]}
    want = [(*r[:3], run, behind[r[:3]]) for x, t, run in told for r in rows if run and (*r[:2], r[3]) == (x, t, run) and r[4] != "m" and r[6] == "app" and r[7] == "ALTER INDEX" and r[:3] not in own and r[:3] in behind]
    assert len(want) > 2 and sorted(map(tuple, got.select("server", "poll_ts", "spid", "run_spid", "behind").collect())) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Relation" in x and "blocking_spid" in x for x in plan) == 1
