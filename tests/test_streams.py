"""Streaming forms equal their batch forms over micro-batches that are shuffled, with rows that come late."""

import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tendril.operators import blocking as b
from tendril.operators import pressure as p
from tendril.streaming import event_time as e

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


@pytest.fixture
def stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def source(name, shape, *batches):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
            for f in os.listdir(f"{tmp_path}/{name}"):
                path = f"{tmp_path}/{name}/{f}"
                if f.endswith(".parquet") and os.path.getmtime(path) > 10_000:
                    os.utime(path, (1000 + i, 1000 + i))
        return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c_{name}").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        return spark.table(name)

    source.run, source.path = run, tmp_path
    yield source
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def shuffled(rows, rng, ts, end, parts=3):
    """rows in batches of neighbours in time, shuffled inside, the batches overlapping; then a row that ends the stream."""
    rows = sorted(rows, key=lambda r: r[ts] + timedelta(seconds=rng.uniform(-40, 40)))
    cut = [rows[i * len(rows) // parts : (i + 1) * len(rows) // parts] for i in range(parts)]
    for c in cut:
        rng.shuffle(c)
    return [*cut, [end], [end]]


def test_latches_under_disorder(spark, stream):
    rng = random.Random(3)
    shape = "server string, poll_ts timestamp, used_percent double"
    rows = [(f"s{i % 3}", at(i * 5), float(rng.randrange(70, 100))) for i in range(120)]
    late = [("s0", at(0) - timedelta(days=1), 99.0)]  # behind the watermark by far: dropped
    end = ("z", at(10**6), 0.0)
    batches = shuffled(rows, rng, 1, end)
    batches.insert(3, late)
    got = stream.run(e.log_full_alarm_in_order(stream("log", shape, *batches)), "latch").collect()
    want = p.log_full_alarm(spark.createDataFrame(rows, shape)).collect()
    assert sorted((x.server, x.poll_ts) for x in got) == sorted((x.server, x.poll_ts) for x in want) and len(want) > 5


def test_offender_debt_with_timers(spark, stream):
    rng = random.Random(5)
    polls = [at(t) for t in range(0, 3000, 20) if rng.random() < 0.9]
    rows = [(f"s{k}", t, who) for k in range(2) for t in polls for who in ("a", "b", "c", None) if who is None or (rng.random() < 0.5 and (who != "c" or t < at(200) or t > at(900)))]
    shape = "server string, poll_ts timestamp, identity string"
    end = ("s9", at(10**6), None)
    got = stream.run(e.offender_debt_stream(stream("debt", shape, *shuffled(rows + rows[:5], rng, 1, end)), 300), "debt")
    d = spark.createDataFrame(rows, shape)
    want = b.offender_debt(d.where("identity IS NOT NULL"), d, 300).drop("bucket")
    names = ["server", "identity", "debt_s", "polls", "first_seen", "last_seen"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect())) and want.count() > 6


def test_rule_debt_with_timers(spark, stream):
    rng = random.Random(6)
    rows = [("s", at(20 * i), rng.choice([51, 51, 52, None]), rng.choice([0, 0, 1, None]) if not 40 < i < 70 else None) for i in range(150)]
    shape = "server string, poll_ts timestamp, blocker_spid int, rule int"
    got = stream.run(e.rule_debt_stream(stream("rules", shape, *shuffled(rows, rng, 1, ("z", at(10**6), None, None)))), "rules")
    want = b.rule_debt(spark.createDataFrame(rows, shape))
    assert sorted((x.rule, x.debt_s, x.polls) for x in got.collect()) == sorted((x.rule, x.debt_s, x.polls) for x in want.collect())


def test_relief_of_two_streams(spark, stream):
    rng = random.Random(7)
    samples = [(f"s{k}", at(30 * i + k), rng.random() < 0.6, rng.random() < 0.75) for k in range(3) for i in range(80) if not 30 < i < 45]
    pauses = [(f"s{k}", at(95 * i + 7)) for k in range(3) for i in range(25)]
    sa, sb = "server string, pause_ts timestamp", "server string, poll_ts timestamp, blocked boolean, log_over boolean"
    end = at(10**6)
    got = stream.run(e.time_to_relief_stream(stream("pauses", sa, *shuffled(pauses, rng, 1, ("z", end))), stream("samples", sb, *shuffled(samples, rng, 1, ("z", end, True, True))), 120, 240), "relief").collect()
    want = p.time_to_relief(spark.createDataFrame(pauses, sa), spark.createDataFrame(samples, sb), 120, 240).collect()
    key = lambda rows: sorted((x.server, x.pause_ts, x.ended, x.relief_ts if x.ended == "relief" else None) for x in rows if x.server != "z" and x.ended)
    assert [x[:3] for x in key(got)] == [x[:3] for x in key(want)] and key(got) == key(want) and {"relief", "drain", "blind"} <= {x.ended for x in want}


def test_channels_merge_and_as_of(spark, stream):
    rng = random.Random(8)
    block = [("s", at(20 * i), rng.choice([None, True, False])) for i in range(60)]
    log = [("s", at(33 * i + 1), rng.choice([None, float(i)])) for i in range(36)]
    sa, sb = "server string, poll_ts timestamp, blocked boolean", "server string, poll_ts timestamp, used double"
    a, c = stream("block", sa, *shuffled(block, rng, 1, ("z", at(10**6), None))), stream("used", sb, *shuffled(log, rng, 1, ("z", at(10**6), None)))
    values = {"blocked": "boolean", "used": "double"}
    got = stream.run(e.merge_channels_stream(a, c, ["server"], values), "merged").where("server = 's'")
    want = p.merge_channels(spark.createDataFrame(block, sa), spark.createDataFrame(log, sb), ["server"]).select("server", "poll_ts", "blocked", "used")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    asked = stream.run(e.as_of_stream(a.select("server", "poll_ts"), c, ["server"], {"used": "double"}), "asof").where("server = 's'").collect()
    last = lambda t: next((u for _, s, u in reversed(log) if s <= t and u is not None), None)
    assert sorted((x.poll_ts, x.used) for x in asked) == [(t, last(t)) for _, t, _ in block]


def test_suppression_joins_two_streams(spark, stream):
    victims = [("s", at(10 * i), 60 + i % 3) for i in range(30)] + [("t", at(10 * i), 60) for i in range(5)]
    actions = [("s", 60, at(28), at(29), False), ("s", 61, at(100), None, False), ("s", 62, at(5), at(6), True), ("s", 60, at(31), at(32), False)]
    sa, sb = "server string, poll_ts timestamp, spid int", "server string, spid int, action_ts timestamp, done_ts timestamp, failed boolean"
    end = at(10**6)
    v = stream("victims", sa, *shuffled(victims, random.Random(1), 1, ("z", end, 0)))
    a = stream("actions", sb, *shuffled(actions, random.Random(2), 2, ("z", 0, end, end, True)))
    got = stream.run(e.suppress_recent_stream(v, a), "free").where("server <> 'z'").collect()
    want = b.suppress_recent(spark.createDataFrame(victims, sa), spark.createDataFrame(actions, sb)).collect()
    assert sorted((x.server, x.poll_ts, x.spid) for x in got) == sorted((x.server, x.poll_ts, x.spid) for x in want)
    assert {(x.spid, x.poll_ts) for x in want if x.server == "s"} == {(60 + i % 3, at(10 * i)) for i in range(30)} - {(60, at(30))} - {(61, at(10 * i)) for i in range(10, 30)}


def test_progress_in_order(spark, stream):
    rng = random.Random(9)
    rows = [(f"r{k}", at(20 * i + k), float(rng.choice([i, i, i, 2])), rng.choice([float(i), float(i), 1.0, 0.0, None])) for k in range(2) for i in range(50)]
    shape = "request string, poll_ts timestamp, elapsed_s double, pct double"
    got = stream.run(e.progress_eta_stream(stream("eta", shape, *shuffled(rows, rng, 1, ("z", at(10**6), 0.0, 0.0))), ["request"]), "eta").where("request <> 'z'").collect()
    want = p.progress_eta(spark.createDataFrame(rows, shape), ["request"]).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want))) and sum(x.eta_s is not None for x in want) > 20


def test_held_through_once(spark, stream):
    rows = [("s", at(i), 1 + i % 2, "l", "p") for i in range(40)]
    got = stream.run(e.held_through_stream(stream("held", "server string, poll_ts timestamp, spid int, login string, program string", rows[:20], rows[20:], rows[5:9])), "held").collect()
    assert sorted(x.spid for x in got) == [1, 2]


def test_blind_by_the_clock(spark, stream):
    shape = "channel string, poll_ts timestamp, failed boolean, cadence_s double"
    good = lambda c, s: (c, at(s), False, 0.1)
    polls = stream("polls", shape, [good("a", 0), good("b", 0), ("slow", at(0), False, 500.0)])
    q = e.blind_channels_stream(polls, ["channel"], 3).writeStream.format("memory").queryName("blind").option("checkpointLocation", f"{stream.path}/cb").trigger(processingTime="1 second").start()
    told = lambda: sorted((x.channel, x.event) for x in spark.table("blind").collect())

    def until(want):
        for _ in range(90):
            if told() == want:
                return
            time.sleep(1)
        raise AssertionError((told(), q.exception()))

    try:
        until([("a", "blind"), ("b", "blind")])
        stream("polls", shape, [good("a", 60), ("b", at(60), True, 0.1)])
        until([("a", "answering"), ("a", "blind"), ("a", "blind"), ("b", "blind")])  # b's poll failed; a is silent again
        assert spark.table("blind").where("event = 'answering'").first().silent_s == 60
    finally:
        q.stop()


def test_blind_in_batch_takes_now(spark):
    rows = [("a", at(0), False, 10), ("a", at(50), True, 10), ("a", at(200), False, 10), ("a", at(210), False, 10), ("b", at(0), False, 200), ("b", at(390), False, 200), ("c", at(500), False, 10), ("d", at(1), True, 10)]
    d = spark.createDataFrame(rows, "server string, poll_ts timestamp, failed boolean, cadence_s int")
    got = {(x.server, x.last_ok_ts, x.blind_ts, x.recovered_ts, x.silent_s) for x in p.blind_channels(d, ["server"], F.lit(at(600))).collect()}
    assert got == {("a", at(0), at(120), at(200), 200), ("a", at(210), at(330), None, 390)}
