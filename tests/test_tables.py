import json
import os

import pytest
from pyspark.sql import functions as F

from tendril.operators import changes as c
from tendril.queries import QUERIES
from tendril.sources import tables as t


def numbers(spark, path, n=4000, parts=4):
    d = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("s"), (F.col("id") * 37 % 101).cast("double").alias("v"), F.when(F.col("id") < 10, None).otherwise((F.col("id") * parts / n).cast("int")).alias("p"))
    d.write.partitionBy("p").parquet(str(path))
    return spark.read.parquet(str(path))


def stamps(path):
    return {f"{d}/{f}": os.path.getmtime(f"{d}/{f}") for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_updates_replace_touched_partitions_only(spark, tmp_path):
    path = tmp_path / "t"
    before = {tuple(x) for x in numbers(spark, path).collect()}
    old = stamps(path)
    want = {(k, "x" if k >= 3990 else s, v, p) for k, s, v, p in before}
    assert t.apply_update(spark, str(path), ["p"], {"s": "x"}, F.col("k") >= 3990) == 10
    assert {tuple(x) for x in spark.read.parquet(str(path)).collect()} == want
    new = stamps(path)
    assert {f for f in old if "p=3" not in f} == {f for f in new if "p=3" not in f} and not {f for f in new if "p=3" in f} & set(old)
    assert t.apply_update(spark, str(path), ["p"], {"s": "x"}, F.col("k") >= 3990) == 0 and stamps(path) == new
    assert t.apply_update(spark, str(path), ["p"], {"s": "y"}, F.col("p").isNull()) == 10
    with pytest.raises(ValueError, match="partition"):
        t.apply_update(spark, str(path), ["p"], {"p": 1}, F.lit(True))


def test_deletes_drop_empty_partitions(spark, tmp_path):
    path = tmp_path / "t"
    rows = {tuple(x) for x in numbers(spark, path).collect()}
    assert t.apply_delete(spark, str(path), ["p"], (F.col("p") == 2) | (F.col("k") == 5) | (F.col("v") > 1000)) == 1001
    spark.catalog.refreshByPath(str(path))
    assert {tuple(x) for x in spark.read.parquet(str(path)).collect()} == {x for x in rows if x[3] != 2 and x[0] != 5}
    assert not (path / "p=2").exists()
    assert t.apply_delete(spark, str(path), ["p"], F.lit(None).cast("boolean")) == 0


def test_a_walk_that_crashes_goes_on(spark, tmp_path):
    path, marks = str(tmp_path / "t"), str(tmp_path / "marks")
    rows = {tuple(x) for x in numbers(spark, path, 1000).collect()}
    walk = lambda **more: t.walk_key_ranges(spark, path, ["p"], "k", 150, {"s": "done"}, [("v", ">=", 20.0)], "job", marks, **more)
    seen = []

    def crash(hi):
        seen.append(hi)
        if len(seen) == 3:  # committed, not saved
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        walk(committed=crash)
    saved = spark.read.parquet(marks).agg(F.max("watermark")).first()[0]
    assert saved == seen[1] < seen[2]
    again = []
    left = walk(committed=again.append)
    assert again[0] > saved and again[-1] == max(k for k, _, v, _ in rows if v >= 20) and min(again) >= seen[2]
    want = {(k, "done" if v >= 20 else s, v, p) for k, s, v, p in rows}
    assert {tuple(x) for x in spark.read.parquet(path).collect()} == want
    assert left == sum(1 for k, s, v, _ in rows if v >= 20 and k > seen[2])  # the repeated range changed nothing
    assert walk() == 0
    assert t.walk_key_ranges(spark, path, ["p"], "k", 150, {"s": "other"}, [("v", ">=", 20.0)], "job", marks) == sum(v >= 20 for _, _, v, _ in rows)  # another statement starts over


def test_partitions_are_rewritten_sorted(spark, tmp_path):
    path = tmp_path / "t"
    rows = sorted(map(str, numbers(spark, path).collect()))
    old = stamps(path)
    t.rewrite_partition(spark, str(path), ["p"], F.col("p") == 1, ["v", "k"])
    assert sorted(map(str, spark.read.parquet(str(path)).collect())) == rows
    assert {f for f in old if "p=1" not in f} == {f for f in stamps(path) if "p=1" not in f}
    (one,) = [f for f in stamps(path) if "p=1" in f]
    got = [(x.v, x.k) for x in spark.read.parquet(one).collect()]
    assert got == sorted(got) and len(got) == 1000


def test_first_fit_decreasing():
    assert t.first_fit([5, 9, 4, 1, 20, 6], 10) == [3, 1, 2, 1, 0, 2]
    assert t.first_fit([], 10) == []


def test_compaction_by_bins(spark, tmp_path):
    path = tmp_path / "t"
    d = spark.range(60_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s"), (F.col("id") % 2).alias("p q"))
    d.repartition(12).write.partitionBy("p q").parquet(str(path))
    d.where("`p q` = 1").selectExpr("id + 60000 AS id", "concat(s, s) AS s", "`p q`").coalesce(1).write.mode("append").partitionBy("p q").parquet(str(path))
    mark = lambda: tuple(spark.read.parquet(str(path)).agg(F.count("*"), F.sum(F.xxhash64("id", "s", "p q").cast("decimal(38,0)"))).first())
    before, files = mark(), stamps(path)
    large = max(files, key=os.path.getsize)
    target = os.path.getsize(large) / (1 << 20) * 0.9
    gone = t.compact_files(spark, str(path), target, paths=7)
    assert gone > 10 and mark() == before and len(stamps(path)) == len(files) - gone
    assert large in stamps(path)  # dense enough
    small = [f for f in files if f != large]
    assert not [f for f in stamps(path) if f in small] or len(stamps(path)) < len(files)
    assert t.compact_files(spark, str(path), target) == 0 and not [x for x in os.listdir(path) if x.startswith("_compact")]


def test_compaction_sorts_nothing(spark, tmp_path, monkeypatch):
    path = tmp_path / "t"
    d = spark.range(20_000).select("id", (F.col("id") % 5).alias("p"))
    d.repartition(6).write.partitionBy("p").parquet(str(path))
    before = {tuple(x) for x in spark.read.parquet(str(path)).collect()}

    def no(*_):
        raise AssertionError("a task would hold a whole bin")

    monkeypatch.setattr(type(d), "sortWithinPartitions", no)
    monkeypatch.setattr(type(d.write), "partitionBy", no)
    assert t.compact_files(spark, str(path), 64) == 25
    assert {tuple(x) for x in spark.read.parquet(str(path)).collect()} == before and len(stamps(path)) == 5
    spark.range(0).select("id").coalesce(1).write.parquet(str(path / "p=9"))
    spark.range(0).select("id").coalesce(1).write.mode("append").parquet(str(path / "p=9"))
    assert t.compact_files(spark, str(path), 64) == 0 and {tuple(x) for x in spark.read.parquet(str(path)).collect()} == before


def test_a_swap_that_crashes_is_finished(spark, tmp_path, monkeypatch):
    path = tmp_path / "t"
    spark.range(1000).repartition(6).write.parquet(str(path))
    real = t._swap

    def half(sp, p, stage):
        journal = [json.loads(r.value) for r in sp.read.text(f"{p}/{stage}/journal").collect()]
        fs, _ = t._fs(sp, p)
        fs.rename(t._at(sp, journal[0]["new"]), t._at(sp, journal[0]["to"]))
        raise RuntimeError("lost")

    monkeypatch.setattr(t, "_swap", half)
    with pytest.raises(RuntimeError, match="lost"):
        t.compact_files(spark, str(path), 64)
    monkeypatch.setattr(t, "_swap", real)
    assert t.recover(spark, str(path)) == 1
    assert sorted(x.id for x in spark.read.parquet(str(path)).collect()) == list(range(1000)) and len(stamps(path)) == 1


def test_unreadable_files_are_rows(spark, tmp_path):
    path = tmp_path / "t"
    spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s")).repartition(4).write.parquet(str(path))
    spark.range(0).select("id", F.lit("").alias("s")).coalesce(1).write.mode("append").parquet(str(path))
    assert t.unreadable_files(spark, str(path), "id long, s string").collect() == []
    files = sorted((f for f in stamps(path) if spark.read.parquet(f).count()), key=os.path.basename)
    for f in files[:2]:
        crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        os.path.exists(crc) and os.remove(crc)
    data = open(files[0], "rb").read()
    open(files[0], "wb").write(data[: len(data) // 2])  # no footer
    data = bytearray(open(files[1], "rb").read())
    data[2000:9000] = b"\xff" * 7000  # pages that don't decode
    open(files[1], "wb").write(data)
    got = {os.path.basename(x.file): (x.problem, x.rows) for x in t.unreadable_files(spark, str(path), "id long, s string").collect()}
    assert set(got) == {os.path.basename(f) for f in files[:2]}
    assert got[os.path.basename(files[0])] == ("unreadable file", None) and got[os.path.basename(files[1])][0] == "unreadable rows" and got[os.path.basename(files[1])][1] > 0


def test_unreadable_records_by_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}\n{"x": "no"}\nnot json\n')
    (tmp_path / "b.json").write_text('{"x": 2}\n')
    assert [(os.path.basename(x.file), x.problem, x.rows) for x in t.unreadable_records(spark, str(tmp_path), "x int").collect()] == [("a.json", "unreadable record", 2)]


def test_statistics_are_merged_from_partitions(spark, tmp_path):
    d = numbers(spark, tmp_path / "t")
    each = t.partition_statistics(d, ["k", "s"], ["p"])
    kept = each.where("p = 1").unionByName(t.partition_statistics(d.where("p <> 1 OR p IS NULL"), ["k", "s"], ["p"]))  # one partition's rows made apart
    got = {x.column_name: x for x in t.merge_statistics(kept).collect()}
    k, s = got["k"], got["s"]
    assert (k.rows, k.nulls, float(k.low), float(k.high)) == (4000, 0, 0.0, 3999.0) and abs(k.distinct - 4000) < 150
    assert all(abs(q - w) < 80 for q, w in zip(k.quantiles, (1000, 2000, 3000), strict=True))
    assert (s.low, s.high, s.distinct, s.quantiles) == ("0", "6", 7, [None] * 3)
    assert t.merge_statistics(each.limit(0)).collect() == []


def test_ranks_of_quantiles_are_counted(spark):
    d = spark.range(10_000).selectExpr("CASE WHEN id % 10 > 0 THEN id DIV 4 END AS k", "concat('s', id % 3) AS s")
    merged = spark.createDataFrame([("k", [500.0, None, 3000.0]), ("s", [None, None, None])], "column_name string, quantiles array<double>")
    ranks = t.quantile_ranks(d, merged)
    values = [i // 4 for i in range(10_000) if i % 10]
    got = {x.column_name: (x.n, x.below, x.upto) for x in ranks.collect()}
    assert got == {"k": (9000, [sum(v < 500 for v in values), None, 9000], [sum(v <= 500 for v in values), None, 9000]), "s": (0, [None] * 3, [None] * 3)}
    assert t.quantile_ranks(d, merged.limit(0)).collect() == []


def test_merged_statistics_hold_no_values(spark, tmp_path):
    d = spark.range(20_000).selectExpr("id AS o_orderkey", "CAST(id % 3 AS string) AS o_orderstatus", "CAST(id * 37 % 9973 AS double) AS o_totalprice", "CAST(id % 5 AS string) AS o_orderpriority")
    d.write.parquet(str(tmp_path / "orders.parquet"))
    found = QUERIES["merged_statistics"](spark, str(tmp_path))
    assert {tuple(x) for x in found.collect()} == {(c, 20_000, 0, True) for c in ("o_orderkey", "o_orderstatus", "o_totalprice")}
    assert "percentile" not in found._jdf.queryExecution().executedPlan().toString()  # an exact one keeps every distinct value in a task


def test_sampling_takes_whole_files(spark, tmp_path):
    spark.range(1000).repartition(40).write.parquet(str(tmp_path / "t"))
    d = spark.read.parquet(str(tmp_path / "t"))
    got = t.sampled_files(d, 0.5).select("id", F.col("_metadata.file_path").alias("f"))
    files = {x.f for x in got.collect()}
    assert 8 <= len(files) <= 32 and got.count() == d.select("id", F.col("_metadata.file_path").alias("f")).where(F.col("f").isin(list(files))).count()
    assert t.sampled_files(d, 1.0).count() == 1000


def test_statements_have_fingerprints(spark):
    assert spark.range(1).select(c.fingerprint("a  b") == c.fingerprint("a b")).first()[0]
