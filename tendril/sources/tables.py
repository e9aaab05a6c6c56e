"""Parquet tables that are changed in place: partitions replaced, ranges walked, files compacted, files checked.

Every change is staged or written as a dynamic overwrite, so that a lost executor or driver leaves a table that the
same call finishes.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scratch
from ..operators import changes as c

#: Most paths that one job of a compaction reads, and the driver holds.
PATHS = 5000


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _same(parts: list[str], a: DataFrame, b: DataFrame) -> Column:
    on = F.lit(True)
    for p in parts:
        on = on & a[p].eqNullSafe(b[p])
    return on


def _replace(df: DataFrame, path: str, parts: list[str]) -> None:
    """Only partitions that df has rows of are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def _touched(table: DataFrame, hit: Column, parts: list[str]) -> tuple[DataFrame, int]:
    """Partitions with rows to change, written so that they stay what they were, and how many rows change."""
    t = scratch.table(table.where(hit).groupBy(*parts).agg(F.count("*").alias("_rows")), "touched")
    return t, t.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]


def apply_update(spark: SparkSession, path: str, parts: list[str], values: dict, condition: Column) -> int:
    """Sets literals on rows that match and need it, in place; returns how many. Partitions without such rows aren't read again or written.

    The rows of touched partitions are written beside them and swapped in when all are there; a second call changes nothing.
    """
    if set(values) & set(parts):
        raise ValueError(f"partition columns can't be set: {sorted(set(values) & set(parts))}")
    table = spark.read.parquet(path)
    new, hit = c.batch_update(table, values, condition)
    touched, affected = _touched(table, hit, parts)
    if affected:
        _replace(new.join(touched, _same(parts, new, touched), "left_semi"), path, parts)
    return affected


def apply_delete(spark: SparkSession, path: str, parts: list[str], condition: Column) -> int:
    """Removes rows for which the condition is true, in place; partitions that lose all rows go."""
    table = spark.read.parquet(path)
    hit = F.coalesce(condition, F.lit(False))
    touched, affected = _touched(table, hit, parts)
    if not affected:
        return 0
    kept = c.batch_delete(table, condition).join(touched, _same(parts, table, touched), "left_semi")
    full = scratch.table(table.join(touched, _same(parts, table, touched), "left_semi").groupBy(*parts).agg(F.count_if(~hit).alias("_left"), F.min(F.regexp_extract("_metadata.file_path", "^(.*)/", 1)).alias("_folder")), "left")
    _replace(kept, path, parts)
    fs, _ = _fs(spark, path)
    for row in full.where("_left = 0").select("_folder").toLocalIterator():
        fs.delete(_at(spark, row[0]), True)
    return affected


def rewrite_partition(spark: SparkSession, path: str, parts: list[str], where: Column, keys: list[str], codec: str = "zstd") -> None:
    """Rewrites the partitions that ``where`` (on partition columns) names, sorted by keys; the others stay as they are."""
    df = spark.read.parquet(path).where(where).repartition(*parts).sortWithinPartitions(*parts, *keys)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", codec).partitionBy(*parts).parquet(path)


def walk_key_ranges(
    spark: SparkSession, path: str, parts: list[str], key: str, batch_rows: int, values: dict, conditions: list[tuple], job: str, checkpoints: str,
    committed: Callable[[object], None] = lambda hi: None,
) -> int:
    """An update in successive ranges of a unique key: each range is committed, then its end saved, so a crash repeats one range at most.

    The position is kept in the table ``checkpoints`` (job, fingerprint, watermark, ts) and holds for this very
    statement only; another one starts over. Repeating a range changes nothing. Bounds of ranges come from the rows
    above the position, one range's at a time reaches the driver. committed: called between a commit and its saving.
    Returns how many rows this call changed.
    """
    statement = json.dumps([path, key, sorted(values.items()), conditions], default=str)
    fs, at = _fs(spark, checkpoints)
    shape = f"job string, fingerprint string, watermark {dict(spark.read.parquet(path).dtypes)[key]}, ts timestamp"
    saved = c.resume_watermark(spark.read.schema(shape).parquet(checkpoints), job, statement) if fs.exists(at) else None
    low, changed, condition = saved, 0, c.where(conditions)
    bounds = scratch.table(c.key_ranges(spark.read.parquet(path), key, batch_rows, condition, saved), "bounds")
    for row in bounds.orderBy("batch").toLocalIterator():
        inside = F.col(key) <= row.hi
        changed += apply_update(spark, path, parts, values, condition & (inside if low is None else inside & (F.col(key) > low)))
        committed(row.hi)
        mark = spark.range(1).select(F.lit(job).alias("job"), c.fingerprint(statement).alias("fingerprint"), F.lit(row.hi).alias("watermark"), F.current_timestamp().alias("ts"))
        spark.createDataFrame(mark.collect(), shape).coalesce(1).write.mode("append").parquet(checkpoints)
        low = row.hi
    scratch.drop(bounds)
    return changed


def _at(spark: SparkSession, file_path: str):
    """A Hadoop path of what ``_metadata.file_path`` says (a URI)."""
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file_path))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(folder, file, bytes) of a table's files, from their metadata: no column is read."""
    m = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size").distinct()
    return m.select(F.regexp_extract("file_path", "^(.*)/", 1).alias("folder"), F.col("file_path").alias("file"), F.col("file_size").alias("bytes"))


def first_fit(sizes: list[int], limit: int) -> list[int]:
    """The bin of each file, largest first, in the first bin with room; a file over the limit has its own."""
    room: list[int] = []
    bins = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = next((b for b, r in enumerate(room) if r >= sizes[i]), None)
        if at is None:
            at = len(room)
            room.append(limit)
        room[at] -= sizes[i]
        bins[i] = at
    return bins


def file_bins(files: DataFrame, target_mb: float) -> DataFrame:
    """(folder, bin, file, bytes) of files that get together: bins of one file need no work and are left out.

    A folder is binned in one task, of its files' names and sizes only.
    """
    limit = int(target_mb * (1 << 20))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("file").reset_index(drop=True)
        rows["bin"] = first_fit(rows["bytes"].tolist(), limit)
        rows = rows[rows["bytes"] < limit]
        return rows[rows.groupby("bin")["bin"].transform("size") > 1][["folder", "bin", "file", "bytes"]]

    return files.groupBy("folder").applyInPandas(fit, "folder string, bin long, file string, bytes long")


def recover(spark: SparkSession, path: str) -> int:
    """Finishes swaps of a compaction that ended between two of its steps; returns how many."""
    fs, at = _fs(spark, path)
    done = 0
    for s in fs.listStatus(at):
        name = s.getPath().getName()
        if name.startswith("_compact-"):
            journal = _fs(spark, f"{path}/{name}/journal")[1]
            if fs.exists(journal):
                _swap(spark, path, name)
                done += 1
            fs.delete(s.getPath(), True)
    return done


def _swap(spark: SparkSession, path: str, stage: str) -> None:
    fs, _ = _fs(spark, path)
    for row in spark.read.text(f"{path}/{stage}/journal").toLocalIterator():
        move = json.loads(row.value)
        new = _at(spark, move["new"])
        if fs.exists(new):  # else it was moved before
            fs.rename(new, _at(spark, move["to"]))
        for old in move["old"]:
            fs.delete(_at(spark, old), False)


def _marks(df: DataFrame, by: Column) -> dict:
    """Of each group: how many rows, and a sum of their hashes; ``by`` may be a path of ``_metadata``."""
    h = F.xxhash64(*df.columns).cast("decimal(38,0)")
    return {r[0]: (r[1], r[2]) for r in df.select(by.alias("_by"), h.alias("_h")).groupBy("_by").agg(F.count("*"), F.sum("_h")).toLocalIterator()}


def compact_files(spark: SparkSession, path: str, target_mb: float, paths: int = PATHS) -> int:
    """Puts a table's small files together, in their folders, up to ``target_mb``; returns how many files are gone.

    Sizes are read from the listing; files are binned by first-fit decreasing; only bins of several files are
    rewritten, a file each by a task each that holds no rows, in a hidden folder; rows and hashes of each bin must agree; a journal is written; then the new files
    are moved in and the old ones deleted, which ``recover`` can finish. A job reads at most about ``paths`` files, and
    the driver knows the names of no more. What is dense enough isn't touched, so a second call does nothing.
    """
    recover(spark, path)
    bins = scratch.table(file_bins(file_sizes(spark, path), target_mb), "bins")
    work = bins.groupBy("folder", "bin").agg(F.collect_list("file").alias("files"))
    gone, batch, held = 0, [], 0
    for row in work.orderBy("folder", "bin").toLocalIterator():
        batch.append(row)
        held += len(row.files)
        if held >= paths:
            gone += _compact(spark, path, batch)
            batch, held = [], 0
    gone += _compact(spark, path, batch) if batch else 0
    scratch.drop(bins)
    return gone


def _compact(spark: SparkSession, path: str, batch: list) -> int:
    stage = f"_compact-{uuid.uuid4().hex}"
    names = [(f, n) for n, row in enumerate(batch) for f in row.files]
    old = spark.read.parquet(*(_at(spark, f).toString() for f, _ in names))
    columns = old.columns  # without partition columns, which folders hold
    bins = spark.createDataFrame(names, "_file string, _bin int")  # at most ``paths`` rows and a bin
    tagged = old.select("*", F.col("_metadata.file_path").alias("_file")).join(F.broadcast(bins), "_file").drop("_file")
    # a task has one bin and writes its rows as they come: nothing is sorted or held
    tagged.repartitionById(len(batch), F.col("_bin")).select(columns).write.parquet(f"{path}/{stage}/files")
    at = F.col("_metadata.file_path")
    written = _marks(spark.read.parquet(f"{path}/{stage}/files"), at)
    made = {int(re.search(r"/part-(\d+)-[^/]*$", f)[1]): f for f in written}
    if len(made) != len(written):
        raise ValueError(f"{path}: a bin has become several files")
    which, before = dict(names), {}
    for f, (n, h) in _marks(old, at).items():
        was = before.get(which[f], (0, 0))
        before[which[f]] = (was[0] + n, was[1] + h)
    if before != {n: written[f] for n, f in made.items()}:
        raise ValueError(f"{path}: the compacted files don't hold the same rows")
    # a bin of files without rows has no new file, and keeps its own
    moves = [json.dumps({"new": f, "to": f"{batch[n].folder}/part-{uuid.uuid4().hex}.parquet", "old": list(batch[n].files)}) for n, f in made.items()]
    spark.createDataFrame([(m,) for m in moves], "value string").coalesce(1).write.text(f"{path}/{stage}/journal")
    _swap(spark, path, stage)
    fs, at = _fs(spark, f"{path}/{stage}")
    fs.delete(at, True)
    spark.catalog.refreshByPath(path)
    return sum(len(batch[n].files) - 1 for n in made)


def _shown(c: str) -> Column:
    """A path as both listings write it."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(c, r"\+", "%2B")), "^([a-z]+):/+", "$1:/")


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    for batch in batches:
        rows = []
        for content in batch.column("content"):
            try:
                rows.append(pq.ParquetFile(pa.BufferReader(content.as_buffer())).metadata.num_rows)
            except (pa.ArrowException, OSError):
                rows.append(None)
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(rows, pa.int64())], ["path", "rows"])


def unreadable_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, problem, rows) of Parquet files of that schema that can't be read, wholly or to their end; rows: how many are lost, NULL if nobody knows.

    Rows of each file are counted twice: from footers, and with all columns decoded and checksums of pages verified,
    where a damaged file ends early instead of failing the job. A file of which neither shows rows is opened in a task, which tells an empty one from
    one without a footer.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    names = listed.select(_shown("path").alias("file"), "path")
    df = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("parquet.page.verify-checksum.enabled", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    each = lambda d, name: d.groupBy(_shown("_metadata.file_path").alias("file")).agg(F.count("*").alias(name))
    whole = each(df, "expected")
    seen = df.select(F.xxhash64(*df.columns).alias("h"), "_metadata.file_path").groupBy(_shown("file_path").alias("file")).agg(F.sum((F.col("h") != 0).cast("long") + (F.col("h") == 0).cast("long")).alias("decoded"))  # a count would not look at h
    both = names.join(whole, "file", "left").join(seen, "file", "left")
    odd = scratch.table(both.where("expected IS NULL"), "odd")
    checked = listed.join(odd.select("path"), "path", "left_semi").select("path", "content").mapInArrow(_footers, "path string, rows long")
    footless = odd.join(checked, "path", "left").where("rows IS NULL OR rows > 0").select("file", F.lit("unreadable file").alias("problem"), "rows")
    cut = both.where("expected > coalesce(decoded, 0)").select("file", F.lit("unreadable rows").alias("problem"), (F.col("expected") - F.coalesce("decoded", F.lit(0))).alias("rows"))
    return footless.unionByName(cut)


def unreadable_records(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    """(file, problem, rows): how many records (lines) of each text file, json or csv, don't fit the schema."""
    lines = spark.read.text(path).where("trim(value) <> ''").select("value", _shown("_metadata.file_path").alias("file"))
    parse = F.from_json if kind == "json" else F.from_csv
    record = parse("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    bad = lines.where(record["_corrupt"].isNotNull())
    return bad.groupBy("file").agg(F.count("*").alias("rows")).select("file", F.lit("unreadable record").alias("problem"), "rows")


def partition_statistics(df: DataFrame, columns: list[str], parts: list[str]) -> DataFrame:
    """(parts, column_name, rows, nulls, low, high, distinct, spread) of each partition: the last two are sketches that can be merged.

    low and high are text; spread is NULL unless the column is a number. Keep the rows; when a partition changes, its
    rows alone are made anew, and ``merge_statistics`` has the table's.
    """
    types = dict(df.dtypes)
    aggs = [F.count("*").alias("rows")]
    for x in columns:
        numeric = types[x] in ("tinyint", "smallint", "int", "bigint", "float", "double") or types[x].startswith("decimal")
        spread = F.kll_sketch_agg_double(F.col(x).cast("double")) if numeric else F.lit(None).cast("binary")
        aggs += [F.count_if(F.col(x).isNull()).alias(f"n_{x}"), F.min(x).cast("string").alias(f"a_{x}"), F.max(x).cast("string").alias(f"b_{x}"), F.hll_sketch_agg(F.col(x).cast("string")).alias(f"d_{x}"), spread.alias(f"s_{x}")]
    named = {"nulls": "n", "low": "a", "high": "b", "distinct": "d", "spread": "s"}
    number = lambda x: types[x] not in ("string", "binary", "boolean", "date", "timestamp", "timestamp_ntz")
    each = F.array(*(F.struct(F.lit(x).alias("column_name"), F.lit(number(x)).alias("is_number"), F.col("rows"), *(F.col(f"{k}_{x}").alias(n) for n, k in named.items())) for x in columns))
    return df.groupBy(*parts).agg(*aggs).select(*parts, F.explode(each).alias("x")).select(*parts, "x.*")


def merge_statistics(statistics: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column_name, rows, nulls, low, high, distinct, quantiles) of the whole table from its partitions' rows; no data is read.

    distinct is an estimate (some 2 % off), quantiles are those of a sketch (rank some 1 % off), NULL for what is no number.
    """
    low = F.when(F.first("is_number"), F.min(F.expr("try_cast(low AS decimal(38, 9))")).cast("double").cast("string")).otherwise(F.min("low"))
    high = F.when(F.first("is_number"), F.max(F.expr("try_cast(high AS decimal(38, 9))")).cast("double").cast("string")).otherwise(F.max("high"))
    g = statistics.groupBy("column_name").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), low.alias("low"), high.alias("high"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"), F.kll_merge_agg_double("spread").alias("s"), F.count("spread").alias("k")
    )
    at = [F.when((F.col("k") > 0) & (F.kll_sketch_get_n_double("s") > 0), F.kll_sketch_get_quantile_double("s", F.lit(q))) for q in quantiles]
    return g.select("column_name", "rows", "nulls", "low", "high", "distinct", F.array(*at).alias("quantiles"))


def quantile_ranks(df: DataFrame, merged: DataFrame) -> DataFrame:
    """(column_name, n, below, upto) of rows of ``merge_statistics``: df's numbers in all, and of each quantile those below it and up to it; NULL for no number.

    One pass counts them where they are, so no task holds values; the driver has merged's rows, one a column.
    """
    each = []
    for name, quantiles in merged.select("column_name", "quantiles").collect():
        x, known = F.col(name).try_cast("double"), [F.lit(q) for q in quantiles]
        count = lambda tests: F.array(*(F.when(q.isNotNull(), F.count_if(t)) for q, t in zip(known, tests, strict=True)))  # noqa: B023, E731
        each.append(F.struct(F.lit(name).alias("column_name"), F.count(x).alias("n"), count([x < q for q in known]).alias("below"), count([x <= q for q in known]).alias("upto")))
    none = "array<struct<column_name: string, n: bigint, below: array<bigint>, upto: array<bigint>>>"
    return df.agg((F.array(*each) if each else F.array()).cast(none).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def sampled_files(df: DataFrame, share: float) -> DataFrame:
    """Rows of about that share of df's files, whole files at a time: the others aren't opened."""
    return df.where(F.pmod(F.xxhash64("_metadata.file_path"), F.lit(1_000_000)) < int(share * 1_000_000))
