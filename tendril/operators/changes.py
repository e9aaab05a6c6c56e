"""Bulk table changes: guarded, idempotent updates and deletes, key ranges, layout, statistics, integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scratch

OPERATORS = {
    "=": lambda c, v: c == v, "<>": lambda c, v: c != v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
}


def where(conditions: list[tuple]) -> Column:
    """AND of (column, operator[, value]); null tests take no value, all others need one."""
    parts = []
    for name, op, *value in conditions:
        op = op.lower()
        if op in ("is null", "is not null"):
            if value:
                raise ValueError(f"{op} takes no value")
            parts.append(F.col(name).isNull() if op == "is null" else F.col(name).isNotNull())
        elif op not in OPERATORS or len(value) != 1 or value[0] is None:
            raise ValueError(f"condition {name} {op} {value}")
        else:
            parts.append(OPERATORS[op](F.col(name), F.lit(value[0])))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def self_limit(values: dict) -> Column:
    """The row still needs work: a target is NULL or another value."""
    need = [F.col(k).isNotNull() if v is None else F.col(k).isNull() | (F.col(k) != F.lit(v)) for k, v in values.items()]
    return reduce(lambda a, b: a | b, need)


def batch_update(df: DataFrame, values: dict, condition: Column) -> tuple[DataFrame, Column]:
    """df with literals set on rows that match and need it; and the predicate, whose count_if is what is affected."""
    hit = F.coalesce(condition & self_limit(values), F.lit(False))
    types = dict(df.dtypes)
    out = df.withColumn("_hit", hit)
    for k, v in values.items():
        out = out.withColumn(k, F.when(F.col("_hit"), F.lit(v).cast(types[k])).otherwise(F.col(k)))
    return out.drop("_hit"), hit


def batch_delete(df: DataFrame, condition: Column) -> DataFrame:
    """Rows where the predicate is true go; unknown ones stay."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def key_ranges(df: DataFrame, key: str, batch_rows: int, condition: Column, watermark=None) -> DataFrame:
    """(batch, lo, hi, rows): bounds of successive batches of matching keys above the watermark.

    Keys are cut into ranges where a sample says, and numbered in their range; prefix sums of the ranges' counts make
    the numbers global, so no task orders the whole table, however its keys are spread.
    """
    k = df.where(F.coalesce(condition, F.lit(False))).select(F.col(key).alias("k")).where("k IS NOT NULL")
    k = k.where(F.col("k") > watermark) if watermark is not None else k
    k = scratch.ranged(k, "k", name="keys")
    before = k.groupBy("g").count()  # a row a range
    before = before.select("g", (F.sum("count").over(W.orderBy("g")) - F.col("count")).alias("before"))
    n = F.row_number().over(W.partitionBy("g").orderBy("k")) + F.col("before") - 1
    batches = k.join(before, "g").withColumn("batch", F.floor(n / batch_rows)).groupBy("batch")
    return batches.agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("rows"))


def key_range_update(df: DataFrame, key: str, lo, hi, values: dict, condition: Column) -> tuple[DataFrame, Column]:
    return batch_update(df, values, condition & (F.col(key) > lo) & (F.col(key) <= hi))


def fingerprint(statement: str) -> Column:
    return F.sha2(F.lit(" ".join(statement.split())), 256)


def resume_watermark(checkpoints: DataFrame, job: str, statement: str):
    """The last position saved for this very statement, or None."""
    got = checkpoints.where((F.col("job") == job) & (F.col("fingerprint") == fingerprint(statement))).agg(F.max_by("watermark", "ts")).first()
    return got[0]


def resume_watermarks(checkpoints: DataFrame, statement: str) -> DataFrame:
    """(job, watermark) of every job that saved a position for this very statement; the others start over."""
    return checkpoints.where(F.col("fingerprint") == fingerprint(statement)).groupBy("job").agg(F.max_by("watermark", "ts").alias("watermark"))


def spared_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that a filter spares; unknown ones are spared."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def key_range_key(keys: DataFrame) -> DataFrame:
    """Of (table, column, is_integer, is_unique, ordinal): the key that a table can be walked on, or the reason why not."""
    g = keys.groupBy("table").agg(F.count("column").alias("n"), F.first("column").alias("column"), F.bool_and("is_integer").alias("i"), F.bool_and("is_unique").alias("u"))
    why = F.when(F.col("n") == 0, "heap").when(F.col("n") > 1, "composite key").when(~F.col("i"), "not an integer").when(~F.col("u"), "not unique")
    return g.select("table", F.when(why.isNull(), F.col("column")).alias("key"), why.alias("reason"))


def spared_count(df: DataFrame, condition: Column, limit: int | None = 1000) -> DataFrame:
    """One row (spared): how many rows a filter spares, counted up to a limit, after which reading stops; without one, all."""
    rows = spared_rows(df, condition).select(F.lit(1))
    return (rows if limit is None else rows.limit(limit)).agg(F.count("*").alias("spared"))


def unmatched_rows(df: DataFrame, condition: Column, limit: int = 1000) -> int:
    return spared_count(df, condition, limit).first()[0]


def untouched_rows(df: DataFrame, values: dict, condition: Column, limit: int = 1000) -> int:
    return unmatched_rows(df, condition & self_limit(values), limit)


def selectivity_guard(counts: DataFrame, limit: int = 1000) -> DataFrame:
    """Of (spared, op_spared): FAIL where neither spares a row, WARN where one spares none or both fewer than the limit."""
    s, o = F.col("spared"), F.col("op_spared")
    return counts.withColumn("severity", F.when((s == 0) & (o == 0), "FAIL").when((s == 0) | (s < limit), "WARN").otherwise("PASS"))


def batch_progress(batches: DataFrame, estimate: int, keys: tuple[str, ...] = ("job",)) -> DataFrame:
    """Of (job, batch, rows, seconds): rows done, share of the estimate up to 1 (1 if unknown), rows a second."""
    done = F.sum("rows").over(W.partitionBy(*keys).orderBy("batch"))
    d = batches.withColumn("done", done)
    share = F.least(F.lit(1.0), F.col("done") / estimate) if estimate > 0 else F.lit(1.0)
    return d.withColumn("share", share).withColumn("rate", F.when(F.col("seconds") > 0, F.col("rows") / F.col("seconds")))


def rewrite_table(df: DataFrame, path: str, keys: list[str], codec: str = "zstd", files: int | None = None) -> None:
    """Writes df sorted by keys and compressed, in ``files`` parts or as many as a shuffle has; the target is another path than df's."""
    (df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)).sortWithinPartitions(*keys).write.mode("overwrite").option("compression", codec).parquet(path)


def update_statistics(df: DataFrame, columns: list[str], sample: float | None = None) -> DataFrame:
    """(column_name, rows, nulls, low, high, distinct, median) of each column, in one pass.

    distinct is an estimate (2 % off); median, of numbers only, is of the rank that a sketch of 10,000 steps gives.
    sample: a share of the rows.
    """
    d = df.sample(sample, 7) if sample else df
    number = {c: k for c, k in df.dtypes if k in ("tinyint", "smallint", "int", "bigint", "float", "double") or k.startswith("decimal")}
    middle = lambda c: F.percentile_approx(c, 0.5).cast("double") if c in number else F.lit(None).cast("double")
    aggs = [F.count("*").alias("rows")] + [
        x for c in columns for x in (F.count_if(F.col(c).isNull()).alias(f"n_{c}"), F.min(c).cast("string").alias(f"a_{c}"), F.max(c).cast("string").alias(f"b_{c}"), F.approx_count_distinct(c, 0.02).alias(f"d_{c}"), middle(c).alias(f"m_{c}"))
    ]
    named = {"nulls": "n", "low": "a", "high": "b", "distinct": "d", "median": "m"}
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("rows"), *(F.col(f"{k}_{c}").alias(name) for name, k in named.items())) for c in columns))
    return d.agg(*aggs).select(F.explode(each).alias("x")).select("x.*")


def add_constraint(df: DataFrame, columns: list[str], primary: bool = True) -> DataFrame:
    """Keys that violate it: repeated, or for a primary key NULL."""
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where((F.col("n") > 1) | (null if primary else F.lit(False)))


def integrity_check(df: DataFrame, key: str, ranges: dict[str, tuple], parent: DataFrame, parent_key: str, foreign: str) -> DataFrame:
    """(rule, bad): null keys, repeated keys, values out of range, rows without a parent."""
    out = [F.count_if(F.col(key).isNull()).alias("null key")] + [F.count_if(~F.col(c).between(a, b)).alias(f"range {c}") for c, (a, b) in ranges.items()]
    one = df.agg(*out)
    names = F.array(*(F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("bad")) for c in one.columns))
    twice = df.groupBy(key).count().where("count > 1").agg(F.count("*").alias("bad")).select(F.lit("repeated key").alias("rule"), "bad")
    lost = df.join(parent.select(F.col(parent_key).alias(foreign)), foreign, "left_anti").agg(F.count("*").alias("bad")).select(F.lit("orphan").alias("rule"), "bad")
    return one.select(F.explode(names).alias("x")).select("x.*").unionByName(twice).unionByName(lost)


def add_column(df: DataFrame, name: str, kind: str, default=None) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(default).cast(kind))


def alter_column(df: DataFrame, name: str, kind: str, nullable: bool = True) -> DataFrame:
    """Changes a column's type; a value that doesn't convert, or a NULL where none may be, fails the job."""
    new = F.col(name).try_cast(kind)
    bad = F.col(name).isNotNull() & new.isNull() if nullable else new.isNull()
    return df.withColumn(name, F.when(bad, F.raise_error(F.concat(F.lit(f"{name} doesn't convert: "), F.coalesce(F.col(name).cast("string"), F.lit("NULL")))).cast(kind)).otherwise(new))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


def table_row_estimate(stats: DataFrame) -> DataFrame:
    return stats.groupBy("object_id").agg(F.coalesce(F.sum(F.when(F.col("index_id").isin(0, 1), F.col("row_count"))), F.lit(0)).alias("rows"))
