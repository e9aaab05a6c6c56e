"""Mixing sources to target weights: certain whole copies, then Pareto order samples of fixed sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scratch
from .words import SPLIT

#: Steps in which a stratum's ranking is counted before its few boundary rows are ranked one by one; strata a doubling of size.
STEPS, STRATA = 256, 8
#: Copies of a row that one task writes at most.
TOGETHER = 256


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, SPLIT), "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, most: float = 3.0) -> DataFrame:
    """Of (source, source_size): adds sid, weight and target.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes; a target stops
    at ``most`` times its source's size and the excess goes to the others by weight. In the order of cap per weight,
    all sources before the first that stays under its share are capped, so one pass over the sources finds the level.
    """
    one = W.orderBy(F.col("source").isNull(), "source")
    s = sources.withColumn("sid", F.row_number().over(one) - 1).withColumn("weight", (F.col("sid") % 3 + 1).cast("double"))
    s = s.withColumn("cap", most * F.col("source_size"))
    by = W.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    s = s.withColumn("level", F.when(F.col("capped"), F.lit(None)).otherwise(F.col("level")))
    share = F.first("level", ignorenulls=True).over(W.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * share)).select("source", "source_size", "sid", "weight", "target")


def hashed(c: Column, seed: int) -> Column:
    """A number inside (0, 1) by a hash."""
    return (F.shiftrightunsigned(F.xxhash64(c, F.lit(seed)), 11) + 0.5) / float(1 << 53)


def inclusion(sizes: DataFrame) -> DataFrame:
    """Of (sid, missing, size, n: documents of that size): adds ``p``, the inclusion probability of a document of the size.

    p is in proportion to size and 1 at most; the factor is such that the expected words make ``missing``. Of the
    sizes that could be the largest uncertain one, the largest is: all above it are certain.
    """
    up = W.partitionBy("sid").orderBy("size")
    words = F.sum(F.col("n") * F.col("size")).over(W.partitionBy("sid"))
    below = F.sum(F.col("n") * F.col("size")).over(up)
    s = sizes.withColumn("sure", words - below).withColumn("squares", F.sum(F.col("n") * F.col("size").cast("double") * F.col("size")).over(up))
    s = s.withColumn("c", (F.col("missing") - F.col("sure")) / F.col("squares"))
    fits = (F.col("c") > 0) & (F.col("c") * F.col("size") <= 1)
    c = F.max(F.when(fits, F.struct("size", "c"))).over(W.partitionBy("sid"))
    return s.withColumn("top", c).withColumn("p", F.when(F.col("size") > F.col("top.size"), 1.0).otherwise(F.col("size") * F.col("top.c"))).drop("sure", "squares", "c", "top")


def _sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, row): row is a hash of all that the row holds, but for maps, which have none."""
    every = [docs[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), n_words(docs["text"]).alias("size"), F.xxhash64(*every).alias("row"))


def mix(docs: DataFrame, seed: int = 17, most: float = 3.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, part, row) of every row of docs; taken = copies * size.

    A source whose target is r times its size gives floor(r) certain copies of each document. What is missing is a
    Pareto order sample of unequal probabilities: a document's inclusion probability ``part`` is in proportion to its
    size, 1 at most (then the copy is certain), and the expected words make what is missing. Sizes are cut into
    strata, STRATA a doubling; a stratum's sample has a fixed size, the probabilities' sum rounded so that what is
    rounded off is carried to the next stratum, from a random start. Documents are ranked by the odds of a random
    number, a hash of the row and the seed, over the odds of their inclusion, and the first so many are taken.
    Copies never exceed ``most``. Null texts have size 0 and are never sampled; null is a source of its own; rows that
    repeat are ranked each; an empty table gives no rows. Reruns agree. ``row`` is a hash of the row.

    No task ranks a whole source: counts over STEPS parts of a stratum's ranking show the one part in which the sample ends.
    """
    own = scratch.table(_sized(docs), "sizes")
    sizes = scratch.table(own.groupBy("source", "size").agg(F.count("*").alias("n")), "by_size")
    sources = scratch.table(targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), most), "sources")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    s = sources.withColumn("whole", F.floor(ratio + 1e-9).cast("long")).withColumn("missing", F.greatest(F.lit(0.0), ratio - F.col("whole")) * F.col("source_size"))
    s = s.select(F.col("source").alias("named"), "source_size", "sid", "target", "whole", "missing")
    named = F.col("source").eqNullSafe(F.col("named"))
    bands = inclusion(sizes.where("size > 0").join(s, named).where("missing > 0").select("source", "sid", "missing", "size", "n"))
    bands = bands.withColumn("band", F.when(F.col("p") < 1, F.floor(F.log2("size") * STRATA).cast("int")))
    bands = scratch.table(bands.select(F.col("source").alias("of"), F.col("size").alias("sized"), "sid", "n", "p", "band"), "bands")
    sums = bands.where("band IS NOT NULL").groupBy("sid", "band").agg(F.sum(F.col("n") * F.col("p")).alias("sum"))
    upto = F.sum("sum").over(W.partitionBy("sid").orderBy("band")) + hashed(F.col("sid"), seed)
    sums = scratch.table(sums.withColumn("upto", upto).select("sid", "band", (F.floor(F.col("upto")) - F.floor(F.col("upto") - F.col("sum"))).cast("long").alias("take")), "takes")
    d = own.join(s.drop("missing", "sid"), named).drop("named").join(bands.drop("n"), F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("sized")), "left").drop("of", "sized")
    d = d.join(sums, ["sid", "band"], "left").withColumn("u", hashed(F.struct("doc_id", "row"), seed))
    d = d.withColumn("key", F.when(F.col("band").isNotNull(), F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.col("p")))
    d = d.withColumn("step", F.floor(F.col("key") / (1 + F.col("key")) * STEPS).cast("int"))
    steps = d.where("step IS NOT NULL").groupBy("sid", "band", "step", "take").agg(F.count("*").alias("here"))
    steps = steps.withColumn("before", F.sum("here").over(W.partitionBy("sid", "band").orderBy("step")) - F.col("here"))
    steps = scratch.table(steps.where(F.col("before") < F.col("take")).select("sid", "band", "step", "before", "here"), "steps")
    d = d.join(steps, ["sid", "band", "step"], "left")
    inside = F.col("before") + F.col("here") <= F.col("take")
    edge = d.where(F.col("before").isNotNull() & ~inside)
    place = F.row_number().over(W.partitionBy("sid", "band", "step").orderBy("key", "doc_id", "row")) + F.col("before")
    edge = edge.withColumn("picked", (place <= F.col("take")).cast("long"))
    rest = d.where(F.col("before").isNull() | inside).withColumn("picked", (F.col("before").isNotNull() | ((F.col("p") == 1) & F.col("band").isNull())).cast("long"))
    out = rest.unionByName(edge).withColumn("copies", F.col("whole") + F.coalesce("picked", F.lit(0)))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), F.coalesce("p", F.lit(0.0)).alias("part"), "row")


def repeat(docs: DataFrame, seed: int = 17, most: float = 3.0) -> DataFrame:
    """docs, all columns, each row as often as ``mix`` takes it. Empty and null texts stay as they are, once.

    Rows that are alike in every column are one row that is taken as often as ``mix`` takes them together, so that
    none is taken more often than it was picked. Columns may have any names. An empty table gives no rows. Many
    copies are written by several tasks, TOGETHER a task's share.
    """
    taken = mix(docs, seed, most).groupBy("doc_id", "row").agg(F.sum(F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))).alias("copies")).where("copies > 0")
    shares = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(TOGETHER).cast("long"))).alias("from")
    taken = scratch.table(taken.select("doc_id", "row", "copies", shares).select(F.col("doc_id").alias("id"), "row", F.least(F.col("copies") - F.col("from"), F.lit(TOGETHER)).cast("int").alias("n")), "taken")
    every = [docs[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    own = docs.select(F.xxhash64(*every).alias("row"), docs["doc_id"].cast("long").alias("id"), F.struct(*(docs[c] for c in docs.columns)).alias("all"))
    own = own.groupBy("row", "id").agg(F.first("all").alias("all"))
    out = own.join(taken, (own["row"] == taken["row"]) & own["id"].eqNullSafe(taken["id"])).select("all", F.explode(F.sequence(F.lit(1), "n")).alias("k"))
    return out.select(*(F.col("all").getField(c).alias(c) for c in docs.columns))
