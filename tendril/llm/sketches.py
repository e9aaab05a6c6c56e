"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scratch
from .words import SPLIT

#: Hashes a sketch keeps; words of a shingle; bits of a hash.
SIZE, SHINGLE, BITS = 128, 5, 48


def sketch(text: Column, size: int = SIZE, shingle: int = SHINGLE) -> Column:
    """The ``size`` least distinct hashes of runs of ``shingle`` words (a shorter text is one run, an empty one none), ascending."""
    w = F.array_remove(F.split(text, SPLIT), "")
    cut = lambda h: h.bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))

    def of(x: Column) -> Column:
        n = F.size(x)
        runs = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: cut(F.xxhash64(*(F.get(x, i + k) for k in range(shingle)))))
        hashes = F.when(n >= shingle, runs).when(n > 0, F.array(cut(F.xxhash64(F.array_join(x, " "))))).otherwise(F.array().cast("array<long>"))
        return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)

    return F.transform(F.array(w), of)[0]


def merge(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated Jaccard similarity of the shingle sets; two empty ones are alike, an empty and a full one are not."""
    both = merge(a, b, size)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.try_divide(F.size(F.array_intersect(F.array_intersect(both, a), b)), F.size(both)))


def count(a: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact below ``size``."""
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) * float(1 << BITS) / (F.element_at(a, -1) + 1))


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    r = resemblance(a, b, size)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.try_divide(r * (count(a, size) + count(b, size)), (1 + r) * count(a, size))))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), BITS // 4, "0"))), "")


def from_text(fingerprint: Column) -> Column:
    w = BITS // 4
    n = F.length(fingerprint).cast("int") / w
    part = lambda i: F.conv(F.substring(fingerprint, i * w + 1, F.lit(w)), 16, 10).cast("long")
    return F.when(F.length(fingerprint) == 0, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), part))


def following(keys: DataFrame) -> DataFrame:
    """Of distinct (doc_id, h): adds next_id and next_h, the next in descending order; of the least, the greatest.

    Keys are cut into ranges where a sample of them says and ordered inside each; a range's last key is followed by
    the first of the range below, found in the table of ranges. Other columns stay.
    """
    at = scratch.ranged(keys, "doc_id", "h", name="keys")
    key = F.struct("doc_id", "h")
    heads = at.groupBy("g").agg(F.max(key).alias("head"))
    down = W.orderBy(F.desc("g"))  # a row a range
    heads = heads.select("g", F.coalesce(F.lead("head").over(down), F.first("head").over(down.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("below"))
    own = at.withColumn("lead", F.lead(key).over(W.partitionBy("g").orderBy(F.desc("doc_id"), F.desc("h"))))
    return own.join(heads, "g").withColumn("next", F.coalesce("lead", "below")).select(*keys.columns, F.col("next.doc_id").alias("next_id"), F.col("next.h").alias("next_h"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles, next_id), a row for each row with a doc_id.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document by descending doc_id; the last is followed by the first. Null texts are empty. A single document follows
    itself. Rows with a null doc_id take no part. Rows of one doc_id follow each other by descending hash of their
    texts; rows that repeat both are one document in this order, and each gets its row. An empty table gives no rows;
    other columns, whatever their names, take no part. Of the next document only the prefix that is needed travels,
    with its sketch.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text")).where("doc_id IS NOT NULL").withColumn("h", F.xxhash64("text"))
    keys = own.groupBy("doc_id", "h").agg(F.max(F.length("text")).alias("n"))
    after = scratch.table(following(keys).select("next_id", "next_h", F.col("doc_id").alias("to"), F.col("h").alias("to_h"), "n"), "next")
    text = lambda i, h: own.select(F.col("doc_id").alias(i), F.col("h").alias(h), "text")
    lent = text("next_id", "next_h").join(after, ["next_id", "next_h"])
    lent = lent.select("to", "to_h", "next_id", F.substring("text", F.lit(1), F.floor(F.col("n") / 2).cast("int")).alias("lent"), as_text(sketch(F.col("text"))).alias("next_fingerprint"))
    lent = lent.dropDuplicates(["to", "to_h"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    d = text("to", "to_h").join(lent, ["to", "to_h"]).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("lent", F.lit(1), half)))
    d = d.select("to", "next_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("text")).alias("a"), sketch(F.col("edited")).alias("b"), from_text(F.col("next_fingerprint")).alias("c"))
    return d.select(
        F.col("to").alias("doc_id"), "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"),
        resemblance(F.col("a"), F.col("b")).alias("near_edited"), resemblance(F.col("a"), F.col("c")).alias("near_next"), count(F.col("a")).alias("n_shingles"), "next_id",
    )
