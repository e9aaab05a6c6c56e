"""URL filters: host-suffix and path-prefix expressions, equi-joined on short hash prefixes and confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The query's rules (fixed values).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Hex digits of a digest by which expressions and rules meet.
SHORT = 8
#: The verdict on a URL that no rule fits.
OTHERWISE = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, action string")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL: both empty if it is null or has no ``://``."""
    rest = F.coalesce(F.get(F.split(url, "://", 2), 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _folder(path: Column) -> Column:
    """The path up to its last slash: the part of a rule's path that is an expression of every URL that the rule fits."""
    return F.regexp_extract(path, r"^(?s:.*)/", 0)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _known(rules: DataFrame) -> DataFrame:
    """A row per host and path: block wins over allow. A rule without a host or an action of another name fails the job."""
    bad = F.col("action").isNull() | ~F.col("action").isin("allow", "block") | (F.coalesce("host", F.lit("")) == "")
    action = F.when(bad, F.raise_error(F.lit("a rule needs a host and an action: allow or block"))).otherwise(F.col("action"))
    r = rules.select(F.translate("host", _UPPER, _LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), action.alias("r_action"))
    r = r.groupBy("r_host", "r_path").agg(F.max("r_action").alias("r_action"))
    return r.withColumn("short", F.substring(_digest(F.col("r_host"), _folder(F.col("r_path"))), 1, SHORT)).withColumn("full", _digest(F.col("r_host"), F.col("r_path")))


def expressions(host: Column, path: Column, labels: int, slashes: int) -> Column:
    """Structs (suffix, folder): the host's last 1 to ``labels`` labels with the path's first 0 to ``slashes`` folders.

    Those are all that can meet a rule if no rule has more labels or slashes.
    """
    label, folder = F.split(host, r"\.", -1), F.split(path, "/", -1)
    n, m = F.size(label), F.size(folder) - 1  # m: slashes
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.array_join(F.slice(label, n - k + 1, k), "."))
    folders = F.transform(F.sequence(F.lit(0), F.least(m, F.lit(slashes))), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(folder, 1, k), "/"), F.lit("/"))))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(folders, lambda f: F.struct(s.alias("suffix"), f.alias("folder")))))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = OTHERWISE) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages, repeated ones and null ids included.

    A rule (host, path, action) fits its host and all subdomains if the URL's path begins with the rule's, letter by
    letter; the longest one (host and path together) wins, of equally long ones the one of the longer host. ``rule`` is
    its host and path. Null URLs and URLs without ``://`` have an empty host and path, which no rule fits: ``otherwise``
    (allow) judges them. A URL without a path has an empty one, which ``/`` doesn't begin. Ports and user names belong
    to the host. Other columns don't matter; empty tables give no rows, and without rules ``otherwise`` judges all.

    Each different URL is expanded into host suffixes and path folders, no deeper than the deepest rule (two numbers,
    all that the driver is told), so that very long hosts and paths stay few rows. These meet the rules on the first
    SHORT hex digits of their digests; a meeting counts if the full digest of the rule is that of the suffix and of as
    much of the path. Nothing is broadcast by hand: Spark does that where the rules' table is small.
    """
    known = _known(rules)
    most = known.agg(F.max(F.size(F.split("r_host", r"\."))), F.max(F.size(F.split("r_path", "/")) - 1)).first()
    host, path = parts(pages["url"])
    own = pages.select(pages["page_id"].alias("page_id"), host.alias("host"), path.alias("path"))
    if most[0] is None:
        return own.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(otherwise))
    urls = own.where("host <> ''").select("host", "path").distinct()
    e = urls.withColumn("x", F.explode(expressions(F.col("host"), F.col("path"), *most)))
    e = e.select("host", "path", "x.suffix", F.substring(_digest(F.col("x.suffix"), F.col("x.folder")), 1, SHORT).alias("short"))
    begin = F.when(F.length("r_path") == 0, F.lit("")).otherwise(F.col("path").substr(F.lit(1), F.length("r_path")))
    hits = e.join(known, "short").where(_digest(F.col("suffix"), begin) == F.col("full"))
    long = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_action").alias("action")), long).alias("best"))
    return own.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(otherwise)).alias("verdict"))
