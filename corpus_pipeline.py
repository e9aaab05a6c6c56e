"""documents without toxic texts, near copies and secrets, mixed to source weights and turned into piece ids.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril.functions import scratch
from tendril.llm import mixing, pieces, secrets, simhash, toxicity

#: SQL has no learned models: the stages are tested against plain versions instead.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score the threshold or more go; the lexicon is learned from labels."""
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of the smallest doc_id stays, once; rows without an id stay.

    Groups join texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more (checked exactly; see
    ``simhash.near_copies`` for the candidates). One doc_id with two texts is two documents.
    """
    kept = simhash.near_copies(docs).groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.node").alias("_kept"))
    own = docs.where("doc_id IS NOT NULL").withColumn("_node", simhash.node_of(F.col("text")))
    first = own.join(kept, (own["doc_id"].cast("long") == F.col("_id")) & (own["_node"] == F.col("_kept")), "left_semi")
    return first.dropDuplicates(["doc_id", "_node"]).drop("_node").unionByName(docs.where("doc_id IS NULL"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target weight asks for."""
    return mixing.repeat(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, pieces.load())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written once, so that no later one works it out again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
