"""The corpus pipeline: five stages, each one operator applied to all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import line_dedup, mixing, ngram_join, packing, quality
from quillspark.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Losers of the near-duplicate stage up to which they are broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 500_000


def judged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It is fitted to the labels of documents that are in docs."""
    return quality.judge(docs, table(spark, sf_dir, "labels")).filter("keep").select(COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that an earlier document holds; a document goes only if it loses lines and has no word left."""
    out = line_dedup.dedup_lines(docs).filter((F.col("n_dropped") == 0) | F.regexp("kept", F.lit(r"\S")))
    return out.withColumn("text", F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("kept"))).withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest doc_id stays. Rows with a null doc_id stay."""
    found = ngram_join.similar(docs, count_links=False).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = written(found, "pipeline-gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the sources' target weights, in global random order; a document is there as often as it was drawn."""
    return mixing.mix(docs).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", judged),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_duplicates),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

#: SQL can't express the classifier, the tokenizer or the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
