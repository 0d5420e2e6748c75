"""A training corpus from the documents table: five stages, each written and read again by the next.

A stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of documents.

Defined results: a null or empty text is drawn by the classifier like any other of weight 0, holds no lines
that repeat, is near no other and leaks nothing, and has no tokens; a document that loses all its lines goes;
rows that repeat a doc_id and a text are one document and share its fate, and texts that share a doc_id are
judged one by one; rows with a null doc_id are classified, decontaminated and encoded, but neither judged nor
used as source where lines and near duplicates are compared; extra columns are left behind; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorescope.llm import bpe, common, decontamination, importance, jaccard_join, line_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    common.small_batches(spark)
    return importance.select_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go, of single lines too if they are long enough, and documents of which nothing else is left; the others keep their place."""
    common.small_batches(spark)
    out = line_dedup.line_dedup(docs.select(*COLUMNS), keep=("lang", "source"))
    left = out.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return left.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    common.small_batches(spark)
    groups = jaccard_join.jaccard_groups(docs, groups=True).filter("group_key IS NOT NULL").select("doc_id", "row_key", "group_key")
    groups = common.stored(groups)
    one = F.struct("doc_id", "row_key")
    several = groups.groupBy("group_key").agg(F.min(one).alias("first"), F.max(one).alias("last")).filter("first < last").select("group_key", "first")
    others = groups.join(several, "group_key").filter(one != F.col("first")).select("doc_id", "row_key").distinct()
    keyed = docs.select(*COLUMNS).withColumn("row_key", F.xxhash64("text"))
    return keyed.join(common.if_small(common.stored(others)), ["doc_id", "row_key"], "left_anti").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    common.small_batches(spark)
    return decontamination.clean_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and proof that they decode to it."""
    common.small_batches(spark)
    import public_tokenizers

    return bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

#: Hashed models, embeddings and merges aren't SQL; tests/llm compares the operators, and what the stages keep, with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stored(docs)
    return docs
