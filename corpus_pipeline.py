"""Corpus pipeline: five stages over ``documents``, each written as Parquet and
read again as the next one's documents. Every stage calls one operator of
``eventlens.llm`` on all that the stage before it kept. All stages but the last
return the columns of ``documents``; the last one adds the piece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.decontam import without_leaks
from eventlens.llm.line_dedup import dedup_lines
from eventlens.llm.pieces import encode_pieces
from eventlens.llm.quality_rules import judge
from eventlens.llm.simhash import one_of_each
from eventlens.session import apply_conf, scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; rejected ones go."""
    apply_conf(spark)
    return judge(docs, out="__quality").where("__quality_kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the blocks that an earlier document holds; ``n_chars`` follows the text."""
    apply_conf(spark)
    clean = dedup_lines(docs, out="__dedup")
    n_chars = F.when(F.col("__dedup.n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars).select(docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    apply_conf(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item; the others go."""
    apply_conf(spark)
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids, and whether these decode to the text."""
    apply_conf(spark)
    both = encode_pieces(docs, out="pieces", decoded="__decoded")
    return both.withColumn("lossless", F.col("__decoded") == F.coalesce("text", F.lit(""))).drop("__decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", sentence_pieces),
]

#: SQL expresses neither patience diff, nor alignment scores, nor merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_conf(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
