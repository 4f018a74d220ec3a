"""A training corpus from raw documents: five stages, each stored before the next one reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from predio.llm import bpe, classifier, decontamination, jaccard, lines
from predio.scale import settle

VOCABULARY = "word_bpe_49k.json"
KEPT_SCORE = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from those not held out, scores at 0.7 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = classifier.train(docs.filter(~classifier.held_out()), labels)
    return classifier.score(docs, model, name="_score").filter(F.col("_score") >= KEPT_SCORE).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines stay in the first document that has them; documents left with no line go."""
    cut = lines.dedup_lines(docs, drop_empty=True)
    cut = cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return cut.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones."""
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every text, and a digest of what they decode to."""
    coded = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY), decoded="decoded")
    return coded.select(
        "doc_id",
        "text",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("bpe_encoding", encode),
]

#: The classifier is learnt by gradient descent, which SQL cannot express; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
