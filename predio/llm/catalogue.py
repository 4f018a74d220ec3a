"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from predio.llm import bpe, chat, classifier, decontamination, jaccard, licenses, lines, rules, secrets, sharding, tokenfiles
from predio.llm import oracles, trie, whiten
from predio.scale import new_path

VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License notices found in the documents."""
    found = licenses.find_licenses(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "template", "license", "share", "at")


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the number of tokens and digests of the ids and of the decoded text."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path(VOCABULARY), decoded="decoded")
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that overlap with benchmark items, with the agreement of the best stretch."""
    found = decontamination.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "words", "equal", "hits")


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the secrets found by patterns and by character models."""
    found = secrets.secret_summary(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans",
        "n_random",
    )


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Write all documents' ids to files, find every document by the index and read it back."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    path = new_path(spark, "token_files")
    tokenfiles.write(docs, path, public_tokenizers.path(VOCABULARY))
    found = tokenfiles.read(tokenfiles.locate(docs.select("doc_id"), path), path)
    return found.select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rule counts of every document, its base verdict, and the verdict of its host."""
    judged = rules.host_rules(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return judged.select("doc_id", *rules.COUNTS, "base_failed", "kept")


def op7_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the size of its shingle set and the component of similar documents it is in."""
    found = jaccard.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents by a model learnt from those that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = classifier.train(docs.filter(~classifier.held_out()), table(spark, folder, "labels"))
    scored = classifier.score(docs, model)
    return scored.select(
        "doc_id",
        classifier.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the lines that earlier documents have."""
    return lines.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's shard among 24 and its slot in it."""
    docs = table(spark, folder, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return sharding.stratified_shards(rows, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations, with its members, children and savings."""
    return trie.prefix_trie(*trie.rebuilt_turns(table(spark, folder, "conversations")))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every usable embedding on the leading components, whitened."""
    rows, fitted = whiten.whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    # One entry per component.
    explained = F.array(*[F.lit(float(e / fitted.trace)) for e in fitted.values]).cast("array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        "whitened",
        explained[F.col("at")].alias("explained"),
        F.lit(fitted.identity_error).alias("identity_error"),
    )


def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation formatted and read back; one more holds the template's own control strings."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], rows.schema)
    return chat.read_digest(chat.format_chat(rows.unionByName(extra)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_license_scan, op2_bpe, op3_decontamination, op4_secret_scan, op5_token_files, op6_quality_rules,
            op7_ngram_jaccard, op8_quality_classifier, op9_line_dedup, op10_sharding, op11_prefix_trie, op12_whitening,
            op13_chat_format,
        )
    }


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
