"""The queries of the text operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import (
    alignment,
    chat,
    licenses,
    line_rules,
    line_windows,
    manifest,
    merkle,
    mixing,
    packing,
    resampling,
    simhash,
    token_files,
    vector_links,
)
from basketry.sources.storage import new_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op2_length_buckets(spark, folder):
    return packing.pack(table(spark, folder, "documents"))


@query
def op5_line_windows(spark, folder):
    """The new text of every document, its lines with a word, and how many of them went."""
    rows = line_windows.rewritten(table(spark, folder, "documents"))
    return rows.select(
        F.col("_id").alias("doc_id"),
        F.col("_new").alias("text"),
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
    )


@query
def op6_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op8_line_rules(spark, folder):
    return line_rules.judged(table(spark, folder, "documents")).select(
        "doc_id",
        *line_rules.FIGURES,
        "base_failed",
        "kept",
        F.col("n_frequent_words").cast("bigint").alias("n_frequent_words"),
    )


@query
def op9_mix(spark, folder):
    rows = mixing.mixed(table(spark, folder, "documents"))
    return rows.select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_taken").alias("taken"),
    )


@query
def op1_importance_resampling(spark, folder):
    documents, labels = (table(spark, folder, name) for name in ("documents", "labels"))
    return resampling.resampled(documents, labels)


@query
def op3_chat_format(spark, folder):
    """All conversations and one whose texts hold control strings."""
    tricky = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame(
        [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)],
        "conv_id long, turn long, role string, text string",
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.formatted(turns.unionByName(added)))


@query
def op4_license_scan(spark, folder):
    return licenses.scanned(table(spark, folder, "documents"))


@query
def op7_merkle(spark, folder):
    rows = merkle.with_edits(table(spark, folder, "documents"))
    return rows.select(
        F.col("_id").alias("doc_id"),
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("own_fingerprint").alias("fingerprint"),
        "edited_fingerprint",
        "near_edited",
        "near_next",
        F.size("own_leaves").cast("bigint").alias("n_paragraphs"),
        F.size("own_sections").cast("bigint").alias("n_sections"),
        merkle.first_difference("own", "edited").alias("first_changed"),
    )


@query
def op10_token_files(spark, folder):
    """Written to a folder of its own in the shared one, and read back from there."""
    params = token_files.TokenFileParams(public_tokenizers.path("word_bpe_49k.json"))
    target = new_folder(spark, "tokens")
    token_files.write_tokens(table(spark, folder, "documents"), target, params)
    return token_files.read_documents(spark, target)


@query
def op12_merkle_manifest(spark, folder):
    """Proofs of the table as it is, held against the table with some texts lower-cased."""
    documents = table(spark, folder, "documents")
    return manifest.verified(documents, text=manifest.lower_one_in_five())


@query
def op11_product_quantisation(spark, folder):
    return vector_links.linked(table(spark, folder, "embeddings"))


@query
def op13_token_alignment(spark, folder):
    params = alignment.AlignParams(
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        public_tokenizers.path("piece_bpe_32k.model"),
    )
    return alignment.alignments(table(spark, folder, "documents"), params)
