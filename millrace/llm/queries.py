"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path
from . import (
    chat, fill_middle, fingerprints, line_dedup, mixing, packing, repair, secret_scan, simhash, token_files, toxicity, vector_search,
)
from .common import table
from .oracles import CHAT, LINES, MIXING, SEARCH
from .registry import ORACLE, QUERIES, query
from .token_counts import count_tokens

__all__ = ["ORACLE", "QUERIES"]

VOCABULARY = "byte_bpe_50k.json"
WORDS = "word_bpe_49k.json"


@query("op1_token_counts")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


@query("op2_packing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


@query("op3_fingerprints")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_versions(table(spark, folder, "documents"))


@query("op4_simhash")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op5_secret_scan")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))
    return found.where("secret").select("doc_id", "start", "length", "probability")


@query("op6_line_dedup", LINES)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    texts = pages.select(
        "page_id", line_dedup.host(F.col("url")).alias("host"), line_dedup.page_text(F.col("html")).alias("text")
    )
    return line_dedup.drop_boilerplate(texts, "host", "text")


@query("op7_chat_format", CHAT)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return chat.chat_texts(table(spark, folder, "conversations"))


@query("op8_mixing", MIXING)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op9_vector_search", SEARCH)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return vector_search.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, folder, "labels")))


@query("op11_structure_repair")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    hurt = repair.damaged(turns, "conv_id", "turn", "role", "text")
    return repair.repair(hurt, ids=turns.select("conv_id"))


@query("op12_fill_in_middle")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    made = fill_middle.fill_in_middle(docs)
    again = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"),
    )


@query("op13_token_files")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), path, public_tokenizers.path(WORDS))
    return token_files.token_digests(spark, path)
