"""One query for each operator, with production parameters, over its whole table. ORACLE_SQL holds DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import ann, bpe, chat, langid, lz, mixing, ngram_join, pii, token_counts, warc
from tidewater.llm.common import table, work_dir, written


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_frame(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range-sorted by the position at which a document is first taken; documents that are not taken have none, and are sorted by a hash."""
    docs = written(spark, table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("n_words")), "words")
    planned = mixing.plan(docs, F.col("n_words"))
    first = planned.select("__row.doc_id", "size", "source_size", "target", "taken", F.round(F.get("positions", F.lit(0)), 9).alias("position"))
    order = ["position", F.xxhash64("doc_id", "size")]
    return first.repartitionByRange(*order).sortWithinPartitions(*order)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a conversation -1 whose texts look like another template's control strings."""
    talks = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_frame(chat.format_frame(talks.unionByName(more)))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(rows, rows.where(F.col("vec_id") % 20 == 0))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begins with an empty cache, so that each run does the whole work."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), work_dir(spark, "token-counts"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz.compare_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_ngram_join": op3_ngram_join,
    "op4_chat": op4_chat,
    "op5_ann": op5_ann,
    "op6_token_counts": op6_token_counts,
    "op7_warc": op7_warc,
    "op8_pii": op8_pii,
    "op9_language_id": op9_language_id,
    "op10_fingerprints": op10_fingerprints,
}

ORACLE_SQL: dict[str, str] = {"op2_mixing": mixing.SQL, "op7_warc": warc.SQL}
