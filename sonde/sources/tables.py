"""The test tables as the engine's tables: documents, pages, conversations, events and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stable_id


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def document_files(documents: DataFrame) -> DataFrame:
    """file_id, file_uri, name, mime_type, content_hash, size_bytes, modified_at, content (text)."""
    return documents.select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.lit("doc://"), F.col("doc_id")).alias("file_uri"),
        F.col("doc_id").cast("string").alias("name"),
        F.lit("text/plain").alias("mime_type"),
        F.md5(F.col("text").cast("binary")).alias("content_hash"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.col("doc_id").cast("double").alias("modified_at"),
        F.col("text").alias("content"),
    )


def page_files(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id").alias("file_id"),
        F.col("url").alias("file_uri"),
        F.lit("text/html").alias("mime_type"),
        F.octet_length("html").cast("long").alias("size_bytes"),
        F.col("html").alias("content"),
    )


def turn_records(conversations: DataFrame) -> DataFrame:
    meta = F.to_json(F.struct("conv_id", "turn", "role"))
    return conversations.select(
        F.concat_ws("/", F.lit("conv:/"), F.col("conv_id"), F.col("turn")).alias("uri"), F.col("text").alias("content"), F.lit("text/plain").alias("mime_type"), F.lit(None).cast("double").alias("modified_at"), meta.alias("meta")
    )


def event_records(events: DataFrame) -> DataFrame:
    """One record per event, keyed by user: a later event overwrites."""
    return events.select(
        F.concat(F.lit("user://"), F.col("user_id")).alias("uri"), F.concat_ws(" ", "event_type", F.col("value").cast("string")).alias("content"), F.lit("text/plain").alias("mime_type"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("modified_at"), F.col("props").alias("meta"), F.col("event_id").alias("arrival")
    )


def embedded_chunks(embeddings: DataFrame) -> DataFrame:
    """Vectors as chunks: file by label, tiers 1 to 3 in turn, id by ``stable_id``."""
    tier = (F.col("vec_id") % 3 + 1).cast("int")
    uri = F.concat(F.lit("label://"), F.col("label"))
    return embeddings.select(
        F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("id"), F.col("label").cast("long").alias("file_id"), uri.alias("file_uri"), tier.alias("tier"), F.col("embedding").alias("vector"), stable_id(uri, tier, F.col("vec_id")).alias("stable_id")
    )
