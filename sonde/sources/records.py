"""Pushed records: newline-delimited JSON and tables, as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import last_segment, normal_mime

RECORD = "uri string, content string, mime_type string, modified_at double, meta string, _bad string"


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of JSON with the fields of a record, the line, and is_bad: not JSON, or without uri, content or mime_type. Blank lines are left out."""
    rows = lines.where(F.trim(F.col(column)) != "")
    parsed = F.from_json(F.col(column), RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = rows.select(F.col(column).alias("line"), parsed.alias("r")).select("line", "r.*")
    bad = F.col("_bad").isNotNull() | F.col("uri").isNull() | F.col("content").isNull() | F.col("mime_type").isNull()
    return out.withColumn("is_bad", bad).drop("_bad")


def split_records(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good records, bad lines)."""
    return parsed.where("NOT is_bad").drop("is_bad", "line"), parsed.where("is_bad").select("line")


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def as_documents(records: DataFrame, now: Column | None = None) -> DataFrame:
    """Records (uri, content, mime_type, modified_at, meta) as documents: file_uri, name, mime_type, size_bytes, modified_at, content, record_meta."""
    clock = now if now is not None else F.unix_micros(F.current_timestamp()) / 1e6
    return records.select(
        F.col("uri").alias("file_uri"),
        F.coalesce(last_segment(F.col("uri")), F.col("uri")).alias("name"),
        normal_mime(F.col("mime_type")).alias("mime_type"),
        F.octet_length("content").cast("long").alias("size_bytes"),
        F.coalesce("modified_at", clock).alias("modified_at"),
        F.col("content").cast("binary").alias("content"),
        F.col("meta").alias("record_meta"),
    )
