"""Streams of pushed records: newline-delimited JSON files into the store, batch by batch.

A batch is one snapshot; replaying it after a failure gives the same store, as records replace
each other by uri. Bad lines go to a side table. Of one uri in a batch the last arrival counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.indexer import Indexer
from ..sources.records import parse_lines, split_records


def line_stream(spark: SparkSession, folder: str, files_per_batch: int = 128) -> DataFrame:
    """Lines of the text files that appear in ``folder``, with their file's time and name as order of arrival."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max(1, files_per_batch)).load(folder)
    return lines.select("value", F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"))


def ingest_lines(batch: DataFrame, indexer: Indexer, bad_path: str | None = None, number: int = 0) -> None:
    """Index one batch of lines (value, at, file, place: the order of lines in a file). Bad lines go to a folder of
    the batch's number below ``bad_path``, so a batch that is replayed replaces its own."""
    arrival = F.struct("at", "file", "place")
    rows = batch.withColumn("arrival", arrival)
    parsed = parse_lines(rows.select("value"))
    _, bad = split_records(parsed)
    if bad_path:
        bad.write.mode("overwrite").parquet(f"{bad_path}/batch={number}")
    ordered = rows.groupBy(F.col("value").alias("line")).agg(F.max("arrival").alias("arrival"))
    good = parsed.where("NOT is_bad").dropDuplicates(["line"]).join(ordered, "line").drop("is_bad", "line")
    indexer.index_records(good, order="arrival")


def start_ingest(spark: SparkSession, folder: str, indexer: Indexer, checkpoint: str, bad_path: str | None = None, files_per_batch: int = 128, once: bool = True) -> StreamingQuery:
    """Follow ``folder``; with ``once`` stop when what is there has been taken in."""

    def batch(df: DataFrame, number: int) -> None:
        lines = df.withColumn("place", F.monotonically_increasing_id()).persist()
        try:
            ingest_lines(lines, indexer, bad_path, number)
        finally:
            lines.unpersist()

    writer = line_stream(spark, folder, files_per_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
