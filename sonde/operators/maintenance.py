"""Set-based table maintenance: what changed, merges, deletions. All return new DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def change_detection(listed: DataFrame, stored: DataFrame, embeds: bool = True) -> DataFrame:
    """``listed`` (file_uri, modified_at, content_hash) against ``stored`` (file_uri, modified_at,
    content_hash, has_pending) -> listed plus action: SKIP_MTIME, SKIP_HASH or PROCESS.

    Without an embedder (``embeds`` False) chunks are never embedded, and that is no reason to process.
    """
    old = stored.select("file_uri", F.col("modified_at").alias("old_mtime"), F.col("content_hash").alias("old_hash"), "has_pending")
    settled = ~F.coalesce("has_pending", F.lit(False)) if embeds else F.lit(True)
    action = (
        F.when(F.col("old_hash").isNull(), "PROCESS")
        .when(settled & F.col("modified_at").eqNullSafe(F.col("old_mtime")), "SKIP_MTIME")
        .when(settled & (F.col("content_hash") == F.col("old_hash")), "SKIP_HASH")
        .otherwise("PROCESS")
    )
    return listed.join(old, "file_uri", "left").withColumn("action", action).drop("old_mtime", "old_hash", "has_pending")


def action_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def stale_uris(stored: DataFrame, live: DataFrame, root: str) -> DataFrame:
    """Stored URIs at or below ``root`` that are not live any more."""
    below = (F.col("file_uri") == root) | F.col("file_uri").startswith(root.rstrip("/") + "/")
    return stored.select("file_uri").where(below).join(live.select("file_uri"), "file_uri", "left_anti")


def keep_last(records: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that came last."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return records.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key; ``keep``: columns whose old value stays."""
    if keep:
        was = old.select(key, *(F.col(c).alias(f"__{c}") for c in keep))
        new = new.join(was, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in keep}).drop(*(f"__{c}" for c in keep))
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def delete_files(files: DataFrame, chunks: DataFrame, edges: DataFrame, vectors: DataFrame, uris: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables without the files ``uris`` (file_uri) and all that belongs to them."""
    ids = files.join(uris.select("file_uri"), "file_uri", "left_semi").select("file_id")
    gone = chunks.join(ids, "file_id", "left_semi").select("chunk_id")
    return (
        without(files, uris, "file_uri"),
        without(chunks, ids, "file_id"),
        without(edges, gone.withColumnRenamed("chunk_id", "src_chunk"), "src_chunk"),
        without(vectors, gone, "chunk_id"),
    )


def delete_all(*tables: DataFrame) -> tuple[DataFrame, ...]:
    """The tables without their rows."""
    return tuple(t.where(F.lit(False)) for t in tables)


def mark_embedded(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """``chunks`` with lance_id set where there is a vector (chunk_id, id), null elsewhere."""
    have = vectors.select("chunk_id", F.col("id").alias("__id")).dropDuplicates(["chunk_id"])
    return chunks.join(have, "chunk_id", "left").withColumn("lance_id", F.col("__id")).drop("__id").select(*chunks.columns)


def append_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """One vector an id, the new one if both have it."""
    return upsert(vectors, new.dropDuplicates(["id"]), "id")


def pick(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def reservoir(rows: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """A uniform sample of n rows."""
    return rows.withColumn("__r", F.rand(seed)).orderBy("__r").limit(n).drop("__r")
