"""Fixed queries over the tables files, chunks, edges and vectors.

files (file_id, file_uri, mime_type, content_hash, size_bytes, indexed_at, modified_at); chunks
(chunk_id, file_id, tier, chunk_index, content, token_count, meta, lance_id, structural_score,
coherence_score, is_flagged, chunker_method); edges (src_chunk, dst_uri, edge_type, meta).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chunk_listing(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks with their file's URI and type."""
    return chunks.join(files.select("file_id", "file_uri", "mime_type"), "file_id")


def file_info(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every file with has_pending: whether a chunk of it is not embedded."""
    pending = chunks.where("lance_id IS NULL").select("file_id").distinct().withColumn("has_pending", F.lit(True))
    return files.join(pending, "file_id", "left").withColumn("has_pending", F.coalesce("has_pending", F.lit(False)))


def file_detail(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every file with its chunks by tier and the tokens of its tier 1 chunks."""
    tier = lambda k: F.coalesce(F.sum((F.col("tier") == k).cast("long")), F.lit(0))
    counts = chunks.groupBy("file_id").agg(*(tier(k).alias(f"t{k}") for k in (1, 2, 3)), F.sum(F.when(F.col("tier") == 1, F.coalesce("token_count", F.lit(0)))).alias("t1_tokens"))
    return files.join(counts, "file_id", "left").na.fill(0, ["t1", "t2", "t3", "t1_tokens"])


def first_summaries(chunks: DataFrame) -> DataFrame:
    """(file_id, summary): the tier 3 chunk of least index."""
    return chunks.where("tier = 3").groupBy("file_id").agg(F.min(F.struct("chunk_index", "chunk_id", "content")).getField("content").alias("summary"))


def chunks_of_file(chunks: DataFrame, files: DataFrame, uri: str) -> DataFrame:
    return chunk_listing(chunks, files.where(F.col("file_uri") == uri)).orderBy("tier", "chunk_index")


def outgoing_edges(edges: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(file_uri, dst_uri, edge_type), each once."""
    sources = chunks.select(F.col("chunk_id").alias("src_chunk"), "file_id")
    return edges.join(sources, "src_chunk").join(files.select("file_id", "file_uri"), "file_id").select("file_uri", "dst_uri", "edge_type").distinct()


def incoming_edges(edges: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(dst_uri, src_uri, edge_type) for links to a known file, each once."""
    out = outgoing_edges(edges, chunks, files).withColumnRenamed("file_uri", "src_uri")
    return out.join(files.select(F.col("file_uri").alias("dst_uri")), "dst_uri", "left_semi").select("dst_uri", "src_uri", "edge_type")


def index_stats(files: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts. ``fts_docs`` counts all chunks, as an external-content index does; ``fts_docs_indexed`` those of tiers 1 and 2."""
    c = chunks.agg(F.count("*").alias("chunks"), F.count("lance_id").alias("embedded"), F.count("*").alias("fts_docs"), F.count_if(F.col("tier") < 3).alias("fts_docs_indexed"))
    return files.agg(F.count("*").alias("files")).join(c).join(edges.agg(F.count("*").alias("edges")))  # single rows


def embedded_percent(chunks: DataFrame) -> DataFrame:
    n, e = F.count("*"), F.count("lance_id")
    return chunks.agg(n.alias("chunks"), e.alias("embedded")).withColumn("percent", F.expr("CASE WHEN chunks = 0 THEN 100 ELSE embedded * 100 div chunks END"))


def mime_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy("mime_type").agg(F.count("*").alias("n"))


def explain_file(files: DataFrame, chunks: DataFrame, edges: DataFrame, uri: str) -> dict[str, DataFrame] | None:
    """Detail, summary, chunks, outgoing and incoming edges of a file; None if it is not indexed."""
    one = files.where(F.col("file_uri") == uri)
    if one.limit(1).isEmpty():
        return None
    own = chunks.join(one.select("file_id"), "file_id", "left_semi")
    into = edges.where(F.col("dst_uri") == uri).join(chunks.select(F.col("chunk_id").alias("src_chunk"), "file_id"), "src_chunk").join(files.select("file_id", "file_uri"), "file_id")
    return {
        "detail": file_detail(one, own),
        "summary": first_summaries(own),
        "chunks": own.orderBy("tier", "chunk_index"),
        "outgoing": outgoing_edges(edges, own, one).orderBy("edge_type", "dst_uri"),
        "incoming": into.select(F.col("file_uri").alias("src_uri"), "edge_type").distinct().orderBy("src_uri", "edge_type"),
    }


def declaration_blocks(lines: DataFrame) -> DataFrame:
    """``lines`` (file_uri, line, is_decl) -> (file_uri, start, stop): each declaration up to the next."""
    order = Window.partitionBy("file_uri").orderBy("line")
    last = F.max("line").over(Window.partitionBy("file_uri"))
    decls = lines.withColumn("last", last).where("is_decl")
    return decls.select("file_uri", F.col("line").alias("start"), F.coalesce(F.lead("line").over(order), F.col("last") + 1).alias("stop"))
