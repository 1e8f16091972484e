"""Chunking whole tables of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import fixed, text
from .parsers import PARSERS, Document
from .tokens import Counter

CHUNK_STRUCT = "struct<tier:int,chunk_index:bigint,content:string,token_count:bigint,meta:string>"
CHUNK_FIELDS = "tier int, chunk_index long, content string, token_count long, meta string"
CHUNK_TYPES = {"tier": pa.int32(), "chunk_index": pa.int64(), "content": pa.string(), "token_count": pa.int64(), "meta": pa.string()}
#: Bytes of documents and chunks that a task sends at once.
BYTES_HELD, CHUNKS_HELD = 4_000_000, 10_000
EDGE_STRUCT = "struct<src_chunk_index:bigint,dst_uri:string,edge_type:string,meta:string>"


def parse_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``docs`` (file_uri, name, mime_type, content BINARY or STRING) -> file_uri, chunks, edges, error.

    A document that can't be parsed has no chunks and the reason in ``error``.
    """
    parser = text.parser_for(text.normal_mime(F.col("mime_type")))
    rows = docs.select("file_uri", "name", "mime_type", F.col("content").cast("binary").alias("content"), parser.alias("parser"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(tokenizer)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    got = PARSERS[r.parser](Document(r.file_uri, r.name, r.mime_type, r.content or b"", counter))
                    out.append((r.file_uri, [dict(zip(("tier", "chunk_index", "content", "token_count", "meta"), c, strict=True)) for c in got.chunks], [dict(zip(("src_chunk_index", "dst_uri", "edge_type", "meta"), e, strict=True)) for e in got.edges], None))
                except Exception as e:  # noqa: BLE001 - one bad document must not stop the rest
                    out.append((r.file_uri, [], [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["file_uri", "chunks", "edges", "error"])

    return rows.mapInPandas(run, f"file_uri string, chunks array<{CHUNK_STRUCT}>, edges array<{EDGE_STRUCT}>, error string")


def chunk_documents(docs: DataFrame, methods: dict[str, str] | None = None, tokenizer: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per chunk: file_uri, tier, chunk_index, content, token_count, meta, chunker_method, chunk_id, and the columns ``keep`` of its document.

    Chunks are made where their document's row is, without a join: documents that share a file_uri each give their own.
    """
    mime = text.normal_mime(F.col("mime_type"))
    rows = docs.select("file_uri", "name", "mime_type", F.col("content").cast("binary").alias("content"), text.parser_for(mime).alias("parser"), text.method_for(mime, methods).alias("chunker_method"), *(F.col(c).alias(f"__{c}") for c in keep))
    carried = ["file_uri", "chunker_method", *(f"__{c}" for c in keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer)
        for batch in batches:
            given = zip(*(batch.column(c).to_pylist() for c in ("file_uri", "name", "mime_type", "parser")), strict=True)
            at, made, size = [], [], 0
            for row, (uri, name, kind, parser) in enumerate(given):
                content = batch.column("content")[row].as_py() or b""
                try:
                    chunks = PARSERS[parser](Document(uri, name, kind, content, counter)).chunks
                except Exception:  # noqa: BLE001 - a document that can't be parsed has no chunks
                    continue
                at.extend([row] * len(chunks)), made.extend(chunks)
                size += len(content)
                if size > BYTES_HELD or len(made) > CHUNKS_HELD:
                    yield flat(batch, at, made)
                    at, made, size = [], [], 0
            yield flat(batch, at, made)

    def flat(batch: pa.RecordBatch, at: list[int], made: list[tuple]) -> pa.RecordBatch:
        own = zip(*made, strict=True) if made else [[]] * len(CHUNK_TYPES)
        arrays = [pa.array(x, t) for x, t in zip(own, CHUNK_TYPES.values(), strict=True)]
        rows = pa.array(at, pa.int32())
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in carried), *arrays], names=[*carried, *CHUNK_TYPES])

    shape = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried), CHUNK_FIELDS])
    chunks = rows.mapInArrow(run, shape)
    return with_ids(chunks.select("file_uri", *CHUNK_TYPES, "chunker_method", *(F.col(f"__{c}").alias(c) for c in keep)))


def chunk_edges(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per link: file_uri, src_chunk (the id of the file's first tier 1 chunk), dst_uri, dst_uri_norm, edge_type, meta."""
    edges = parse_documents(docs, tokenizer).select("file_uri", F.explode("edges").alias("e")).select("file_uri", "e.*")
    source = text.stable_id(F.col("file_uri"), F.lit(1), F.col("src_chunk_index"))
    return edges.select("file_uri", source.alias("src_chunk"), "dst_uri", text.resolve_uri(F.col("dst_uri")).alias("dst_uri_norm"), "edge_type", "meta")


def with_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", text.stable_id(F.col("file_uri"), F.col("tier"), F.col("chunk_index")))


def plain_chunks(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of plain texts (file_uri, name, mime_type, content STRING) without leaving the JVM; the same as ``chunk_documents`` makes of them, with the columns ``keep``."""
    c = F.col("content")
    paragraphs = F.filter(F.transform(F.split(c, "\n\n", -1), text.strip), lambda p: p != "")
    tier1 = F.flatten(F.transform(paragraphs, lambda p: text.budget_segments(p, fixed.TIER1_TOKENS)))
    tiers = {1: tier1, 2: text.budget_segments(c, fixed.TIER2_TOKENS), 3: F.array(text.summary(F.col("name"), F.col("mime_type"), c))}
    parts = F.array(*(F.struct(F.lit(k).alias("tier"), v.alias("texts")) for k, v in tiers.items()))
    rows = docs.select("file_uri", *keep, F.explode(parts).alias("p")).select("file_uri", *keep, "p.tier", F.posexplode("p.texts").alias("chunk_index", "content"))
    return with_ids(rows.withColumn("chunk_index", F.col("chunk_index").cast("long")).withColumn("token_count", text.count_tokens(F.col("content"))))
