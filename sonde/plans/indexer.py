"""Indexing: what changed becomes chunks, postings, links and vectors, in one new snapshot."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import knn
from ..operators import maintenance as m
from ..operators import quality
from ..operators.bm25 import TextIndex, build_index, update_index
from ..operators.chunking.dispatch import parse_documents, with_ids
from ..operators.embed import Embedder
from ..sources.records import as_documents
from ..sources.walk import list_files, with_contents
from ..staging import staged
from .progress import Progress
from .store import CENTRES, Store


@dataclass(frozen=True)
class Counts:
    indexed: int = 0
    skipped: int = 0
    removed: int = 0
    errors: int = 0
    vectors: int = 0


class Indexer:
    def __init__(self, store: Store, embedder: Embedder | None = None, analyzer: str = "porter", methods: dict[str, str] | None = None, tokenizer: str | None = None, progress: Progress | None = None):
        self.progress = progress or Progress()
        self.store, self.embedder, self.analyzer, self.methods, self.tokenizer = store, embedder, analyzer, methods, tokenizer

    # --- entry points

    def index_root(self, root: str, reindex: bool = False, exclude: tuple[str, ...] = ()) -> Counts:
        """Bring the store up to date with a directory tree: new and changed files in, files that are gone out."""
        listed = with_contents(list_files(self.store.spark, root, exclude)).withColumn("content_hash", F.md5("content"))
        stored = self._file_info()
        if reindex:
            stored = stored.where(~((F.col("file_uri") == root) | F.col("file_uri").startswith(root.rstrip("/") + "/")))
        actions = m.change_detection(listed, stored, embeds=self.embedder is not None).persist()
        try:
            todo = actions.where("action = 'PROCESS'").drop("action")
            gone = m.stale_uris(self.store.table("files"), listed, root)
            counts = {r["action"]: r["n"] for r in m.action_counts(actions).collect()}
            skipped = sum(n for a, n in counts.items() if a != "PROCESS")
            settled = actions.where("action = 'SKIP_HASH'").select("file_uri", "modified_at")
            return self._apply(todo.withColumn("record_meta", F.lit(None).cast("string")), gone, skipped, settled)
        finally:
            actions.unpersist()

    def index_uris(self, uris: list[str]) -> Counts:
        """Index these files whether they changed or not; those that can't be read count as errors."""
        rows, errors = [], 0
        for uri in uris:
            try:
                size = os.path.getsize(uri)
                if size > fixed.MAX_FILE_SIZE:
                    raise OSError("too large")
                rows.append((uri, size))
            except OSError:
                errors += 1
        files = self.store.spark.createDataFrame(rows, "file_uri string, size_bytes long").withColumn("name", text.last_segment(F.col("file_uri")))
        files = files.withColumn("mime_type", text.mime_for(F.col("name"))).withColumn("modified_at", F.lit(time.time()))
        docs = with_contents(files).withColumn("content_hash", F.md5("content")).withColumn("record_meta", F.lit(None).cast("string"))
        done = self._apply(docs, None, 0, None)
        return Counts(done.indexed, done.skipped, done.removed, done.errors + errors, done.vectors)

    def index_records(self, records: DataFrame, order: str | None = None) -> Counts:
        """Index pushed records (uri, content, mime_type, modified_at, meta); of one uri the last by ``order`` counts."""
        records = m.keep_last(records, "uri", order) if order else records.dropDuplicates(["uri"])
        docs = as_documents(records.drop(order) if order else records).withColumn("content_hash", F.md5("content"))
        return self._apply(docs, None, 0, None)

    def score(self, rescore: bool = False) -> DataFrame:
        """Score the unscored chunks (or all) and store the result; the new chunks table."""
        chunks, vectors = self.store.table("chunks"), self.store.table("vectors")
        embedded = vectors.select("chunk_id", "vector").join(chunks.select("chunk_id", "file_id", "tier"), "chunk_id")
        self.store.commit({"chunks": quality.score_all(chunks, embedded, rescore)})
        return self.store.table("chunks")

    def recheck(self, dry_run: bool = False) -> tuple[DataFrame, Counts]:
        """Index anew the files with flagged chunks whose method is out of date: the drift by method, and what was done."""
        files, chunks = self.store.table("files"), self.store.table("chunks")
        drifted = quality.drifted_files(quality.flagged_files(chunks, files), self.methods)
        tally = quality.drift_tally(drifted)
        if dry_run:
            return tally, Counts()
        tally = self.store.spark.createDataFrame(tally.collect(), tally.schema)  # a row per pair of methods
        docs = self.store.table("documents").join(drifted.select("file_uri"), "file_uri", "left_semi")
        counts = self._apply(docs.withColumn("content_hash", F.md5("content")), None, 0, None)
        self.score()
        return tally, counts

    def build_cells(self, cells: int | None = None, limit: int = 20) -> int:
        """Partition the stored vectors for probed search, with as many probes as a measured recall of 0.95 takes; the probes.

        The partition holds until vectors change; searches then scan them all until it is built again.
        """
        vectors, of = self.store.table("vectors"), self.store.vectors_snapshot
        dealt, centres = knn.build_cells(vectors.select("id", "vector"), cells)
        dealt = staged(dealt, "cells")
        probes = knn.enough_probes(dealt, centres, limit)
        rows = [(i, [float(x) for x in c], probes) for i, c in enumerate(centres)]  # at most 1024
        self.store.commit({"cells": dealt.select("id", "cell"), "centres": self.store.spark.createDataFrame(rows, CENTRES)}, cells_of=of)
        return probes

    # --- shared

    def _file_info(self) -> DataFrame:
        files, chunks = self.store.table("files"), self.store.table("chunks")
        pending = chunks.where("lance_id IS NULL").select("file_id").distinct().withColumn("has_pending", F.lit(True))
        return files.join(pending, "file_id", "left").withColumn("has_pending", F.coalesce("has_pending", F.lit(False)))

    def _apply(self, docs: DataFrame, gone: DataFrame | None, skipped: int, settled: DataFrame | None) -> Counts:
        """Replace the documents ``docs``, remove those at ``gone``, update the times of ``settled``; one commit."""
        docs = docs.persist()
        parsed = parse_documents(docs, self.tokenizer).persist()
        try:
            now = time.time()
            good = parsed.where("error IS NULL").select("file_uri")
            fresh = docs.join(good, "file_uri", "left_semi")
            file_id = F.conv(F.substring(F.sha2("file_uri", 256), 1, 15), 16, 10).cast("long")
            new_files = fresh.select(file_id.alias("file_id"), "file_uri", "mime_type", "content_hash", "size_bytes", F.lit(now).alias("indexed_at"), "modified_at")

            chunks = parsed.select("file_uri", F.explode("chunks").alias("c")).select("file_uri", "c.*")
            label = text.method_for(text.normal_mime(F.col("mime_type")), self.methods)
            about = fresh.select("file_uri", file_id.alias("file_id"), label.alias("chunker_method"), "record_meta")
            chunks = with_ids(chunks.join(about, "file_uri")).withColumn("meta", text.with_record(F.col("meta"), F.col("record_meta"))).drop("record_meta")
            chunks = chunks.withColumns({"lance_id": F.lit(None).cast("long"), "structural_score": F.lit(None).cast("double"), "coherence_score": F.lit(None).cast("double"), "is_flagged": F.lit(False)})

            edges = parsed.select("file_uri", F.explode("edges").alias("e")).select("file_uri", "e.*")
            first = F.when(F.lit(True), text.stable_id(F.col("file_uri"), F.lit(1), F.col("src_chunk_index")))
            edges = edges.select(first.alias("src_chunk"), "dst_uri", text.resolve_uri(F.col("dst_uri")).alias("dst_uri_norm"), "edge_type", "meta")

            old_files, old_chunks, old_edges, old_vectors = (self.store.table(t) for t in ("files", "chunks", "edges", "vectors"))
            out = good if gone is None else good.unionByName(gone)
            keep_files, keep_chunks, keep_edges, keep_vectors = m.delete_files(old_files, old_chunks, old_edges, old_vectors, out.distinct())
            if settled is not None:
                times = settled.select("file_uri", F.col("modified_at").alias("__m"))
                keep_files = keep_files.join(times, "file_uri", "left").withColumn("modified_at", F.coalesce("__m", "modified_at")).drop("__m")

            vectors = old_vectors.limit(0)
            if self.embedder is not None:
                self.store.check_dimension(self.embedder.dim)
                made = self.embedder.embed(chunks.select("chunk_id", "tier", "content"), prefix="search_document: ")
                vectors = made.select(F.col("chunk_id").alias("id"), "chunk_id", "tier", "vector")
            all_vectors = m.append_vectors(keep_vectors, vectors)
            shape = old_chunks.columns
            all_chunks = keep_chunks.select(*shape).unionByName(chunks.select(*shape))
            if self.embedder is not None:
                all_chunks = m.mark_embedded(all_chunks, all_vectors)

            old_index = TextIndex(self.store.table("postings"), self.store.table("lengths"), self.analyzer)
            removed = old_chunks.join(keep_chunks.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id")
            searched = chunks.where("tier IN (1, 2)").select("chunk_id", "tier", "content")
            first_time = self.store.version is None
            index = build_index(searched, self.analyzer) if first_time else update_index(old_index, searched, removed)
            documents = m.without(self.store.table("documents"), out, "file_uri").unionByName(fresh.select(*self.store.table("documents").columns))
            counts = Counts(
                indexed=good.count(),
                skipped=skipped,
                removed=0 if gone is None else gone.count(),
                errors=parsed.where("error IS NOT NULL").count(),
            )
            self.progress("documents parsed", counts.indexed)
            self.store.commit(
                {"files": keep_files.unionByName(new_files.select(*keep_files.columns)), "chunks": all_chunks, "edges": keep_edges.unionByName(edges), "vectors": all_vectors, "postings": index.postings, "lengths": index.lengths, "documents": documents},
                **({"dim": self.embedder.dim} if self.embedder is not None else {}),
            )
            self.progress("snapshot written", counts.indexed)
            return Counts(counts.indexed, counts.skipped, counts.removed, counts.errors, self.store.table("vectors").count())
        finally:
            parsed.unpersist()
            docs.unpersist()
