"""Search over the tables of a store: dense, sparse, hybrid, and documents like one document.

All take a batch of queries (query_id, query) and return one lazy DataFrame keyed by query_id.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EmbedderMissing, NotFound
from ..functions.fixed import LIKE_PREFIX
from ..operators import bm25, fusion, knn
from ..operators.bm25 import TextIndex
from ..operators.embed import Embedder
from ..operators.fusion import SearchOptions, Weights
from .store import Store

HIT_COLUMNS = ("chunk_id", "lance_id", "file_uri", "tier", "content")


class Searcher:
    def __init__(self, store: Store, embedder: Embedder | None = None, analyzer: str = "porter", weights: Weights | None = None):
        self.store, self.embedder, self.weights = store, embedder, weights or Weights.resolve()
        self.index = TextIndex(store.table("postings"), store.table("lengths"), analyzer)

    def _chunks(self) -> DataFrame:
        return self.store.table("chunks").select(*HIT_COLUMNS)

    def search(self, queries: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
        """Hits with query_id, final_rank, normalized_score. An unknown mode is hybrid; without an embedder sparse is what is left."""
        mode = options.mode if options.mode in ("dense", "sparse") else "hybrid"
        if mode != "sparse" and self.embedder is None:
            if mode == "dense":
                raise EmbedderMissing("dense search needs an embedder")
            mode = "sparse"
        if mode == "dense":
            hits = self.dense(queries, options.top_k, options)
            return fusion.finish(hits, "dense_rank", options, fused=False)
        if mode == "sparse":
            hits = self.sparse(queries, options.top_k, options)
            return fusion.finish(hits, "sparse_rank", options, fused=False)
        dense, sparse = self.dense(queries, options.pool, options), self.sparse(queries, options.pool, options)
        return fusion.finish(fusion.rrf_fuse(dense, sparse, queries, self.weights), "fused_rank", options, fused=True)

    def _pool(self, options: SearchOptions) -> DataFrame | None:
        """With filters before the cut, the chunks that pass them; None for filters after it."""
        return fusion.restrict(self._chunks(), options.tier, options.ext_filter) if options.filter_mode == "pre" else None

    def dense(self, queries: DataFrame, k: int, options: SearchOptions) -> DataFrame:
        asked = self.embedder.embed(queries.select("query_id", "query"), text="query", prefix="search_query: ", out="vector")
        return self.dense_by_vector(asked, k, options)

    def _cells(self) -> tuple[DataFrame, np.ndarray, int] | None:
        """The stored partition of the vectors, their centres and the probes; None if there is none of these vectors."""
        of = self.store.vectors_snapshot
        if of is None or self.store.meta.get("cells_of") != of:
            return None
        centres = self.store.table("centres").orderBy("cell").collect()  # at most 1024 rows
        return self.store.table("cells"), np.array([r["centre"] for r in centres]), centres[0]["probes"]

    def dense_by_vector(self, asked: DataFrame, k: int, options: SearchOptions) -> DataFrame:
        vectors, pool = self.store.table("vectors"), self._pool(options)
        if pool is not None:
            vectors = vectors.join(pool.select("chunk_id"), "chunk_id", "left_semi")
        cells = self._cells()
        if pool is None and cells is not None:
            near = knn.nearest_in_cells(vectors.join(cells[0], "id"), cells[1], asked, 2 * k, cells[2])
        else:
            near = knn.nearest(vectors, asked, 2 * k)
        return fusion.dense_channel(near, self._chunks(), k, options.tier, options.ext_filter)

    def sparse(self, queries: DataFrame, k: int, options: SearchOptions) -> DataFrame:
        index, pool = self.index, self._pool(options)
        if pool is None:
            found = bm25.search_index(index, queries, 2 * k)
        else:  # scores over the whole index, the cut among the chunks that pass
            found = bm25.score_queries(index, queries).join(pool.select("chunk_id"), "chunk_id", "left_semi")
        return fusion.sparse_channel(found, self._chunks(), k, options.tier, options.ext_filter)

    def like(self, document: bytes, uri: str, options: SearchOptions = SearchOptions()) -> DataFrame:
        """Chunks near a document, itself aside; its first 64 KiB are what is compared."""
        if self.embedder is None:
            raise EmbedderMissing("search by example needs an embedder")
        text = document[:LIKE_PREFIX].decode("utf-8", "replace")
        asked = self.store.spark.createDataFrame([(0, text)], "query_id long, query string")
        asked = self.embedder.embed(asked, text="query", prefix="search_document: ", out="vector")
        hits = self.dense_by_vector(asked, options.top_k + 1, replace(options, top_k=options.top_k + 1))
        kept = fusion.cut(hits.where(F.col("file_uri") != uri), "dense_rank", options.top_k)
        return fusion.post_process(kept, "final_rank", options.max_per_file)

    def explain(self, uri: str) -> dict[str, DataFrame]:
        from ..operators.metadata import explain_file

        found = explain_file(self.store.table("files"), self.store.table("chunks"), self.store.table("edges"), uri)
        if found is None:
            raise NotFound(uri)
        return found
