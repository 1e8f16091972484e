"""Ranking: channels, weighted reciprocal rank fusion, path boost, tier and file rules.

All functions take result tables keyed by query_id; ties always go by chunk_id.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import extension, name_tokens, path_coverage
from ..functions.vectors import confidence


@dataclass(frozen=True)
class Weights:
    dense: float = 1.0
    sparse: float = 0.4
    path: float = 1.5

    @staticmethod
    def resolve(env: dict[str, str] | None = None) -> Weights:
        """The defaults, or what SONDE_W_DENSE, SONDE_W_SPARSE and SONDE_W_PATH say."""
        env = dict(os.environ) if env is None else env

        def value(name: str, default: float) -> float:
            try:
                return float(env.get(f"SONDE_W_{name}", default))
            except ValueError:
                return default

        return Weights(value("DENSE", 1.0), value("SPARSE", 0.4), value("PATH", 1.5))

    @property
    def total(self) -> float:
        return self.dense + self.sparse + self.path


@dataclass(frozen=True)
class SearchOptions:
    mode: str = "hybrid"
    top_k: int = 10
    tier: int | None = None
    candidate_pool: int = 100
    max_per_file: int = 3
    ext_filter: str | None = None
    filter_mode: str = "post"  # "pre" filters before candidates are cut off

    def __post_init__(self):
        if self.tier not in (None, 1, 2, 3):
            raise ValueError("tier is 1, 2 or 3")

    @property
    def pool(self) -> int:
        return max(self.candidate_pool, self.top_k)


def restrict(hits: DataFrame, tier: int | None, ext: str | None) -> DataFrame:
    """The hits of a tier and an extension; applied after candidates are cut off, so it may leave fewer than asked."""
    if tier is not None:
        hits = hits.where(F.col("tier") == tier)
    if ext:
        hits = hits.where(extension(F.col("file_uri")) == "." + ext.lstrip(".").lower())
    return hits


def _ranked(hits: DataFrame, order: list, k: int, name: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def dense_channel(nearest: DataFrame, chunks: DataFrame, k: int, tier: int | None = None, ext: str | None = None) -> DataFrame:
    """``nearest`` (query_id, id, distance), at most 2k a query, joined with ``chunks`` (chunk_id, lance_id, file_uri,
    tier, content, ...) on lance_id, filtered, cut to k: plus dense_score, dense_rank, normalized_score."""
    hits = nearest.select("query_id", F.col("id").alias("lance_id"), F.col("distance").alias("dense_score")).join(chunks, "lance_id")
    ranked = _ranked(restrict(hits, tier, ext), ["dense_score", "chunk_id"], k, "dense_rank")
    return ranked.withColumn("normalized_score", confidence(F.col("dense_score")))


def sparse_channel(found: DataFrame, chunks: DataFrame, k: int, tier: int | None = None, ext: str | None = None) -> DataFrame:
    """``found`` (query_id, chunk_id, score), at most 2k a query, joined, filtered, cut to k: plus sparse_score, sparse_rank, normalized_score."""
    hits = found.select("query_id", "chunk_id", F.col("score").alias("sparse_score")).join(chunks, "chunk_id")
    ranked = _ranked(restrict(hits, tier, ext), ["sparse_score", "chunk_id"], k, "sparse_rank")
    most = F.max(F.abs("sparse_score")).over(Window.partitionBy("query_id"))
    return ranked.withColumn("normalized_score", F.abs("sparse_score") / F.greatest(most, F.lit(2.2250738585072014e-308)))


def rrf_fuse(dense: DataFrame, sparse: DataFrame, queries: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """All chunks of either channel with rrf_score, normalized_score and fused_rank.

    ``dense``/``sparse`` (query_id, chunk_id, file_uri, tier, content, *_score, *_rank);
    where both have a chunk its columns come from ``dense``. ``queries`` (query_id, query)
    are the words for the boost of files whose names they match.
    """
    shared = [c for c in ("file_uri", "tier", "content") if c in dense.columns and c in sparse.columns]
    d = dense.select("query_id", "chunk_id", *shared, "dense_score", "dense_rank")
    s = sparse.select("query_id", "chunk_id", *(F.col(c).alias(f"s_{c}") for c in shared), "sparse_score", "sparse_rank")
    both = d.join(s, ["query_id", "chunk_id"], "full_outer").select(
        "query_id", "chunk_id", *(F.coalesce(c, f"s_{c}").alias(c) for c in shared), "dense_score", "dense_rank", "sparse_score", "sparse_rank"
    )
    words = queries.select("query_id", name_tokens(F.col("query")).alias("query_tokens"))
    both = both.join(words, "query_id", "left")
    boost = F.lit(0.0)
    if weights.path > 0 and "file_uri" in shared:
        boost = F.coalesce(path_coverage(F.col("file_uri"), F.col("query_tokens")), F.lit(0.0)) * (weights.path / (fixed.RRF_K + 1))
    score = F.coalesce(F.lit(weights.dense) / (fixed.RRF_K + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(F.lit(weights.sparse) / (fixed.RRF_K + F.col("sparse_rank")), F.lit(0.0)) + boost
    scored = both.withColumn("rrf_score", score).drop("query_tokens")
    norm = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("rrf_score") * (fixed.RRF_K + 1) / weights.total))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "chunk_id")
    return scored.withColumn("normalized_score", norm).withColumn("fused_rank", F.row_number().over(order))


def drop_covered_summaries(hits: DataFrame) -> DataFrame:
    """Without the tier 3 hits of files that have a tier 1 or 2 hit for the same query."""
    finer = F.max((F.col("tier") < 3).cast("int")).over(Window.partitionBy("query_id", "file_uri"))
    return hits.withColumn("__finer", finer).where((F.col("tier") < 3) | (F.col("__finer") == 0)).drop("__finer")


def cap_per_file(hits: DataFrame, rank: str, most: int) -> DataFrame:
    order = Window.partitionBy("query_id", "file_uri").orderBy(rank)
    return hits.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


def post_process(hits: DataFrame, rank: str, max_per_file: int) -> DataFrame:
    return cap_per_file(drop_covered_summaries(hits), rank, max_per_file)


def cut(hits: DataFrame, rank: str, k: int) -> DataFrame:
    """The first k of each query, with ``rank`` renumbered from 1 as ``final_rank``."""
    order = Window.partitionBy("query_id").orderBy(rank)
    return hits.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= k)


def finish(hits: DataFrame, rank: str, options: SearchOptions, fused: bool) -> DataFrame:
    """Fused results are capped and then cut; single channels were cut before and are only capped."""
    capped = post_process(hits, rank, options.max_per_file)
    return cut(capped, rank, options.top_k if fused else 1 << 30)


def unique_paths(hits: DataFrame) -> DataFrame:
    """Files of each query in the order of their best hit."""
    return hits.groupBy("query_id", "file_uri").agg(F.min("final_rank").alias("first_rank"))
