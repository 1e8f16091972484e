"""Nearest neighbours by Euclidean distance: exact, and over cells of a k-means partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one pass over the vectors takes to every task; more are done in several passes.
BLOCK = 2048
#: Numbers of a matrix of queries and vectors that a task holds, pairs whose differences it takes, and rows that it sends at once.
CELLS, PAIRS, SENT = 1_000_000, 8192, 50_000


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


Found = tuple[np.ndarray, np.ndarray, np.ndarray]
NONE: Found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _nearest_rows(x: np.ndarray, names: np.ndarray, q: np.ndarray, limit: int, held: Found = NONE) -> Found:
    """(query number, id, distance) of the ``limit`` nearest to each row of q among the rows of x and ``held``; ties by id.

    In blocks of rows, so that no matrix has more than ``CELLS`` numbers or a row's. A matrix product finds
    who can be among them; their distances are then taken from the differences, so that equal vectors tie.
    """
    own = (q * q).sum(1)[:, None]
    block = max(1, CELLS // max(1, len(q)))
    for at in range(0, len(x), block):
        rows = x[at : at + block]
        squares = (rows * rows).sum(1)
        near = squares[None] + own - 2 * (q @ rows.T)
        edge = _bounds(held, len(q), limit)
        if limit < len(rows) and np.isinf(edge).any():
            edge = np.minimum(edge, np.partition(near, limit - 1, 1)[:, limit - 1 : limit])
        who, row = np.nonzero(near <= edge + 1e-9 * (1 + squares.max() + own))
        parts = [slice(i, i + PAIRS) for i in range(0, len(who), PAIRS)]
        d = np.concatenate([np.zeros(0), *(np.round(np.sqrt(((rows[row[p]] - q[who[p]]) ** 2).sum(1)), 9) for p in parts)])
        held = least(*(np.concatenate([a, b]) for a, b in zip(held, (who, names[at : at + block][row], d), strict=True)), limit)
    return held


def _bounds(held: Found, queries: int, limit: int) -> np.ndarray:
    """The square of the distance that a row must not exceed to be among the nearest, a column."""
    out = np.full(queries, np.inf)
    last = np.flatnonzero(np.append(held[0][1:] != held[0][:-1], True)) if len(held[0]) else held[0]
    full = np.bincount(held[0], minlength=queries)[held[0][last]] == limit
    out[held[0][last[full]]] = (held[2][last[full]] + 1e-9) ** 2
    return out[:, None]


def least(who: np.ndarray, ids: np.ndarray, d: np.ndarray, limit: int) -> Found:
    """The rows with the ``limit`` least d of each of who, in order of who, d and id."""
    order = np.lexsort((ids, d, who))
    who, ids, d = who[order], ids[order], d[order]
    first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, int)
    keep = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who)))) < limit
    return who[keep], ids[keep], d[keep]


def nearest(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, distance, place) of the ``limit`` nearest of each query; ties by id.

    ``vectors`` (id, vector), ``queries`` (query_id, vector). Queries are a batch that people or
    jobs ask, read to the driver in blocks of ``BLOCK``; each block is one scan of the vectors
    with a running top list in every task, so only limit rows a query and task are shuffled.
    """
    asked = queries.select("query_id", "vector").orderBy("query_id").toLocalIterator()
    parts, block = [], []

    def scan(rows: list) -> DataFrame:
        ids = np.array([r["query_id"] for r in rows], np.int64)
        q = np.array([list(r["vector"]) for r in rows], np.float64).reshape(len(rows), -1)

        def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = NONE
            for batch in batches:
                if batch.num_rows and len(q):
                    x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    held = _nearest_rows(x.reshape(batch.num_rows, -1), batch.column("id").to_numpy(), q, limit, held)
            for at in range(0, len(held[0]), SENT):
                who, found, d = (a[at : at + SENT] for a in held)
                yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(found), pa.array(d)], names=["query_id", "id", "distance"])

        rows = vectors.where("vector IS NOT NULL").select(F.col("id").cast("long").alias("id"), "vector")
        return rows.mapInArrow(top, "query_id long, id long, distance double")

    for row in asked:
        block.append(row)
        if len(block) == BLOCK:
            parts.append(scan(block))
            block = []
    if block or not parts:
        parts.append(scan(block))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def cell_count(n: int) -> int:
    return max(4, min(1024, int(n**0.5) * 4))


def build_cells(vectors: DataFrame, cells: int | None = None, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """``vectors`` with their cell, and the cells' centres; fitted on at most about 256 rows a cell."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    cells = min(cells or cell_count(n), max(2, n))
    features = vectors.withColumn("__f", array_to_vector(F.col("vector").cast("array<double>")))
    sample = features.sample(min(1.0, 256 * cells / max(1, n)), seed=seed)
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="__f", predictionCol="cell").fit(sample)
    return model.transform(features).drop("__f"), np.array(model.clusterCenters())


def enough_probes(cells: DataFrame, centres: np.ndarray, limit: int, recall: float = 0.95, asked: int = 200) -> int:
    """The least number of probes that finds this share of the true ``limit`` nearest of ``asked`` vectors of the table (those of the least hashed ids)."""
    some = cells.orderBy(F.xxhash64("id"), "id").limit(asked).select(F.col("id").alias("query_id"), "vector")
    true = nearest(cells, some, limit).join(cells.select("id", "cell"), "id").select("query_id", "cell").toPandas()
    if not len(true):
        return len(centres)
    at = {r["query_id"]: np.array(list(r["vector"]), np.float64) for r in some.collect()}
    order = {k: np.argsort(np.argsort(((v - centres) ** 2).sum(1), kind="stable"), kind="stable") for k, v in at.items()}
    place = np.sort([order[k][c] for k, c in zip(true["query_id"], true["cell"], strict=True)])
    return int(place[int(np.ceil(recall * len(place))) - 1]) + 1


def nearest_in_cells(cells: DataFrame, centres: np.ndarray, queries: DataFrame, limit: int, probes: int) -> DataFrame:
    """Like ``nearest``, but only among the ``probes`` cells nearest to each query."""

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = ((_matrix(pdf["vector"])[:, None, :] - centres[None]) ** 2).sum(2)
            near = np.argsort(d, 1, kind="stable")[:, :probes]
            yield pd.DataFrame({"query_id": np.repeat(pdf["query_id"].to_numpy(), near.shape[1]), "cell": near.ravel().astype(np.int32), "q": np.repeat(np.array([list(v) for v in pdf["vector"]] + [None], object)[:-1], near.shape[1])})

    asked = queries.select("query_id", "vector").mapInPandas(choose, "query_id long, cell int, q array<double>")

    def best(key: tuple, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "id": [], "distance": []}).astype({"query_id": "int64", "id": "int64", "distance": "float64"})]
        if len(q) and len(x):
            who, ids, d = _nearest_rows(_matrix(x["vector"]), x["id"].to_numpy(), _matrix(q["q"]), limit)
            out.append(pd.DataFrame({"query_id": q["query_id"].to_numpy()[who], "id": ids, "distance": d}))
        return pd.concat(out, ignore_index=True)

    found = asked.groupBy("cell").cogroup(cells.select("id", "vector", "cell").groupBy("cell")).applyInPandas(best, "query_id long, id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
