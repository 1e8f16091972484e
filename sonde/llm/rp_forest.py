"""Nearest neighbours by inner product: a forest of random-projection trees.

Trees are fitted on a bounded sample: a node's direction joins two of its points and its
cut is the median of their projections; they deepen with the table, until a leaf has about ``LEAF`` of
the sample's points. All vectors are then indexed. A query searches all trees at once through one
priority queue. A node's priority is the chance that a neighbour lies below it: along the way, at each
cut, a neighbour projects normally around a multiple of the query's own projection. Leaves are
taken until the chance that a neighbour is in none of them, over all trees, is below a level; the multiple, and
the spread around it by the cosine, are those of the sample's own k-th neighbours. The level is set by measured
recall: some points of the sample ask for their true neighbours in it, and ``RECALL`` of these must be found. So
the share of rows looked at follows from the data. Without any structure the search takes all leaves, and is exact.

Leaves are dealt into buckets of about ``BUCKET`` rows, crowded leaves over several. A query goes once
to each bucket with the list of its leaves there, in rounds: first to the bucket where its neighbours most likely
are, then to the next 3, 12, 48 and so on. The best of all rounds before are merged and give a bound, and a bucket
returns only rows not below it. So the rows that a query gets back grow about with the logarithm of its buckets, not
with their number (rows that tie with the bound all come back). What is returned is scored again, exactly, on the original vectors in double precision. Buckets that
many queries visit in a round are read by several tasks.

Equal vectors are one row of the index with the smallest ids that could be asked for, so a
vector repeated a million times is searched once, ties and all. Nothing is dropped, at any size.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import longs, many_tasks, materialize

TREES, LEAF, SAMPLE = 8, 64, 100_000
#: The share of the true neighbours of ``PROBES`` points of the sample that a search must find.
RECALL, PROBES = 0.95, 200
#: Rows of a bucket, and queries that visit it in one task.
BUCKET, ASKING = 16_384, 16_384


class Forest:
    """Trees as flat arrays; ``left``/``right`` below 0 name leaf -1-value. Leaves of a subtree are numbered in a row."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 1):
        rng, self.roots, self.leaves = np.random.default_rng(seed), [], 0
        normal, cut, middle, spread, left, right = [], [], [], [], [], []

        def grow(rows: np.ndarray) -> int:
            for _ in range(4 if len(rows) > leaf else 0):
                a, b = sample[rng.choice(rows, 2, replace=False)]
                way = a - b
                size = np.linalg.norm(way)
                if not size:
                    continue
                far = sample[rows] @ (way / size)
                at = float(np.median(far))
                low = far < at
                if not low.any():
                    low = far <= at
                if low.all():
                    continue
                i = len(cut)
                normal.append(way / size), cut.append(at), middle.append(float(far.mean())), spread.append(float(far.std()))
                left.append(0), right.append(0)
                left[i], right[i] = grow(rows[low]), grow(rows[~low])
                return i
            self.leaves += 1
            return -self.leaves

        for _ in range(trees):
            self.roots.append(grow(np.arange(len(sample))))
        d = sample.shape[1]
        self.normal, self.cut = np.array(normal, np.float32).reshape(-1, d), np.array(cut, np.float32)
        self.middle, self.spread = np.array(middle, np.float32), np.array(spread, np.float32)
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree: rows x trees."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            while (go := np.flatnonzero(node >= 0)).size:
                at = node[go]
                low = np.einsum("ij,ij->i", self.normal[at], x[go]) < self.cut[at]
                node[go] = np.where(low, self.left[at], self.right[at])
            out[:, t] = -1 - node
        return out

    def search(self, x: np.ndarray, like: tuple[float, float], miss: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each row of x the leaves to visit, through one queue over all trees, the chances of a neighbour there,
        and the chance before each visit that it is in none of those visited; visits end where that is ``miss`` at most."""
        left, right = self.left.tolist(), self.right.tolist()
        slope, rho = like
        noise = 1.702 / (np.maximum(self.spread, 1e-12) * np.sqrt(max(1e-6, 1 - rho**2)))  # a normal's distribution as a logistic one's
        for q in x:
            z = (self.cut - (slope * (self.normal @ q) + max(0.0, 1 - slope) * self.middle)) * noise
            low, high = (-np.logaddexp(0, -z)).tolist(), (-np.logaddexp(0, z)).tolist()  # logarithms of the chances
            queue = [(0.0, t, root) for t, root in enumerate(self.roots)]
            lost, leaves, chances, levels = [1.0] * len(queue), [], [], []
            while queue and (level := math.prod(lost)) > miss:
                bad, t, node = heapq.heappop(queue)
                while node >= 0:
                    a, b = bad - low[node], bad - high[node]
                    if a <= b:
                        heapq.heappush(queue, (b, t, right[node]))
                        bad, node = a, left[node]
                    else:
                        heapq.heappush(queue, (a, t, left[node]))
                        bad, node = b, right[node]
                leaves.append(-1 - node), chances.append(math.exp(-bad)), levels.append(level)
                lost[t] = max(1e-12, lost[t] - chances[-1])
            yield np.array(leaves, np.int64), np.array(chances), np.array(levels)


def tune(forest: Forest, sample: np.ndarray, total: int, k: int) -> tuple[tuple[float, float], float]:
    """How points are like their neighbours (the mean multiple of a point in its neighbour, the mean cosine), and the
    level at which a search may end: what some points of the sample show of their k nearest of ``total`` rows, of which
    the sample has every total / len(sample)-th."""
    if len(sample) < 3:
        return (0.0, 0.0), -1.0
    probes = np.linspace(0, len(sample) - 1, min(PROBES, len(sample)), dtype=int)
    asked = sample[probes]
    near = asked @ sample.T
    near[np.arange(len(asked)), probes] = -np.inf
    rank = min(len(sample) - 1, max(5, round(k * len(sample) / total)))  # a few at least, which are then further off
    true = np.argpartition(-near, rank - 1, 1)[:, :rank]
    products = np.take_along_axis(near, true, 1).min(1)
    last = true[np.arange(len(asked)), np.take_along_axis(near, true, 1).argmin(1)]
    sizes = np.maximum(1e-30, np.linalg.norm(asked, axis=1))
    cosine = products / (sizes * np.maximum(1e-30, np.linalg.norm(sample[last], axis=1)))
    like = float(max(0.0, (products / sizes**2).mean())), float(np.clip(cosine.mean(), 0.0, 0.999))
    placed, found = forest.place(sample[true.ravel()]).reshape(len(asked), rank, -1), []
    for own, (leaves, _, levels) in zip(placed, forest.search(asked, like, -1.0), strict=True):
        when = np.zeros(forest.leaves)
        when[leaves] = levels
        found.append(when[own].max(1))  # the level when the first of its leaves is visited
    found = np.sort(np.concatenate(found))[::-1]
    return like, float(found[int(np.ceil(RECALL * len(found))) - 1]) * (1 - 1e-9)


def _usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part: ids not null, vectors of the commonest length, all components finite, not all 0."""
    x = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = x.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(~odd & F.exists("v", lambda c: c != 0))
    common = x.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return x.where(F.size("v") == common[0]["d"]) if common else x


def _buckets(rows_in: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf the bucket of its first part, and its parts (each of a crowded leaf's in a bucket of its own)."""
    parts, first = np.maximum(1, -(-rows_in // BUCKET)), np.zeros(len(rows_in), np.int64)
    bucket, held = 0, 0
    for i, n in enumerate(rows_in.tolist()):
        if held and held + n > BUCKET:
            bucket, held = bucket + 1, 0
        first[i] = bucket
        held += n
        if parts[i] > 1:
            bucket, held = bucket + int(parts[i]), 0
    return first, parts


def _rounds(chances: np.ndarray) -> np.ndarray:
    """The round in which each bucket is visited, by the chances of a neighbour there: 1, 3, 12, 48 ... buckets, likeliest first."""
    nth = np.empty(len(chances), np.int64)
    nth[np.argsort(-chances, kind="stable")] = np.arange(len(chances))
    return np.ceil(np.log2(1 + nth) / 2).astype(np.int64)


def nearest_neighbours(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is a multiple of ``every``.

    Nearness is the inner product in double precision; ties go to the smaller id; a row is
    no neighbour of its own id. Null ids and null, zero and non-finite vectors take no part, nor do
    vectors of another length than the commonest (the shortest of the commonest lengths). Repeated rows
    count once; an id with several vectors asks with all and is found by its best, and its
    list may then be shorter. Fewer candidates than k give fewer rows; no vectors, none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, vec_id, vector)
    # One row for each different vector (0.0 and -0.0 the same): its number and its k+1 smallest ids.
    flat = rows.select("id", F.transform("v", lambda c: c + F.lit(0.0)).alias("v")).distinct()
    ranked = flat.withColumn("h", F.xxhash64("v")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = lambda c: F.slice(F.array_sort(c), 1, k + 1)
    some = ranked.groupBy("h", "v", "salt").agg(few(F.collect_set("id")).alias("ids"))
    index = some.groupBy("h", "v").agg(few(F.flatten(F.collect_list("ids"))).alias("ids")).select("v", "ids", F.element_at("ids", 1).alias("vid"))
    # An id with several vectors: its least one is ``vid`` by id, the others by a number of their own below all ids.
    index = index.withColumn("nth", F.row_number().over(Window.partitionBy("vid").orderBy("v"))).withColumn("vid", F.when(F.col("nth") == 1, F.col("vid")).otherwise(F.xxhash64("vid", "v")))
    index = materialize(index.select("v", "ids", "vid"), "ann-index")
    total = index.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    draw = F.pmod(F.xxhash64("vid", F.lit(9)), F.lit(1 << 30)) / (1 << 30)
    points = index.where(draw < 1.1 * sample / total).select("vid", F.transform("v", lambda c: c.cast("float")).alias("v")).orderBy("vid").limit(sample).toArrow()  # at most `sample` rows
    points = points.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(points.num_rows, -1)
    grown = Forest(points, trees, leaf)
    like, miss = tune(grown, points, total, k)
    forest = spark.sparkContext.broadcast(grown)  # bounded by the sample

    def single(column: pd.Series) -> np.ndarray:
        return np.array(column.tolist(), np.float32).reshape(len(column), -1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = single(pdf["v"])
            leaf, raw = forest.value.place(x), np.array([r.tobytes() for r in x], object)
            yield pd.DataFrame({"vid": np.repeat(pdf["vid"].to_numpy(), leaf.shape[1]), "leaf": leaf.ravel(), "b": np.repeat(raw, leaf.shape[1])})

    placed = materialize(index.select("vid", "v").mapInPandas(place, "vid long, leaf long, b binary"), "ann-leaf")
    leaf_of, counted = longs(placed.groupBy("leaf").agg(F.count("*").alias("n")))  # a row a leaf: bounded by the sample and the trees
    rows_in = np.zeros(forest.value.leaves, np.int64)
    rows_in[leaf_of] = counted
    first, parts = _buckets(rows_in)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, out = single(pdf["v"]), []
            for vid, row, (leaves, chances, _) in zip(pdf["vid"], x, forest.value.search(x, like, miss), strict=True):
                order = np.argsort(leaves)
                times = parts[leaves[order]]
                leaves, chances = np.repeat(leaves[order], times), np.repeat(chances[order] / times, times)
                new = np.concatenate([[True], leaves[1:] != leaves[:-1]])
                bucket = first[leaves] + np.arange(len(leaves)) - np.maximum.accumulate(np.where(new, np.arange(len(leaves)), 0))
                order = np.argsort(bucket, kind="stable")
                bucket, leaves = bucket[order], leaves[order]
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                nth = _rounds(np.add.reduceat(chances[order], cuts))
                out += [(vid, int(bucket[c]), own.tolist(), row.tobytes(), int(r)) for c, own, r in zip(cuts, np.split(leaves, cuts[1:]), nth, strict=True)]
            yield pd.DataFrame(out, columns=["qv", "bucket", "leaves", "b", "round"])

    asks = flat.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "v", F.xxhash64("v").alias("h"))
    keyed = index.withColumn("h", F.xxhash64("v"))
    own = materialize(asks.join(keyed.select("h", F.col("v").alias("xv"), "vid"), "h").where(F.col("v") == F.col("xv")).select("query_id", F.col("vid").alias("qv")), "ann-own")
    asked = materialize(index.select("vid", "v").join(own.select(F.col("qv").alias("vid")).distinct(), "vid"), "ann-asked")
    visits = many_tasks(asked, "vid").mapInPandas(look, "qv long, bucket long, leaves array<long>, b binary, round long")
    visits = materialize(visits, "ann-visits")
    which, visited, asking = longs(visits.groupBy("round", "bucket").agg(F.count("*").alias("n")))  # a row a bucket and round
    turns = np.zeros((int(which.max(initial=0)) + 1, int(max(first.max(initial=0) + parts.max(initial=1), visited.max(initial=0))) + 1), np.int64)
    turns[which, visited] = -(-asking // ASKING)  # none for buckets that no query visits in a round

    def mixed(ids: pd.Series) -> np.ndarray:
        return (ids.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)

    def deal(turns: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                at = pdf["leaf"].to_numpy()
                bucket = first[at] + (mixed(pdf["vid"]) % parts[at].astype(np.uint64)).astype(np.int64)
                times = turns[bucket]
                out = pdf.assign(bucket=bucket).loc[pdf.index.repeat(times)]
                yield out.assign(turn=np.arange(len(out)) - np.repeat(np.cumsum(times) - times, times))

        return run

    def take_turns(turns: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(turn=(mixed(pdf["qv"]) % turns[pdf["bucket"].to_numpy()].astype(np.uint64)).astype(np.int64))

        return run

    most = 2 * k + 2  # more than k+1, as these products are rounded

    def best(key: tuple, queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(found):
            return pd.DataFrame({"qv": [], "vid": [], "near": []}).astype({"qv": "int64", "vid": "int64", "near": "float64"})
        found = found.sort_values("leaf", ignore_index=True)
        q, x = (np.frombuffer(b"".join(t["b"]), np.float32).reshape(len(t), -1) for t in (queries, found))
        ids, at = found["vid"].to_numpy(), found["leaf"].to_numpy()
        asked = np.repeat(np.arange(len(q)), queries["leaves"].map(len))
        leaves = np.concatenate(queries["leaves"].to_numpy())
        order = np.lexsort((asked, leaves))
        asked, leaves = asked[order], leaves[order]
        cuts = np.flatnonzero(np.concatenate([[True], leaves[1:] != leaves[:-1]]))
        who, which, near = [], [], []
        for who_asks, name in zip(np.split(asked, cuts[1:]), leaves[cuts], strict=True):
            lo, hi = np.searchsorted(at, [name, name + 1])
            if hi == lo:
                continue
            products, keep = q[who_asks] @ x[lo:hi].T, min(most, hi - lo)
            top = np.argpartition(-products, keep - 1, 1)[:, :keep] if keep < hi - lo else np.tile(np.arange(keep), (len(products), 1))
            who.append(np.repeat(who_asks, keep)), which.append(lo + top.ravel()), near.append(np.take_along_axis(products, top, 1).ravel())
        if not who:
            return best(key, queries.iloc[:0], found)
        who, which, near = np.concatenate(who), ids[np.concatenate(which)], np.concatenate(near)
        above = near >= queries["bound"].to_numpy()[who] - 1e-5
        who, which, near = who[above], which[above], near[above]
        order = np.lexsort((which, -near, who))
        who, which, near = who[order], which[order], near[order]
        if not len(who):
            return best(key, queries.iloc[:0], found)
        again = np.concatenate([[False], (who[1:] == who[:-1]) & (which[1:] == which[:-1])])  # one row in leaves of two trees
        who, which, near = who[~again], which[~again], near[~again]
        start = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        rank = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who))))
        some = rank < most
        return pd.DataFrame({"qv": queries["qv"].to_numpy()[who[some]], "vid": which[some], "near": near[some].astype(float)})

    def ask(some: DataFrame, turns: np.ndarray) -> DataFrame:
        asking = some.select("qv", "bucket", "leaves", "b", "bound").mapInPandas(take_turns(turns), "qv long, bucket long, leaves array<long>, b binary, bound double, turn long")
        held = placed.mapInPandas(deal(turns), "vid long, leaf long, b binary, bucket long, turn long")
        return asking.groupBy("bucket", "turn").cogroup(held.groupBy("bucket", "turn")).applyInPandas(best, "qv long, vid long, near double")

    top, order = None, Window.partitionBy("qv").orderBy(F.desc("near"), "vid")
    for i, own_turns in enumerate(turns):  # as many rounds as the logarithm of the buckets
        some, found = visits.where(F.col("round") == i).withColumn("bound", F.lit(float("-inf"))), None
        if top is not None:
            top = materialize(top, f"ann-top-{i}")
            bounds = top.where(F.col("n") == most).select("qv", F.col("near").alias("least"))
            some = some.join(bounds, "qv", "left").withColumn("bound", F.coalesce("least", "bound"))
            found = top.select("qv", "vid", "near")
        more = ask(some, own_turns)
        merged = (more if found is None else found.unionByName(more)).groupBy("qv", "vid").agg(F.max("near").alias("near"))
        top = merged.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    top = top.select("qv", "vid")
    # Exact scores on the originals, then all ids of equal vectors, the query's own aside.
    scored = top.join(index.select("vid", F.col("v").alias("xv"), "ids"), "vid").join(asked.select(F.col("vid").alias("qv"), "v"), "qv")
    dot = F.aggregate(F.zip_with("v", "xv", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
    scored = scored.select("qv", dot.alias("score"), F.explode("ids").alias("vec_id"))
    # All queries with one vector share its k+1 best, as each leaves out one id at most.
    shared = scored.withColumn("n", F.row_number().over(Window.partitionBy("qv").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    final = own.join(shared, "qv").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    final = final.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return final.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
