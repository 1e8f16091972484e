"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Training (Wang and Manning 2012): over a bounded sample of labelled texts, executors count
for each hashed n-gram the toxic and clean texts that hold it. r = log of the ratio of the
two smoothed shares. The ``FEATURES`` n-grams whose r is surest (r over its standard
error) are kept; a text's features are its capped counts of them times r, and a logistic
regression on these is fitted on the driver. Scoring is one pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import blocks, doc_grams, logistic
from .kernels import utf8
from .scratch import fresh_name, materialize, small_batches

SIZES, BITS = (3, 4, 5, 6), 20
#: The most labelled texts that are learnt from, half of each class if there are so many; chosen by a hash of the text.
MAX_TRAIN = 8000
FEATURES, CAP, SMOOTH, RIDGE = 600, 6, 0.5, 1.0


@dataclass(frozen=True)
class ToxicityModel:
    buckets: np.ndarray  # n-gram buckets of the features
    weights: np.ndarray  # per capped count
    bias: float

    def table(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, np.int16)
        out[self.buckets] = np.arange(len(self.buckets), dtype=np.int16)
        return out


def _capped_counts(text: np.ndarray, starts: np.ndarray, table: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, capped count) of the features that occur."""
    keys = [np.zeros(0, np.int64)]
    for row, bucket in doc_grams(text, starts, SIZES, BITS):
        which = table[bucket]
        hit = which >= 0
        keys.append(row[hit] * width + which[hit])
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key // width, key % width, np.minimum(count, CAP)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, toxic texts, clean texts) of the task's rows."""
    seen = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        raw, offs = utf8(batch.column("text"))
        label = batch.column("label").to_numpy(zero_copy_only=False)
        for a, b, text, starts in blocks(raw, offs, 64):
            for row, bucket in doc_grams(text, starts, SIZES, BITS):
                key = np.unique(row.astype(np.int64) << BITS | bucket)
                np.add.at(seen, (label[a:b][key >> BITS], key & ((1 << BITS) - 1)), 1)
    used = np.flatnonzero(seen.any(0))
    for i in range(0, len(used), 65536):
        u = used[i : i + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(seen[1, u], pa.int64()), pa.array(seen[0, u], pa.int64())], names=["bucket", "toxic", "clean"])


def train_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Fit on the texts of ``docs`` that ``labels`` (doc_id, 0/1) marks.

    Null labels or ids are left out; a text labelled twice counts as toxic if any label is, and
    counts once, however many rows hold it, so that ``MAX_TRAIN`` bounds what is learnt from and sent to
    the driver. Null texts are empty; long ones are whole; ties in the choice go by the text's hash.
    Without labels of both classes the model gives every text the share of toxic labels (0 without any).
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("label")).distinct()
    keyed = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    known = materialize(keyed.select("id", "t").join(known, "id").groupBy("t").agg(F.max("label").alias("label")), "tox-known")
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), 20.0 * (2 * (1 in n) - 1))
    small = min(MAX_TRAIN // 2, *n.values())
    total = {c: min(k, small if k == small else MAX_TRAIN - small) for c, k in n.items()}
    rate = {c: total[c] / k for c, k in n.items()}
    chosen = [known.where(F.col("label") == c).orderBy(F.xxhash64("t", F.lit(4)), "t").limit(total[c]) for c in n]
    picked = chosen[0].unionByName(chosen[1])  # ``MAX_TRAIN`` rows at most
    once = keyed.select("t", "text").join(F.broadcast(picked), "t").groupBy("t").agg(F.first("label").alias("label"), F.first("text").alias("text"))
    rows = materialize(once.repartition(spark.sparkContext.defaultParallelism, "t").select("text", "label"), "tox-sample")
    n = total
    counts = rows.mapInArrow(_tally, "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = F.log((F.col("toxic") + SMOOTH) / (n[1] + 2 * SMOOTH)) - F.log((F.col("clean") + SMOOTH) / (n[0] + 2 * SMOOTH))
    error = F.sqrt(1 / (F.col("toxic") + SMOOTH) + 1 / (F.col("clean") + SMOOTH))
    best = counts.where("toxic + clean >= 3").select("bucket", ratio.alias("r"), F.abs(ratio / error).alias("z")).orderBy(F.desc("z"), "bucket").limit(FEATURES).collect()
    buckets, r = np.array([x["bucket"] for x in best], np.int64), np.array([x["r"] for x in best])
    table, width = ToxicityModel(buckets, r, 0.0).table(), max(1, len(buckets))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column("text"))
            dense = np.zeros((batch.num_rows, width), np.uint8)
            for a, _, text, starts in blocks(raw, offs):
                row, which, count = _capped_counts(text, starts, table, width)
                dense[a + row, which] = count
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([x.tobytes() for x in dense], pa.binary())], names=["label", "x"])

    got = rows.mapInArrow(vectors, "label int, x binary").toPandas()  # ``MAX_TRAIN`` rows of ``FEATURES`` bytes at most
    x = np.frombuffer(b"".join(got["x"]), np.uint8).reshape(-1, width)
    order = np.lexsort((*x.T[:8], got["label"]))  # the same fit whatever order the rows came in
    y = got["label"].to_numpy()[order].astype(np.float64)
    w = logistic(x[order] * r.astype(np.float32), y, np.ones(len(y)), RIDGE)
    return ToxicityModel(buckets, w[:-1] * r, float(w[-1] - np.log(rate[1] / rate[0])))


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns and score (0 to 1) of every row.

    Null and empty texts get the score of no n-gram at all; long ones are whole; null ids and repeated rows are
    kept, each with its score; an empty table gives no rows. A kept column may not be called score (an error).
    """
    if "score" in {c.lower() for c in keep}:
        raise ValueError("a kept column is named score")
    small_batches(docs.sparkSession)
    mine = fresh_name(docs, "scored_text")
    rows = docs.select(*keep, F.col(text).alias(mine))
    table, width, weights, bias = model.table(), max(1, len(model.buckets)), model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column(mine))
            total = np.full(batch.num_rows, bias)
            for a, b, text_, starts in blocks(raw, offs):
                row, which, count = _capped_counts(text_, starts, table, width)
                total[a:b] += np.bincount(row, weights[which] * count, b - a) if len(row) else 0.0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(1 / (1 + np.exp(-np.clip(total, -700, 700))))], names=[*keep, "score"])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "score double"]))
