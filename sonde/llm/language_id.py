"""Language identification with error-correcting output codes.

Each learned language has a codeword; each bit is predicted by a binary logistic classifier
on hashed character n-gram shares. Decoding is weighted by loss: the language whose
codeword loses least over all bits' margins wins, and a small lead over the second is
flagged as ambiguous. Up to 7 languages get the exhaustive code, in which any two words
differ in half the bits; more get random words far apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import blocks, doc_grams
from .kernels import utf8
from .scratch import fresh_name, materialize, small_batches

SIZES, BITS = (1, 2, 3, 4), 12
#: The most texts learnt from, shared evenly by the languages; chosen by a hash of the text.
MAX_TRAIN = 3000
#: The most languages learnt, those of the most different texts (on ties the first by name).
MAX_LANGUAGES = 100
RIDGE, STEPS = 1e-4, 300
#: A lead in loss, per bit, under which a prediction is flagged.
AMBIGUOUS = 0.15


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits of -1, 1
    weights: np.ndarray  # buckets + 1 x bits, the last row the intercepts


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1."""
    if n <= 1:
        return np.zeros((n, 0))
    if n <= 7:
        bits = [[1 if i == 0 or (b >> (i - 1)) & 1 else -1 for i in range(n)] for b in range(2 ** (n - 1) - 1)]
        return np.array(bits, float).T
    width, rng, best, apart = 10 * int(np.ceil(np.log2(n))), np.random.default_rng(n), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, width))
        near = int(((width - code @ code.T) / 2 + width * np.eye(n)).min())
        if near > apart and (np.abs(code.sum(0)) < n).all():
            best, apart = code, near
    return best


def _shares(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Row by bucket: square roots of n-gram shares, so that each row has length 1 (0 without n-grams)."""
    rows, width = len(starts) - 1, 1 << BITS
    count = np.zeros(rows * width)
    for row, bucket in doc_grams(text, starts, SIZES, BITS):
        count += np.bincount(row * width + bucket, minlength=rows * width)
    count = count.reshape(rows, width)
    return np.sqrt(count / np.maximum(1, count.sum(1, keepdims=True))).astype(np.float32)


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights for each column of y (-1, 1), by accelerated gradient descent."""
    rate = 1 / (0.25 * (max(1e-6, _top(x) / len(x)) + 1) + RIDGE)
    w = v = np.zeros((x.shape[1] + 1, y.shape[1]))  # the last row: intercepts
    for t in range(STEPS):
        slope = -y / (1 + np.exp(np.clip(y * (x @ v[:-1].astype(x.dtype) + v[-1]), -30, 30)))
        down = np.vstack([x.T @ slope.astype(x.dtype), slope.sum(0)])
        new = v - rate * (down / len(x) + RIDGE * v)
        w, v = new, new + t / (t + 3) * (new - w)
    return w


def _top(x: np.ndarray) -> float:
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    return float(np.linalg.norm(x @ v) ** 2) * 1.05


def train_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from the rows whose lang and text are not null; a table without any gives a model without languages.

    A text counts once for a language, however many rows hold it, so that ``MAX_TRAIN`` bounds what is learnt
    from and sent to the driver. Texts are whole; null ids take part like others; ties in the choice go by the
    text's hash. ``doc_id`` is not used.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(text)).alias("t"))
    known = materialize(rows.select("lang", "t").distinct(), "lang-known")
    top = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    languages = tuple(sorted(r["lang"] for r in top))
    code = codewords(len(languages))
    if len(languages) < 2:
        return LanguageModel(languages, code, np.zeros(((1 << BITS) + 1, 0)))
    most = max(1, MAX_TRAIN // len(languages))
    # About twice as many as are taken are ranked, so that a common language does not go to one task.
    rate = F.coalesce(*(F.when(F.col("lang") == r["lang"], min(1.0, (2 * most + 20) / r["n"])) for r in top))
    draw = F.pmod(F.xxhash64("t", F.lit(6)), F.lit(1 << 30))
    order = Window.partitionBy("lang").orderBy("draw", "t")
    ranked = known.withColumn("draw", draw).where(F.col("draw") < rate * (1 << 30))
    chosen = ranked.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    picked = rows.join(F.broadcast(chosen.select("lang", "t")), ["lang", "t"]).groupBy("lang", "t").agg(F.first("text").alias("text"))  # ``MAX_TRAIN`` rows at most

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column("text"))
            out = [v.tobytes() for _, _, t, s in blocks(raw, offs) for v in _shares(t, s).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(out, pa.binary())], names=["lang", "x"])

    got = picked.select("text", "lang").mapInArrow(vectors, "lang string, x binary").toPandas().sort_values(["lang", "x"])  # rows of 8 KB
    x = np.empty((len(got), 1 << BITS), np.float32)
    for row, raw in zip(x, got.pop("x"), strict=True):
        row[:] = np.frombuffer(raw, np.float16)
    y = code[np.searchsorted(languages, got["lang"].to_numpy(str))]
    return LanguageModel(languages, code, _fit(x, y))


def identify_languages(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns, lang_pred, score and ambiguous of every row; a kept column may not have one of these names (an error).

    Null ids and repeated rows are kept, each with its prediction; long texts are whole; of equal losses the
    first language by name wins, flagged as ambiguous; an empty table gives no rows. Null text and text without a letter, or any text under a model without languages: ``und``,
    score 0, ambiguous. Else the language of least loss; score is its share of exp(-loss).
    """
    if {"lang_pred", "score", "ambiguous"} & {c.lower() for c in keep}:
        raise ValueError("a kept column is named like a result")
    small_batches(docs.sparkSession)
    mine = fresh_name(docs, "asked_text")
    rows = docs.select(*keep, F.col(text).alias(mine))
    languages, code, weights = np.array([*model.languages, "und"], object), model.code, model.weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column(mine))
            letters = pc.match_substring_regex(pc.fill_null(batch.column(mine), ""), r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
            best, score, lead = np.full(batch.num_rows, len(code)), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for a, b, t, s in blocks(raw, offs):
                if not len(code):
                    continue
                margin = (_shares(t, s) @ weights[:-1] + weights[-1]).astype(np.float64)
                loss = np.logaddexp(0, -margin[:, None, :] * code[None]).sum(2)
                order = np.sort(loss, 1)
                best[a:b] = loss.argmin(1)
                score[a:b] = 1 / np.exp(order[:, :1] - loss).sum(1)
                lead[a:b] = (order[:, 1] - order[:, 0]) / max(1, code.shape[1]) if len(code) > 1 else 1.0
            best[~letters], score[~letters], lead[~letters] = len(code), 0.0, 0.0
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(languages[best], pa.string()), pa.array(score), pa.array(lead < AMBIGUOUS)], names=[*keep, "lang_pred", "score", "ambiguous"]
            )

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double", "ambiguous boolean"]))
