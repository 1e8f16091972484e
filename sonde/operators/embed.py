"""Embedders: a column of vectors for a column of texts."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH, MAX_TOKENS, PAD_ID = 32, 512, 1
#: Texts that a task has as Python strings at once.
ROWS_HELD = 512


class Embedder(Protocol):
    dim: int

    def embed(self, rows: DataFrame, text: str, prefix: str, out: str) -> DataFrame: ...


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)


class HashEmbedder:
    """Deterministic unit vectors from hashed words and their pairs; needs no model."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            words = text.lower().split()
            for w in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
                h = xxhash.xxh64_intdigest(w)
                row[h % self.dim] += 1 if h >> 63 else -1
        return unit_rows(out).astype(np.float32)

    def embed(self, rows: DataFrame, text: str = "content", prefix: str = "", out: str = "vector") -> DataFrame:
        return _map(rows, text, prefix, out, self.encode)


class OnnxEmbedder:
    """A model folder with model.onnx and tokenizer.json: masked mean pooling, the first ``dim`` values, unit length.

    Texts go in batches of 32, sorted by length so that padding is short.
    """

    def __init__(self, folder: str, dim: int = 256):
        self.folder, self.dim = folder, dim

    @staticmethod
    def from_env(name: str = "SONDE_MODEL_DIR") -> OnnxEmbedder | None:
        folder = os.environ.get(name)
        return OnnxEmbedder(folder) if folder and os.path.isfile(os.path.join(folder, "model.onnx")) else None

    @staticmethod
    @lru_cache(maxsize=2)
    def _load(folder: str):
        import onnxruntime
        from tokenizers import Tokenizer

        return onnxruntime.InferenceSession(os.path.join(folder, "model.onnx")), Tokenizer.from_file(os.path.join(folder, "tokenizer.json"))

    def encode(self, texts: list[str]) -> np.ndarray:
        session, tokenizer = self._load(self.folder)
        out = np.zeros((len(texts), self.dim), np.float32)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i].encode()))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            ids = [tokenizer.encode(texts[i]).ids[:MAX_TOKENS] for i in rows]
            width = max(map(len, ids))
            tokens = np.full((len(ids), width), PAD_ID, np.int64)
            mask = np.zeros((len(ids), width), np.int64)
            for k, x in enumerate(ids):
                tokens[k, : len(x)], mask[k, : len(x)] = x, 1
            given = {"input_ids": tokens, "attention_mask": mask, "token_type_ids": np.zeros_like(tokens)}
            hidden = session.run(None, {i.name: given[i.name] for i in session.get_inputs()})[0]
            pooled = (hidden * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
            out[rows] = unit_rows(pooled[:, : self.dim])
        return out

    def embed(self, rows: DataFrame, text: str = "content", prefix: str = "", out: str = "vector") -> DataFrame:
        return _map(rows, text, prefix, out, self.encode)


def _map(rows: DataFrame, text: str, prefix: str, out: str, encode) -> DataFrame:
    keep = [f for f in rows.schema if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_HELD):
                part = batch.slice(at, ROWS_HELD)
                x = np.asarray(encode([prefix + (t or "") for t in part.column(text).to_pylist()]), np.float32)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=[*part.schema.names, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{out}` array<float>"])
    return rows.select(*(F.col(f.name) for f in keep)).mapInArrow(run, schema)
