"""The functions that SQL can call by name, once ``register_all(spark)`` has run.

Scalar: ``sonde_porter``, ``sonde_fold``, ``sonde_count_tokens``, ``sonde_decode``, ``sonde_balanced``, ``sonde_embed``.
Aggregate: ``sonde_mean_vector``. Table: ``sonde_chunks(content, mime, name, uri)``, for LATERAL joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.chunking.parsers import PARSERS, Document
from ..operators.chunking.tokens import Counter, decode
from ..operators.embed import HashEmbedder
from . import fixed, porter

_OPEN = {")": "(", "]": "[", "}": "{"}


def balanced(text: str) -> bool:
    stack: list[str] = []
    for c in text:
        if c in "([{":
            stack.append(c)
        elif c in _OPEN and (not stack or stack.pop() != _OPEN[c]):
            return False
    return not stack


def parser_name(mime: str) -> str:
    """Like ``functions.text.parser_for``, for one type."""
    mime = mime.split(";")[0].strip().lower()
    named = {
        "application/pdf": "binary", f"{fixed.OOXML}.wordprocessingml.document": "binary", "application/msword": "binary", f"{fixed.OOXML}.spreadsheetml.sheet": "xlsx", "application/vnd.ms-excel": "xlsx",
        "text/csv": "csv", "text/markdown": "markdown", "text/x-rust": "rust", "text/typescript": "script", "text/javascript": "script", "application/javascript": "script",
    }
    return named.get(mime) or ("plaintext" if mime.startswith("text/") else "binary")


class ChunkDocument:
    """Rows (tier, chunk_index, content, token_count, meta) of one document; none if it can't be parsed."""

    def eval(self, content: bytes, mime: str, name: str, uri: str) -> Iterator[tuple]:
        try:
            yield from PARSERS[parser_name(mime)](Document(uri or "", name, mime, bytes(content), Counter())).chunks
        except Exception:  # noqa: BLE001 - a document that can't be parsed has no chunks
            return


def register_all(spark: SparkSession, tokenizer: str | None = None, dim: int = 64) -> None:
    @F.pandas_udf("string")
    def sonde_porter(words: pd.Series) -> pd.Series:
        return words.map(porter.term, na_action="ignore")

    @F.pandas_udf("string")
    def sonde_fold(words: pd.Series) -> pd.Series:
        return words.map(porter.fold, na_action="ignore")

    @F.pandas_udf("long")
    def sonde_count_tokens(texts: pd.Series) -> pd.Series:
        return texts.map(Counter(tokenizer).count, na_action="ignore")

    @F.pandas_udf("string")
    def sonde_decode(data: pd.Series) -> pd.Series:
        return data.map(decode, na_action="ignore")

    @F.pandas_udf("boolean")
    def sonde_balanced(texts: pd.Series) -> pd.Series:
        return texts.map(balanced, na_action="ignore")

    @F.pandas_udf("array<float>")
    def sonde_embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(HashEmbedder(dim).encode(texts.fillna("").tolist())))

    @F.pandas_udf("array<double>")
    def sonde_mean_vector(vectors: pd.Series) -> np.ndarray:
        return np.mean(np.array([list(v) for v in vectors], np.float64), axis=0)

    for f in (sonde_porter, sonde_fold, sonde_count_tokens, sonde_decode, sonde_balanced, sonde_embed, sonde_mean_vector):
        spark.udf.register(f.func.__name__, f)
    table = F.udtf(ChunkDocument, returnType="tier int, chunk_index long, content string, token_count long, meta string")
    spark.udtf.register("sonde_chunks", table)
