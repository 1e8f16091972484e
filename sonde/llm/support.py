"""Exact support of hashed keys up to a bound: the few least values that go with each key.

Whether a key has ``k`` different values (documents, votes) is told by its k least ones, and the k
least of a union are among the k least of its parts. So tasks combine before the one shuffle, in
NumPy, and send blobs of keys and values: a key that a third of all rows hold costs k values a
task. Keys are spread evenly, as they are hashes; a reducing task holds one ``SUB``-th of its
share at a time. Exact at every size; nothing is estimated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import U64

#: Keys that a task holds before it combines and sends them.
FLUSH = 1 << 20
#: Parts of a reducing task's share.
SUB = 8
#: Keys are multiplied by an odd number on the way, as some are the least of many hashes and so all small.
_STIR = 0x9E3779B97F4A7C15
_BACK = pow(_STIR, -1, 1 << 64)

Arrays = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]


def least(key: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least different values of each key, by key and value."""
    order = np.argsort(key)
    key, value = key[order], value[order]
    same = key[1:] == key[:-1]
    many = np.zeros(len(key), bool)
    many[1:] = same
    many[:-1] |= same
    if many.any():
        mine, own = value[many], key[many]
        value[many] = mine[np.lexsort((mine, own))]
        keep = np.ones(len(key), bool)
        keep[1:] = ~same | (value[1:] != value[:-1])
        key, value = key[keep], value[keep]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        keep = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key)))) < k
        key, value = key[keep], value[keep]
    return key, value


def _blobs(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 8).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])


def _combine(arrays: Arrays, k: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for key, value in arrays(batch):
                held.append((key, value))
                size += len(key)
                if size >= FLUSH:
                    yield send(held)
                    held, size = [], 0
        if size:
            yield send(held)

    def send(held: list) -> pa.RecordBatch:
        key, value = least(np.concatenate([x.view(U64) for x, _ in held]) * U64(_STIR), np.concatenate([x.view(np.int64) for _, x in held]), k)
        place = ((key >> U64(32)) * U64(parts * SUB) >> U64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        ends, place = np.append(first, len(key)), place[first]
        return pa.RecordBatch.from_arrays([pa.array(place // SUB, pa.int32()), pa.array(place % SUB, pa.int32()), _blobs(key, ends), _blobs(value, ends)], names=["part", "sub", "keys", "held"])

    return run


def _reduce(k: int, need: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for sub, keys, values in zip(batch.column("sub").to_pylist(), batch.column("keys").to_pylist(), batch.column("held").to_pylist(), strict=True):
                if sub != now:
                    yield from found(held)
                    now, held = sub, []
                held.append((np.frombuffer(keys, U64), np.frombuffer(values, np.int64)))
        yield from found(held)

    def found(held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        key, value = least(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), k)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        take = size >= need
        value = value[np.repeat(take, size)]
        for at in range(0, int(take.sum()), 65536):
            some = slice(at, at + 65536)
            ends = np.concatenate([[0], np.cumsum(size[take])])
            lo, hi = ends[at], ends[min(at + 65536, len(ends) - 1)]
            lists = pa.ListArray.from_arrays(pa.array((ends[at : at + 65537] - lo).astype(np.int32)), pa.array(value[lo:hi]))
            yield pa.RecordBatch.from_arrays([pa.array((key[first][take][some] * U64(_BACK)).view(np.int64)), lists], names=["key", "held"])

    return run


def least_values(source: DataFrame, arrays: Arrays, k: int, need: int | None = None) -> DataFrame:
    """(key, held): the k least different values of each key, for keys with at least ``need`` (k) of them.

    ``arrays`` turns a batch of ``source`` into (keys, values), both of 64 bits; keys are hashes.
    """
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = source.mapInArrow(_combine(arrays, k, parts), "part int, sub int, keys binary, held binary")
    dealt = sent.repartitionById(parts, "part").sortWithinPartitions("sub").select("sub", "keys", "held")
    return dealt.mapInArrow(_reduce(k, k if need is None else need), "key long, held array<long>")
