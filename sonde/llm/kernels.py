"""NumPy kernels over whole Arrow string columns: bytes, words and hashed n-grams.

All work on the UTF-8 buffer of a batch at once; nothing here loops over characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes handled at once; bounds the memory of every kernel.
BLOCK = 1 << 21

_rng = np.random.Generator(np.random.PCG64(20240229))
_ODD = U64(0x9E3779B97F4A7C15)
_SHIFT = _rng.integers(1, 2**63, 8, dtype=np.int64).astype(U64) * U64(2) + U64(1)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): equal in, equal out, bits well spread."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and len+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]] if len(offs) else raw, offs - offs[0] if len(offs) else np.zeros(1, np.int64)


def runs(offs: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or a single longer row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Longer words are hashed one by one; shorter ones eight bytes at a time, all together.
_WIDE = 512
#: The first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def _long_word(raw: np.ndarray) -> np.uint64:
    """The hash of one word of any length (its bytes, zeros up to a multiple of eight)."""
    eights = raw.view("<u8")
    h = mix(np.arange(1, len(eights) + 1, dtype=U64) * _ODD) | U64(1)
    return mix(np.array([(eights * h).sum(dtype=U64)], U64))[0]


def _words(raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``raw`` and their start bytes; ``first``: where texts begin."""
    n = len(raw)
    gap = (raw == 32) | ((raw - np.uint8(9)) < 5)
    cut = np.ones(n + 1, bool)  # no word goes on across here
    cut[1:-1] = gap[:-1]
    cut[first[first < n]] = True
    at = np.flatnonzero(cut[:-1] & ~gap)
    if not len(at):
        return np.zeros(0, U64), at
    cut = cut[1:]
    cut[:-1] |= gap[1:]
    size = np.flatnonzero(cut & ~gap) + 1 - at
    low = np.zeros(n + 8, np.uint8)
    low[:n] = raw + (((raw - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))
    eight = np.ndarray((n,), "<u8", low, strides=(1,))
    h = mix((eight[at] & _FIRST[np.minimum(size, 8)]) ^ (size.astype(U64) * _ODD))
    more, done = np.flatnonzero(size > 8), 8
    while done < _WIDE and len(more):
        part = eight[at[more] + done] & _FIRST[np.minimum(size[more] - done, 8)]
        h[more] = mix(h[more] * _ODD ^ part)
        done += 8
        more = more[size[more] > done]
    for i in more:
        word = np.zeros(-(-int(size[i]) // 8) * 8, np.uint8)
        word[: size[i]] = low[at[i] : at[i] + size[i]]
        h[i] = h[i] ^ _long_word(word)
    return h, at


def word_table(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (maximal runs free of ASCII white space, A-Z lowered) and their start bytes."""
    if len(raw) <= 2 * BLOCK:
        return _words(raw, offs[:-1])
    parts, counts, lo = [], [], 0
    while lo < len(raw):  # one very long text: cut at white space
        hi = min(lo + BLOCK, len(raw))
        while hi < len(raw):
            gap = np.flatnonzero(_SPACE[raw[hi : hi + BLOCK]])
            if len(gap):
                hi += int(gap[0])
                break
            hi = min(hi + BLOCK, len(raw))
        inside = offs[(offs >= lo) & (offs < hi)] - lo
        h, at = _words(raw[lo:hi], inside)
        parts.append(h)
        counts.append(at + lo)
        lo = hi
    return np.concatenate(parts), np.concatenate(counts)


def word_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and, for each text, the index of its first word (len+1 entries)."""
    h, at = word_table(raw, offs)
    return h, np.searchsorted(at, offs)


def shingle_sets(raw: np.ndarray, offs: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles; a text
    of fewer words has its whole sequence as the one shingle, an empty one has none."""
    h, first = word_hashes(raw, offs)
    n = np.diff(first)
    full = np.zeros(max(0, len(h) - width + 1), U64)
    for k in range(width):
        full += h[k : k + len(full)] * _SHIFT[k]
    full = mix(full)
    for i in range(len(n)):
        if n[i] >= width:
            yield np.unique(full[first[i] : first[i + 1] - width + 1])
        elif n[i]:
            one = h[first[i] : first[i + 1]]
            yield mix(np.array([(one * _SHIFT[: n[i]]).sum(dtype=U64) ^ (U64(n[i]) * _SHIFT[7])], U64))
        else:
            yield np.zeros(0, U64)


def gram_buckets(raw: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, bucket of the n-gram at every byte) for n in ``sizes``; ends wrap to nothing."""
    base, h, power = np.uint32(0x01000193), np.zeros(len(raw), np.uint32), np.uint32(1)
    wide = raw.astype(np.uint32) + np.uint32(1)
    for n in range(1, max(sizes) + 1):
        if n > len(raw):
            return
        h = h[: len(raw) - n + 1] + wide[n - 1 :] * power
        power = np.uint32((int(power) * int(base)) & 0xFFFFFFFF)
        if n in sizes:
            x = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0xC2B2AE35)
            yield n, x >> np.uint32(32 - bits)


class Keys:
    """Whether 64-bit keys are among some: a table of their top bits first, then a search of those left.
    Built where it is first used, so that only the keys are sent."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.table = keys, None

    def __getstate__(self) -> tuple:
        return self.keys, None

    def __setstate__(self, state: tuple) -> None:
        self.keys, self.table = state

    def _build(self) -> None:
        if self.table is None:
            self.keys = np.sort(self.keys.view(U64))
            bits = min(26, max(16, len(self.keys).bit_length() + 3))  # so that few other keys pass
            self.table, self.shift = np.zeros(1 << bits, bool), U64(64 - bits)
            self.table[self.keys >> self.shift] = True

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        self._build()
        out = self.table[keys >> self.shift]
        at = np.flatnonzero(out)
        if len(at):
            out[at] = self.keys[np.minimum(self.place(keys[at]), len(self.keys) - 1)] == keys[at]
        return out

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Where keys stand, or would, in the order of those there are."""
        self._build()
        return np.searchsorted(self.keys, keys)
