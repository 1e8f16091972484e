"""Text preparation and small linear-model fits shared by the two classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .kernels import gram_buckets, runs

#: Bytes of text handled at once; n-grams take about 50 bytes of memory for each.
BLOCK = 1 << 20

#: ASCII letters in lower case, bytes of other scripts as they are, all else a space.
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def padded(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The plain bytes of each text with one space before it and one at the very end; where each text's space is."""
    starts = offs + np.arange(len(offs))
    out = np.full(int(starts[-1]) + 1, 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[starts] = False
    out[keep] = _PLAIN[raw]
    return out, starts


def blocks(raw: np.ndarray, offs: np.ndarray, rows: int = 256) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, padded bytes, starts) for blocks of few rows and bytes."""
    for i, j in runs(offs, BLOCK):
        for a in range(i, j, rows):
            b = min(a + rows, j)
            yield a, b, *padded(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])


def doc_grams(text: np.ndarray, starts: np.ndarray, sizes: tuple[int, ...], bits: int, step: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every n-gram that lies within one text and its two spaces.

    Long texts come in steps of bounded memory; n-grams across a step's edge are kept.
    """
    most = max(sizes)
    for lo in range(0, len(text), step):
        part = text[lo : lo + step + most - 1]
        row = np.searchsorted(starts, np.arange(lo, min(lo + step, len(text))), "right") - 1 if len(starts) > 2 else None
        for n, bucket in gram_buckets(part, sizes, bits):
            bucket = bucket[:step]
            at = np.arange(lo, lo + len(bucket))
            if row is None:
                own = np.zeros(len(bucket), np.int64)
            else:
                own = row[: len(bucket)]
            good = (own < len(starts) - 1) & (at + n <= starts[np.minimum(own + 1, len(starts) - 1)] + 1)
            yield own[good], bucket[good]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 30) -> np.ndarray:
    """Weights of an L2-regularised logistic regression by Newton's method; the last is the intercept, which is not penalised."""
    w, penalty = np.zeros(x.shape[1] + 1), np.full(x.shape[1] + 1, ridge)
    penalty[-1] = 1e-6
    curve = np.empty((len(w), len(w)))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(x.dtype) + w[-1], -30, 30)))
        off, turn = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        gradient = np.append(x.T @ off.astype(x.dtype), off.sum()) + penalty * w
        curve[:-1, :-1] = sum((x[i : i + 1024] * turn[i : i + 1024, None]).T @ x[i : i + 1024] for i in range(0, len(x), 1024))
        curve[-1, :-1] = curve[:-1, -1] = x.T @ turn.astype(x.dtype)
        curve[-1, -1] = turn.sum()
        change = np.linalg.solve(curve + np.diag(penalty), gradient)
        w -= change * min(1.0, 8 / max(1e-9, np.abs(change).max()))
        if np.abs(change).max() < 1e-4:
            break
    return w
