"""Words and hashed word shingles of batches of texts: words are as in WORD, ASCII letters in lower case."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from permlab.llm.common import spans_of, text_bytes

WIDTH = 5
#: Bytes of text taken at a time.
STEP = 1 << 20
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[BLANK] = 32
_rng = np.random.default_rng(30)
_POWER = _rng.integers(0, 1 << 63, 65, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of `width` words of all texts, and the n + 1 offsets of the texts."""
    data, offsets = text_bytes(texts)
    parts, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in spans_of(np.diff(offsets), STEP):
        x, n = _shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
        parts.append(x)
        counts.append(n)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def _shingles(body: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    texts = len(offsets) - 1
    if not len(body):
        return np.zeros(0, np.uint64), np.zeros(texts, np.int64)
    solid = ~BLANK[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(solid & (~np.append(False, solid[:-1]) | edge[:-1]))
    end = np.flatnonzero(solid & (~np.append(solid[1:], False) | edge[1:])) + 1
    words = np.bincount(np.searchsorted(offsets, start, "right") - 1, minlength=texts)
    if not len(start):
        return np.zeros(0, np.uint64), words
    size = end - start
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    byte = LOWER[body[np.repeat(start, size) + place]]
    h = np.add.reduceat((byte.astype(np.uint64) + np.uint64(1)) * _POWER[place % 64], np.cumsum(size) - size)
    h = mixed(h + size.astype(np.uint64) * _POWER[64])
    n = len(h) - width + 1
    counts = np.maximum(words - width + 1, 0)
    if n <= 0:
        return np.zeros(0, np.uint64), counts
    s = np.zeros(n, np.uint64)
    for k in range(width):
        s += h[k : k + n] * _PLACE[k]
    first = np.cumsum(words) - words
    inside = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return mixed(s[inside]), counts
