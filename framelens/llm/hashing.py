"""Vectorised hashing of words and character n-grams of many texts at once (numpy, inside tasks)."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_FINAL = np.uint64(0xD6E8FEB86659FD93)
_FOLD = np.full(256, 32, dtype=np.uint8)
for _b in range(256):
    if chr(_b).isalnum() and _b < 128 or _b >= 128:
        _FOLD[_b] = ord(chr(_b).lower()) if _b < 128 else _b
#: Texts are handled together up to this many bytes; a longer text is handled alone.
PIECE_BYTES = 1 << 18


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with letters in lower case (ASCII and Latin-1) and all ASCII signs as spaces."""
    out = _FOLD[data]
    upper = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    out[1:][upper] += 0x20
    return out


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, starts): runs of texts with a space before, between and after."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > PIECE_BYTES:
            yield first, i, *_join(texts[first:i])
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts), *_join(texts[first:])


def _join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    starts = np.cumsum([1] + [len(t) + 1 for t in texts])
    return data, starts


class Rolling:
    """Hashes of any substrings of ``data``: prefix sums of a polynomial modulo 2^64."""

    _powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Rolling._powers[0]) < n:
            Rolling._powers = tuple(_geometric(b, n) for b in (_BASE, _INVERSE))
        up, self._down = (p[:n] for p in Rolling._powers)
        self._sum = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=self._sum[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sum[end] - self._sum[start]) * self._down[start])

    def windows(self, n: int) -> np.ndarray:
        """The hash of every window of ``n`` bytes."""
        if len(self._sum) <= n:
            return np.zeros(0, dtype=np.uint64)
        return mixed((self._sum[n:] - self._sum[:-n]) * self._down[:len(self._sum) - n])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _FINAL
    return h ^ (h >> np.uint64(29))


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.ones(1 << max(n - 1, 1).bit_length(), dtype=np.uint64)
    size, power = 1, base
    while size < len(out):
        out[size:2 * size] = out[:size] * np.uint64(power)
        size, power = 2 * size, power * power % (1 << 64)
    return out


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space; the first and last byte are spaces."""
    inside = (data != 32).view(np.int8)
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1


def owner(starts: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Index of the text that holds each position."""
    return np.searchsorted(starts, positions, side="right") - 1


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in smaller parts, so that few texts are copied out of Arrow at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def counted(rows: np.ndarray, buckets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, bucket) with their counts, in order of row."""
    key, count = np.unique(rows.astype(np.int64) * width + buckets.astype(np.int64), return_counts=True)
    return key // width, key % width, count
