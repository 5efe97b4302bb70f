"""Vectorised word and shingle hashing over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import mix64

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 18

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_CASED = np.where(SPACES, np.uint64(0), _BYTE)
_FOLDED = _CASED.copy()
_FOLDED[65:91] = _CASED[97:123]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of whole texts of about CHUNK bytes; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offs = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK, "right")) - 1)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all words and, per text, the index of its first word (one more entry than texts)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~SPACES[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    inner = offs[(offs > 0) & (offs < len(data))]
    start[inner] = word[inner]
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; with ``fold``, A-Z count as a-z."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    span = np.diff(np.append(starts, len(data)))
    values = (_FOLDED if fold else _CASED)[data[starts[0] :]]
    longest = int(span.max())
    power = np.full(longest, _STEP, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    pos = np.arange(len(values), dtype=np.int64) - np.repeat(starts - starts[0], span)
    return mix64(np.add.reduceat(values * power[pos], starts - starts[0]))


_PLACES = np.random.default_rng(17).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_runs(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in text order, and per text the index of its first one.

    A text of fewer than ``k`` words, but some, has its whole sequence as one shingle.
    """
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    if len(words) == 0:
        return np.zeros(0, np.uint64), at
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    rolled = np.zeros(len(words), np.uint64)
    for i in range(k):
        rolled += padded[i : i + len(words)] * _PLACES[i]
    short = np.flatnonzero((count > 0) & (count < k))
    for d in short:
        own = words[first[d] : first[d + 1]]
        rolled[first[d]] = np.append(own * _PLACES[: len(own)], _PLACES[-len(own) :][:1]).sum(dtype=np.uint64)
    keep = np.repeat(first[:-1], n) + np.arange(at[-1]) - np.repeat(at[:-1], n)
    return mix64(rolled[keep]), at


def text_shingles(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, shingle hashes in text order, number of words) of each text."""
    for i, j, data, offs in chunks(column):
        starts, first = word_spans(data, offs)
        runs, at = shingle_runs(word_hashes(data, starts), first, k)
        for d in range(j - i):
            yield i + d, runs[at[d] : at[d + 1]], int(first[d + 1] - first[d])
