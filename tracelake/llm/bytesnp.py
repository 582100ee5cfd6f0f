"""Numpy helpers that run inside Spark tasks over the UTF-8 bytes of an Arrow batch of texts.

A batch is cut into pieces of about one megabyte of whole texts, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240229).integers(1, 2**64 - 1, 256, dtype=U)
_BASE, _STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U(pow(int(_BASE), -1, 1 << 64))
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(n, b, U)])) for b in (_BASE, inverse))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(PIECE + (1 << 17), 1 << int(n).bit_length()))


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts; a null text counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        yield at, to, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def prefix_hashes(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """C with C[j] - C[i] the polynomial of bytes i to j, still multiplied by base**i."""
    table = _RANDOM[_LOWER] if lower else _RANDOM
    out = np.zeros(len(data) + 1, U)
    np.cumsum(table[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word of ``[^\\x20\\x09-\\x0D]+``; words end where their text ends."""
    word = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | first[1:-1]
    ends[:-1] &= ~word[1:] | first[1:-1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool) -> np.ndarray:
    c = prefix_hashes(data, lower)
    return mix((c[e] - c[s]) * powers(len(data))[1][s])


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k word hashes, in order; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out = out * _STEP + h[j : j + n]
    return mix(out)


def word_rows(data: np.ndarray, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes of a piece, and where each row's words begin (one more entry than rows)."""
    s, e, row = spans(data, offs)
    return word_hashes(data, s, e, lower), np.searchsorted(row, np.arange(len(offs)))


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles, lower-cased; a shorter text is one shingle, an empty one none."""
    h, at = word_rows(data, offs, lower=True)
    runs = windows(h, k)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            out.append(windows(h[a:b], b - a) ^ U(b - a))
        else:
            out.append(np.zeros(0, U))
    return out


def lists(rows: list[np.ndarray]) -> pa.Array:
    """A list<int64> column."""
    offs = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    values = np.concatenate(rows).view(np.int64) if len(rows) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values))
