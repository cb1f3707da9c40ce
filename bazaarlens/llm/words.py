"""Words, shingles and min-hashes of whole texts as numpy arrays, for use inside Arrow tasks.

A word is a run of ASCII letters, digits and non-ASCII characters of the lower-cased text; all else separates words.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in blocks of about so many bytes; one longer text is a block of its own.
BLOCK_BYTES = 500_000
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def release() -> None:
    """Gives memory that a finished task no longer uses back to the system; a worker lives on beside other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable) -> Callable:
    """``run`` over a task's batches, with its memory given back at the end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64; kept for the usual block size."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, BLOCK_BYTES + 4096), base, np.uint64)
        steps[0] = 1
        made = np.cumprod(steps)
        if n > 4 * BLOCK_BYTES:
            return made[:n]
        _powers[key] = made
    return _powers[key][:n]


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) in blocks of about ``block_bytes``."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    ends = np.cumsum(size)
    row = 0
    while row < len(texts):
        base = ends[row] - size[row]
        stop = max(row + 1, int(np.searchsorted(ends, base + block_bytes, "right")))
        yield row, texts.slice(row, stop - row)
        row = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the texts' bounds in them; null counts as empty."""
    flat = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    flat = pa.concat_arrays([flat])
    at = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    if flat.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(flat) + 1, np.int64)
    return np.frombuffer(flat.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased bytes: first byte and end of each word, and the texts' bounds in words."""
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begin = at[:-1][at[:-1] < at[1:]]
    first[begin] |= inside[begin]
    final = at[1:][at[:-1] < at[1:]] - 1
    last[final] |= inside[final]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def hashes_between(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, from one running polynomial sum."""
    n = len(data)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_P, n), out=run[1:])
    return mix((run[ends] - run[starts]) * _power(_P_INV, n)[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block of texts, and the texts' bounds in them."""
    data, at = raw(pc.utf8_lower(pc.fill_null(texts, "")))
    starts, ends, bounds = word_bounds(data, at)
    return hashes_between(data, starts, ends), bounds


def shingles(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside each text, and the texts' bounds in them.

    A text of fewer than n words, but at least one, has one shingle of all its words.
    """
    count = np.diff(bounds)
    full = np.maximum(count - n + 1, 0)
    short = (count > 0) & (count < n)
    out_bounds = np.concatenate([[0], np.cumsum(full + short)])
    out = np.zeros(int(out_bounds[-1]), np.uint64)
    if len(words) >= n:
        run = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            run += words[k : len(words) - n + 1 + k] * np.uint64(2 * k * 0x2545F4914F6CDD1D + 1 & 0xFFFFFFFFFFFFFFFF)
        own = np.repeat(bounds[:-1] - out_bounds[:-1], full + short) + np.arange(len(out))
        keep = np.repeat(full > 0, full + short)
        out[keep] = mix(run[own[keep]])
    for i in np.flatnonzero(short):
        own = words[bounds[i] : bounds[i + 1]]
        out[out_bounds[i]] = mix(np.bitwise_xor.reduce(mix(own + np.arange(1, len(own) + 1, dtype=np.uint64)), keepdims=True) + np.uint64(len(own)))[0]
    return out, out_bounds


def seeds(n: int, salt: int = 1) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def min_hashes(values: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """k min-hashes of each text's values: array (texts, k) of 32-bit values; all ones where a text has none."""
    out = np.full((len(bounds) - 1, k), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        for j, m in enumerate(seeds(k)):
            out[some, j] = np.minimum.reduceat(((values ^ (m >> np.uint64(7))) * m >> np.uint64(32)).astype(np.uint32), bounds[some])
    return out
