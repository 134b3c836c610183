"""Words, hashes and shingles of whole Arrow batches of texts, in numpy.

Texts are UTF-8 bytes. White space is [\\x20\\x09-\\x0D], upper case A-Z; both are ASCII, so bytes do.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once: what eight-byte arrays of it need stays in a few tens of MB.
SLICE = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_VALUES = _VALUES[_LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INV, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2^64; made for sizes of powers of two."""
    size = SLICE * 2
    while size < n:
        size *= 2
    up, down = _powers(size)
    return up[:n], down[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a string or binary array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def slices(offsets: np.ndarray, limit: int = SLICE):
    """Ranges of documents of about limit bytes; a longer document is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def prefix_hash(data: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(c, inverse): (c[j] - c[i]) * inverse[i] hashes bytes i to j, wherever they stand."""
    up, down = powers(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=c[1:])
    return c, down


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in lower case, index of each document's first word, with the end)."""
    n = len(data)
    inside = ~_SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    after[ends] = False
    stops = np.flatnonzero(inside & ~after) + 1
    c, down = prefix_hash(data, _WORD_VALUES)
    hashes = mix((c[stops] - c[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingles(offsets: np.ndarray, data: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Of each document the sorted distinct hashes of its shingles of size words; a shorter one is one shingle.

    Works through slices of the batch, so its memory follows the longest text or a MB, not the batch."""
    out: list[np.ndarray] = []
    keys = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    for first, last in slices(offsets):
        at, bytes_ = offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]]
        w, begin = words(at, bytes_)
        n = len(w)
        full = np.zeros(max(0, n - size + 1), np.uint64)
        for j in range(size):
            full += w[j : j + len(full)] * keys[j]
        full = mix(full)
        for d in range(last - first):
            a, b = int(begin[d]), int(begin[d + 1])
            if b - a >= size:
                out.append(np.unique(full[a : b - size + 1]))
            elif b > a:
                out.append(mix(mix((w[a:b] * keys[: b - a]).sum(dtype=np.uint64, keepdims=True)) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
