"""Planes to bits, in double precision numpy.

Resampling and the cosine transform are linear, so the low-frequency block of a plane is A . plane . B with two small
matrices that depend on its sides alone; the full transform is never made. Coefficients are rounded before the
median is taken: those that are 0 in theory must not get random signs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

ROUND = 6


def clamp(x, lo, hi):
    return np.minimum(np.maximum(x, lo), hi)


def cubic_weight(x):
    """Keys' cubic kernel with a = -1/2."""
    x = np.abs(np.asarray(x, float))
    near = 1.5 * x**3 - 2.5 * x**2 + 1
    far = -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2
    return np.where(x <= 1, near, np.where(x < 2, far, 0.0))


@lru_cache(maxsize=4096)
def resize_matrix(out: int, side: int) -> np.ndarray:
    """out x side: four taps around (i + 1/2) side / out, clamped at the edges, divided by their sum; no half-pixel shift."""
    u = (np.arange(out) + 0.5) / out * side
    first = np.floor(u).astype(int) - 1
    taps = first[:, None] + np.arange(4)
    w = cubic_weight(u[:, None] - taps)
    total = w.sum(axis=1, keepdims=True)
    w = np.where(total > 0, w / np.where(total > 0, total, 1), w)
    m = np.zeros((out, side))
    np.add.at(m, (np.repeat(np.arange(out), 4), clamp(taps, 0, side - 1).ravel()), w.ravel())
    return m


def resize(plane: np.ndarray, out: int) -> np.ndarray:
    h, w = plane.shape
    return resize_matrix(out, h) @ plane.astype(float) @ resize_matrix(out, w).T


@lru_cache(maxsize=64)
def dct_basis(n: int) -> np.ndarray:
    """Orthonormal DCT-II; rows are frequencies."""
    i, j = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.where(i == 0, np.sqrt(1 / n), np.sqrt(2 / n)) * np.cos((2 * j + 1) * i * np.pi / (2 * n))


@lru_cache(maxsize=64)
def low_rows(n: int, h: int, transform: str) -> np.ndarray:
    """h x n: what a plane of side n is multiplied by. 'reference' is D' A D, 'forward' D A D'."""
    d = dct_basis(n)
    return d[:, :h].T if transform == "reference" else d[:h]


@lru_cache(maxsize=4096)
def side_matrix(side: int, n: int, h: int, transform: str) -> np.ndarray:
    return low_rows(n, h, transform) @ resize_matrix(n, side)


def coefficients(planes: np.ndarray, h: int, factor: int, transform: str = "reference") -> np.ndarray:
    """planes (k, height, width) to (k, h * h) rounded coefficients; the first of each is set to 0."""
    _, height, width = planes.shape
    n = h * factor
    a, b = side_matrix(height, n, h, transform), side_matrix(width, n, h, transform)
    out = np.round(a @ planes.astype(float) @ b.T, ROUND).reshape(len(planes), h * h) + 0.0
    out[:, 0] = 0.0
    return out


def compare_exchange_sorted(values: np.ndarray) -> np.ndarray:
    """What a bitonic network without padding leaves, by rows; sorted only if the length is a power of two."""
    v = np.array(values, float)
    n = v.shape[1]
    width = 2
    while width <= 1 << max(0, (n - 1).bit_length()):
        stride = width // 2
        while stride:
            i = np.arange(n)
            partner = i ^ stride
            first = (partner > i) & (partner < n)
            i, j = i[first], partner[first]
            up = (i & width) == 0
            low, high = np.minimum(v[:, i], v[:, j]), np.maximum(v[:, i], v[:, j])
            v[:, i], v[:, j] = np.where(up, low, high), np.where(up, high, low)
            stride //= 2
        width *= 2
    return v


def medians(coef: np.ndarray, kind: str = "true") -> np.ndarray:
    if kind == "true":
        return np.median(coef, axis=1)
    v, n = compare_exchange_sorted(coef), coef.shape[1]
    return v[:, n // 2] if n % 2 else (v[:, n // 2 - 1] + v[:, n // 2]) / 2


def words(coef: np.ndarray, kind: str = "true") -> np.ndarray:
    """(k, 2) signed words: bit t of the pair is whether coefficient t is above the median."""
    bits = coef > medians(coef, kind)[:, None]
    padded = np.zeros((len(coef), 128), np.uint8)
    padded[:, : coef.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<i8")


def plane_coefficients(items, h: int, factor: int, transform: str = "reference") -> list[np.ndarray | None]:
    """Coefficients of each (luma bytes, width, height); None where these don't fit. Equal sides go through together."""
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (luma, width, height) in enumerate(items):
        if luma is not None and width and height and width > 0 and height > 0 and len(luma) == width * height:
            groups.setdefault((height, width), []).append(i)
    out: list[np.ndarray | None] = [None] * len(items)
    for (height, width), members in groups.items():
        step = max(1, 4_000_000 // (height * width))
        for first in range(0, len(members), step):
            own = members[first : first + step]
            planes = np.stack([np.frombuffer(items[i][0], np.uint8).reshape(height, width) for i in own])
            for i, c in zip(own, coefficients(planes, h, factor, transform)):
                out[i] = c
    return out


def hash_planes(items, options) -> list[tuple[int, int] | None]:
    """(w0, w1) of each (luma bytes, width, height); None where these don't fit."""
    found = plane_coefficients(items, options.hash_size, options.freq_factor, options.transform)
    out: list[tuple[int, int] | None] = [None] * len(items)
    own = [i for i, c in enumerate(found) if c is not None]
    if own:
        for i, w in zip(own, words(np.stack([found[i] for i in own]), options.median).tolist()):
            out[i] = (w[0], w[1])
    return out


def bit_positions(tables: int, bits: int) -> list[list[int]]:
    """Sampled bits of each table: 32-bit Mersenne Twister, seed 12345, modulo 128, table by table."""
    drawn = np.random.RandomState(12345).randint(0, 2**32, size=tables * bits, dtype=np.uint32) % 128
    return drawn.reshape(tables, bits).tolist()


def near_pairs(a: np.ndarray, b: np.ndarray | None, threshold: int):
    """(r, c, distance) arrays of all rows a[r], b[c] of signed words (k, 2) that differ in fewer than threshold bits, in
    pieces; without b of the pairs r < c of a."""
    u, v = a.view(np.uint64), (a if b is None else b).view(np.uint64)
    wide = bool(u[:, 1].any() or v[:, 1].any())
    u, v = np.ascontiguousarray(u.T), np.ascontiguousarray(v.T)
    step = max(1, (1 << 17) // max(1, v.shape[1]))
    for at in range(0, u.shape[1], step):
        least = at if b is None else 0
        d = np.bitwise_count(u[0, at : at + step, None] ^ v[0, None, least:])
        if wide:
            d += np.bitwise_count(u[1, at : at + step, None] ^ v[1, None, least:])
        flat = np.flatnonzero(d < threshold)
        r, c = np.divmod(flat, d.shape[1])
        if b is None:
            above = r < c
            flat, r, c = flat[above], r[above], c[above]
        if len(r):
            yield r + at, c + least, d.ravel()[flat]


def packed(i: np.ndarray, j: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, ...]:
    """ids, best, count, near, dist of the edges (i, j): each node, its nearest neighbour (of equally near ones the smallest
    id), its number of neighbours, these as places in ids, one node after the other, and the distance of the nearest."""
    ids, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    own, m = at.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32), len(i)
    order = np.argsort(own, kind="stable")
    near, count = np.concatenate([own[m:], own[:m]])[order], np.bincount(own, minlength=len(ids))
    key = np.concatenate([dist, dist]).astype(np.int64)[order] << 32 | near
    key = np.minimum.reduceat(key, np.cumsum(count) - count) if m else key
    return ids, ids[key & 0xFFFFFFFF], count.astype(np.int32), near, (key >> 32).astype(np.int32)


def to_bytes(arrays: tuple[np.ndarray, ...]) -> bytes:
    head = [len(arrays), *(x for a in arrays for x in (len(a), ord(a.dtype.char)))]
    return b"".join([np.array(head, np.int64).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def from_bytes(data: bytes) -> list[np.ndarray]:
    """The arrays of to_bytes(), which are read only."""
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head, at, out = np.frombuffer(data, np.int64, 2 * n, 8).tolist(), 8 + 16 * n, []
    for size, kind in zip(head[::2], head[1::2]):
        out.append(np.frombuffer(data, chr(kind), size, at))
        at += out[-1].nbytes
    return out
