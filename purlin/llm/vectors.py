"""Hashed document vectors, their projections, and Hilbert keys. numpy only; no Spark."""

from __future__ import annotations

import zlib

import numpy as np

BUCKETS = 512
DIMS, BITS = 4, 15  # 60 bits of key


def projection(dims: int, seed: int, buckets: int = BUCKETS) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((buckets, dims)).astype(np.float32)


def word_bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def id_buckets(vocabulary: int) -> np.ndarray:
    """The bucket of every token id."""
    ids = np.arange(vocabulary, dtype=np.uint64)
    return ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)).astype(np.int64)


def project(buckets: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Projected unit vector of a document whose words fall into ``buckets``; zeros if it has none."""
    if not len(buckets):
        return np.zeros(matrix.shape[1], np.float32)
    v = np.sqrt(np.bincount(buckets, minlength=len(matrix)).astype(np.float32))
    return (v / np.sqrt(v @ v)) @ matrix


def hilbert_keys(points: np.ndarray, bits: int = BITS, reach: float = 4.0) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``points`` (clipped to +-reach), as int64.

    The coordinates are brought to the curve's transposed form by undoing, from the highest bit down, the
    exchanges and reflections of the sub-cubes, and then Gray-decoded; all rows at once.
    """
    n, dims = points.shape
    top = (1 << bits) - 1
    x = np.clip((points / (2 * reach) + 0.5) * top, 0, top).astype(np.int64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key
