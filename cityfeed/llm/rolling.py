"""Vectorised hashes over the bytes of many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
CHUNK_BYTES = 1 << 18

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers_of(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, BASE, np.uint64)
    up[0] = 1
    down = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse modulo 2^64, at least ``n`` of each."""
    return _powers_of(max(1 << 16, 1 << max(n - 1, 1).bit_length()))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any stretch; one more than there are bytes."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end): equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(sums))
    size = (ends - starts).astype(np.uint64) if isinstance(ends, np.ndarray) else np.uint64(ends - starts)
    return mix((sums[ends] - sums[starts]) * down[starts] + size * np.uint64(0xD6E8FEB86659FD93))


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES):
    """Neighbouring texts in lists of about ``limit`` bytes; a longer text stands alone."""
    now, size = [], 0
    for t in texts:
        if now and size + len(t) > limit:
            yield now
            now, size = [], 0
        now.append(t)
        size += len(t) + 1
    if now:
        yield now


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The hashes of the words of each text, in order."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, hashes = [], []
    lo = 0
    while lo < len(data):  # slices that end with a blank; a hash doesn't depend on where its word stands
        hi = min(lo + CHUNK_BYTES, len(data))
        while not SPACES[data[hi - 1]]:
            more = np.flatnonzero(SPACES[data[hi : hi + CHUNK_BYTES]])
            hi = hi + int(more[0]) + 1 if len(more) else min(hi + CHUNK_BYTES, len(data))
        part = data[lo:hi]
        edge = np.flatnonzero(np.diff(SPACES[part], prepend=True))
        hashes.append(stretch_hashes(prefix_sums(part), edge[::2], edge[1::2]))
        starts.append(edge[::2] + lo)
        lo = hi
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return np.split(np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds)[:-1])
