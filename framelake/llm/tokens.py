"""Vectorised tokens of whole batches of texts: one pass of numpy over their joined UTF-8 bytes."""

import functools

import numpy as np
import pyarrow as pa

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
_SPACE = np.zeros(256, np.uint8)
_SPACE[[0x20, *range(0x09, 0x0E)]] = 1


def _classes() -> np.ndarray:
    """0 white space, 1 letters, digits and all bytes beyond ASCII, 2 other signs."""
    kind = np.full(256, 2, np.uint8)
    kind[0x80:] = 1
    for lo, hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
        kind[lo : hi + 1] = 1
    kind[_SPACE == 1] = 0
    return kind


_KIND = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the texts' UTF-8 bytes, null as empty, one white space byte after each text."""
    values = [b"" if t is None else t.encode() for t in texts.to_pylist()]
    sizes = np.fromiter((len(v) + 1 for v in values), np.int64, len(values))
    return np.frombuffer(b"\n".join([*values, b""]), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


@functools.lru_cache(maxsize=1)
def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, MULTIPLIER, np.uint64), np.full(n, INVERSE, np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; a worker keeps a table of 2^19 of them, longer ones are made anew."""
    up, down = _table(1 << 19) if n <= 1 << 19 else _table.__wrapped__(n)
    return up[:n], down[:n]


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], whatever their length: prefix sums of a polynomial with an odd base."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all white-space-delimited words, first word of each text): text i has words first[i]:first[i + 1]."""
    data, offsets = joined(texts)
    data = _LOWER[data] if lower else data
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = 1 - _SPACE[data]
    steps = np.diff(inside)
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    return hashed(data, starts, ends), np.searchsorted(starts, offsets)


def runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Like words(), but letters and digits on one hand and other signs on the other make tokens of their own."""
    data, offsets = joined(texts)
    kind = np.zeros(len(data) + 2, np.int8)
    kind[1:-1] = _KIND[data]
    edges = np.flatnonzero(np.diff(kind))
    edges = np.append(edges, len(data)) if not len(edges) or edges[-1] != len(data) else edges
    starts, ends = edges[:-1], edges[1:]
    keep = kind[1:-1][starts] > 0
    return hashed(data, starts[keep], ends[keep]), np.searchsorted(starts[keep], offsets)
