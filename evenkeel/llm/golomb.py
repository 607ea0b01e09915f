"""Golomb-Rice codes of sorted integers, vectorised.

A sorted set in a known range is stored as gaps. Each gap splits into a quotient, kept in
unary as the zeros before a one, and `k` low bits. For gaps of mean m this needs about
log2(m) + 1.5 bits, close to the entropy of a random set.
"""

from __future__ import annotations

import numpy as np

HEADER = np.dtype([("n", "<u4"), ("k", "<u1"), ("unary", "<u4")])


def encode(values: np.ndarray, low: int, high: int) -> bytes:
    """Sorted distinct uint64 `values` of [low, high) as bytes."""
    n = len(values)
    if n == 0:
        return np.zeros(1, HEADER).tobytes()
    k = max(0, int(np.log2(max(1.0, 0.69 * (high - low) / n))))
    gaps = np.diff(values, prepend=np.uint64(low)).astype(np.uint64)
    ends = np.cumsum((gaps >> np.uint64(k)) + np.uint64(1)) - np.uint64(1)
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends.astype(np.int64)] = 1
    packed = np.packbits(unary)
    head = np.array([(n, k, len(packed))], HEADER)
    return head.tobytes() + packed.tobytes() + _pack_low(gaps, k)


def decode(data: bytes, low: int) -> np.ndarray:
    """The values that `encode` was given."""
    head = np.frombuffer(data, HEADER, 1)[0]
    n, k, size = int(head["n"]), int(head["k"]), int(head["unary"])
    if n == 0:
        return np.empty(0, np.uint64)
    at = HEADER.itemsize
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, at)))[:n]
    quotients = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    gaps = (quotients << np.uint64(k)) | _unpack_low(data[at + size :], n, k)
    return np.cumsum(gaps) + np.uint64(low)


def _pack_low(gaps: np.ndarray, k: int) -> bytes:
    """The low `k` bits of every gap, one bit plane after the other."""
    return b"".join(np.packbits(((gaps >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)).tobytes() for b in range(k))


def _unpack_low(data: bytes, n: int, k: int) -> np.ndarray:
    out, width = np.zeros(n, np.uint64), -(-n // 8)
    for b in range(k):
        plane = np.unpackbits(np.frombuffer(data, np.uint8, width, b * width))[:n]
        out |= plane.astype(np.uint64) << np.uint64(b)
    return out
