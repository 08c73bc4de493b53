"""Integers in few bytes: what tasks send each other of hashes and counts."""

from __future__ import annotations

import struct

import numpy as np


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers by byte planes: high bytes of small values are runs of zeros, which the shuffle compresses."""
    x = x.astype("<u8")
    top = int(x.max()) if len(x) else 0
    planes = max(1, (top.bit_length() + 7) // 8)
    return bytes([planes]) + x.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    planes = raw[0]
    n = (len(raw) - 1) // planes
    out = np.zeros((n, 8), np.uint8)
    out[:, :planes] = np.frombuffer(raw, np.uint8, offset=1).reshape(planes, n).T
    return out.reshape(-1).view("<u8")


_HEAD = struct.Struct("<QIBB")  # first key, number of keys, low bits of a difference, bits that are zero in all keys


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted hashes by their differences in Rice's code: the low bits as they are, the rest in unary. Near the least possible size."""
    if not len(x):
        return b""
    zeros = 0 if int(np.bitwise_or.reduce(x)) & 15 else 4
    y = x >> np.uint64(zeros)
    gaps = np.diff(y)
    low = max(int(gaps.mean()).bit_length() - 1, 0) if len(gaps) else 0
    ends = np.cumsum((gaps >> np.uint64(low)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    bits = np.unpackbits(gaps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - low :]
    return _HEAD.pack(int(y[0]), len(y), low, zeros) + np.packbits(bits).tobytes() + np.packbits(unary).tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, np.uint64)
    first, n, low, zeros = _HEAD.unpack_from(raw)
    size = -(-(n - 1) * low // 8)
    bits = np.zeros((n - 1, 64), np.uint8)
    bits[:, 64 - low :] = np.unpackbits(np.frombuffer(raw, np.uint8, size, _HEAD.size), count=(n - 1) * low).reshape(n - 1, low)
    gaps = np.packbits(bits, axis=1).view(">u8").reshape(-1).astype(np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, offset=_HEAD.size + size)))
    gaps += (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(low)
    return np.cumsum(np.concatenate((np.array([first], np.uint64), gaps)), dtype=np.uint64) << np.uint64(zeros)
