"""Vectorised hashes of byte strings inside a buffer."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import as_strided

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S1, S2 = np.uint64(30), np.uint64(27)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> S1)) * M1
    x = (x ^ (x >> S2)) * M2
    return x ^ (x >> np.uint64(31))


#: Fixed values of xxHash64: its five primes.
P1, P2, P3, P4, P5 = (
    np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def id_hashes(ids: np.ndarray) -> np.ndarray:
    """What ``xxhash64`` of Spark gives for a bigint column."""

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    with np.errstate(over="ignore"):
        h = turned(np.asarray(ids, np.int64).view(np.uint64) * P2, 31) * P1 ^ (P5 + np.uint64(42 + 8))
        h = turned(h, 27) * P1 + P4
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one array with 8 spare bytes behind them, and the borders between them."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return np.frombuffer(b"".join([*texts, bytes(8)]), np.uint8), np.concatenate(([0], ends))


def string_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the strings of ``length`` >= 8 bytes at the given places of a ``buffer``."""
    words = as_strided(data[:8].view("<u8"), (len(data) - 7,), (1,))
    acc = np.full(len(starts), length, np.uint64)
    for at in [*range(0, length - 8, 8), length - 8]:
        acc = (acc ^ words[starts + at]) * M1
        acc ^= acc >> S1
    return mixed(acc)


def slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest value of every window of ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


_TABLE = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_A, _B, _C, _D, _E = (np.uint32(v) for v in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1))


def gram20(data: np.ndarray) -> np.ndarray:
    """32-bit hashes of all runs of 20 bytes, by doubling."""
    h = _TABLE[data]
    h = h[:-1] * _A + h[1:]
    four = h[:-2] * _B + h[2:]
    four ^= four >> np.uint32(15)
    h = four[:-4] * _C + four[4:]
    h = h[:-8] * _D + h[8:]
    h = h[:-4] * _E + four[16:]
    h ^= h >> np.uint32(16)
    return h * _A
