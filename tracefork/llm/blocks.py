"""Numpy arrays as binary columns, so that many small values travel in one row under a bucket number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def pack_ids(ids: np.ndarray) -> bytes:
    """64-bit whole numbers as differences; neighbours that are alike compress well."""
    return np.diff(ids, prepend=np.int64(0)).tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.int64))


def pack_small(values: np.ndarray) -> bytes:
    """Whole numbers from 0, each in as few bytes as the largest takes; the first byte says in how many."""
    largest = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if largest < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpack_small(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.uint64)


def pack_sorted(ids: np.ndarray) -> bytes:
    """Ascending 64-bit whole numbers: the first one and the steps between them."""
    return ids[:1].tobytes() + pack_small(np.diff(ids.view(np.uint64))) if len(ids) else b""


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.array([], np.int64)
    return np.cumsum(np.concatenate((np.frombuffer(data[:8], np.uint64), unpack_small(data[8:])))).view(np.int64)


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal neighbours, and for each value the number of its run."""
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    return np.flatnonzero(fresh), np.cumsum(fresh) - 1


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its values in their order)."""
    order = np.argsort(bucket, kind="stable")
    starts, _ = runs_of(bucket[order])
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
        own = order[start:end]
        yield int(bucket[own[0]]), own


def column(table: pa.Table | pa.RecordBatch, name: str, dtype: str) -> list[np.ndarray]:
    """The arrays of a binary column, one for each row."""
    return [np.frombuffer(x, dtype) for x in table.column(name).to_pylist()]


def joined(arrays: list[np.ndarray], dtype: str) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.array([], dtype)
