"""Words of UTF-8 texts, inside tasks: bytes in, numpy arrays out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A-Z lower-cased; every other ASCII character that is neither digit nor letter becomes a space.
ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def spaced_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased (bytes methods leave other letters alone)."""
    return text.lower().split()


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased."""
    return text.translate(ALNUM).split()


def texts(column: pa.Array) -> list[bytes]:
    """A string column as bytes; null is the empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` bytes in the given column; a longer row stands alone."""
    sizes = np.fromiter((len(t) for t in texts(batch.column(column))), np.int64, batch.num_rows)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if end > start:
            yield batch.slice(start, end - start)
