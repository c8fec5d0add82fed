"""Embedding whitening: exact integer moments on Spark, eigenvectors refined from single to more than double precision.

Entries become whole numbers, so sums and products of a batch are exact in float64 as long as they stay below 2^53, and
whole numbers can be added in any order: the covariance is the same to the last bit however the rows are dealt. What
reaches the driver are sums of d and of d x d numbers, d the dimension, whatever the number of rows.

The eigenvectors start as those of the covariance in single precision and are corrected by the iteration of Ogita and
Aishima, which is matrix multiplication alone, in extended precision. Where eigenvalues lie so close that the iteration
can't tell them apart, the cluster is solved by itself: the covariance, less the cluster's middle, projected on its
subspace, is a small matrix whose spread is not lost in the large values.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from tracefork.llm.tables import settle

SCALE = 256
COMPONENTS = 4
#: Rows whose arrays one task holds at a time, as entries.
ENTRIES = 1 << 21
#: Partial sums of one dimension are dealt to so many tasks before the last sum.
SPREAD = 16
#: Whole numbers up to this are exact in float64; products are summed in float64 up to it.
EXACT = 1 << 53
ROUNDS = 40
LIMIT = (1 << 63) - 1


def packed(row: np.ndarray) -> bytes:
    """A row of long numbers by the narrowest type that holds it, so that equal rows have equal bytes; the first byte
    tells the type."""
    least, most = (int(row.min()), int(row.max())) if len(row) else (0, 0)
    for width, kind in ((2, "<i2"), (4, "<i4")):
        if -(1 << (8 * width - 1)) <= least and most < 1 << (8 * width - 1):
            return bytes([width]) + row.astype(kind).tobytes()
    return b"\x08" + row.astype("<i8").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)


def whole(vectors: pa.Array) -> list[bytes | None]:
    """floor(256 * c) of each vector, packed; None for null or empty vectors and those with a null or non-finite entry.
    Numbers beyond a long become the nearest long."""
    ends = np.cumsum(np.asarray(vectors.value_lengths().fill_null(0))).tolist()
    value = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes nan
    good = np.isfinite(value)
    with np.errstate(all="ignore"):
        scaled = np.floor(np.where(good, value, 0.0) * SCALE)
    inside = (scaled >= -(2.0**63)) & (scaled < 2.0**63)
    longs = np.where(inside, scaled, 0.0).astype(np.int64)
    longs = np.where(inside, longs, np.where(scaled > 0, LIMIT, -LIMIT - 1))
    starts = [0, *ends]
    return [packed(longs[s:e]) if e > s and good[s:e].all() else None for s, e in zip(starts, ends)]


def integer_rows(embeddings: DataFrame) -> DataFrame:
    """(``vec_id``, ``x``, ``d``): the rows with whole numbers, packed, and how many these are."""
    rows = embeddings.select("vec_id", "embedding").where("embedding is not null")
    schema = StructType([rows.schema["vec_id"], StructField("x", BinaryType()), StructField("d", IntegerType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array(whole(batch.column(1)), pa.binary())
            columns = [batch.column(0), x, batch.column(1).value_lengths()]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(x.is_valid())

    return rows.mapInArrow(scan, schema)


def matrices(column: pa.Array, d: int) -> Iterator[np.ndarray]:
    """The packed rows as matrices of bounded size."""
    step = max(1, ENTRIES // d)
    for at in range(0, len(column), step):
        yield np.stack([unpacked(x) for x in column.slice(at, step).to_pylist()])


SUMS = StructType([StructField("i", IntegerType()), StructField("spread", IntegerType()), StructField("sums", BinaryType())])


def as_wide(numbers: np.ndarray) -> bytes:
    """Whole numbers of any size, each as 32 bytes."""
    return b"".join(int(v).to_bytes(32, "little", signed=True) for v in numbers.ravel().tolist())


def from_wide(data: bytes) -> np.ndarray:
    return np.array([int.from_bytes(data[i : i + 32], "little", signed=True) for i in range(0, len(data), 32)], object)


def summed(partials: DataFrame) -> dict[int, np.ndarray]:
    """Sums by ``i`` of the partitions' arrays of whole numbers: first in ``SPREAD`` tasks each, then in one. Every sum
    has one entry per dimension; the driver gets one array for each ``i``."""

    def add(table: pa.Table) -> pa.Table:
        rows = table.column("sums").to_pylist()
        total = sum((from_wide(r) for r in rows[1:]), from_wide(rows[0]))
        return pa.table({"i": [table.column("i")[0]], "spread": pa.array([0], pa.int32()), "sums": pa.array([as_wide(total)], pa.binary())}).cast(
            pa.schema([("i", pa.int32()), ("spread", pa.int32()), ("sums", pa.binary())])
        )

    some = partials.groupBy("i", "spread").applyInArrow(add, SUMS)
    return {r.i: from_wide(r.sums) for r in some.groupBy("i").applyInArrow(add, SUMS).collect()}


def partial_rows(sums: dict[int, np.ndarray], spread: int) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary())
    columns = (list(sums), [spread] * len(sums), [as_wide(v) for v in sums.values()])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=SUMS.names)


def task_spread() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() % SPREAD if context else 0


def row_sums(x: np.ndarray) -> np.ndarray:
    """Sums of each column, exact: high and low halves apart."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return high.sum(axis=0).astype(object) * (1 << 32) + low.sum(axis=0).astype(object)


def products(y: np.ndarray) -> np.ndarray:
    """y' y, exact: by float64 matrix products as long as their sums stay exact, in Python numbers otherwise."""
    most = max(int(y.max()), -int(y.min()), 1)
    step = EXACT // (most * most)
    if not step:
        wide = y.astype(object)
        return wide.T @ wide
    total: np.ndarray | int = 0
    for at in range(0, len(y), step):
        part = y[at : at + step].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


class Moments(NamedTuple):
    n: int
    sums: list[int]  # by dimension
    covariance: np.ndarray  # of whole numbers, times n^2


def moments(fit: DataFrame, d: int) -> Moments:
    """Exact sums and covariance over the rows of the fit list (``x``)."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d + 1, object)
        for batch in batches:
            for x in matrices(batch.column(0), d):
                total += np.append(row_sums(x), len(x))
        if total[d]:
            yield partial_rows({0: total}, task_spread())

    sums = summed(fit.mapInArrow(first, SUMS))[0]
    n, total = int(sums[d]), [int(v) for v in sums[:d]]
    centre = np.array([(2 * s + n) // (2 * n) for s in total], object)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square: np.ndarray | int = 0
        for batch in batches:
            for x in matrices(batch.column(0), d):
                square = square + products(centred(x, centre))
        if not isinstance(square, int):
            yield partial_rows(dict(enumerate(square)), task_spread())

    squares = summed(fit.mapInArrow(second, SUMS))
    rest = np.array([s - n * int(c) for s, c in zip(total, centre)], object)  # sums of what is left after centring
    return Moments(n, total, np.stack([squares[i] for i in range(d)]) * n - np.outer(rest, rest))


def centred(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """x less the centre, as longs where these can hold it."""
    safe = all(-(1 << 61) < int(c) < 1 << 61 for c in centre) and (not x.size or (x.max() < 1 << 61 and x.min() > -(1 << 61)))
    return x - centre.astype(np.int64) if safe else x.astype(object) - centre


def extended(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers of any size as extended floats."""
    high = np.array([float(v) for v in numbers.ravel().tolist()], np.float64)
    low = np.array([float(v - int(h)) for v, h in zip(numbers.ravel().tolist(), high.tolist())], np.float64)
    return (high.astype(np.longdouble) + low.astype(np.longdouble)).reshape(numbers.shape)


def clusters(values: np.ndarray, apart: float) -> Iterator[slice]:
    """Runs of falling values of which neighbours are not further apart than ``apart``."""
    cuts = np.flatnonzero(values[:-1] - values[1:] > apart) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)]):
        yield slice(start, end)


def eigen(a: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as columns) of a symmetric matrix, in extended precision.

    Each round corrects all vectors by x + x e, where e is got from r = 1 - x'x and s = x'ax (Ogita and Aishima 2018).
    For pairs whose values are closer than the present error, or than the root of the precision, e only makes them
    orthogonal, and each cluster of such values is turned by the eigenvectors of its own projected matrix. It ends when
    a correction is below the precision or, near it, no longer falls.
    """
    a = np.asarray(a, np.longdouble)
    scale = np.abs(a).max() if a.size else np.longdouble(0)
    if not scale:
        return np.zeros(len(a), np.longdouble), np.eye(len(a), dtype=np.longdouble)
    a = a / scale
    _, start = np.linalg.eigh(a.astype(np.float32))
    x = start[:, ::-1].astype(np.longdouble)
    one, small = np.eye(len(a), dtype=np.longdouble), np.finfo(np.longdouble).eps * len(a)
    norm = np.abs(a).sum(axis=1).max()
    before = np.inf
    for _ in range(rounds):
        values, x, size, apart = corrected(a, x, one, norm)
        for c in clusters(values, apart):
            if c.stop - c.start > 1:
                x[:, c] = sub_solved(a, x[:, c], values[c].mean())
        if size < 4 * small or before <= size < np.sqrt(small):
            break
        before = size
    values, x, _, _ = corrected(a, x, one, norm)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(a))])
    return values[order] * scale, x * np.where(sign == 0, 1, sign)


def corrected(a: np.ndarray, x: np.ndarray, one: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One round: (values, new vectors, size of the correction, how close values count as one)."""
    r, s = one - x.T @ x, x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2  # else rounding, divided by small gaps, would cost orthogonality
    values = np.diag(s) / (1 - np.diag(r))
    apart = 2 * (np.linalg.norm((s - np.diag(values)).astype(np.float64)) + norm * np.linalg.norm(r.astype(np.float64)))
    apart = max(apart, np.sqrt(np.finfo(np.longdouble).eps) * norm)  # over smaller gaps rounding would decide
    order = np.argsort(-values, kind="stable")
    values, x, r, s = values[order], x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)]
    gap = values[None, :] - values[:, None]
    near = np.abs(gap) <= apart
    e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
    return values, x + x @ e, float(np.abs(e).max()), float(apart)


def sub_solved(a: np.ndarray, q: np.ndarray, middle: np.longdouble) -> np.ndarray:
    """The vectors of one cluster, turned inside their space to the eigenvectors of the shifted, projected matrix."""
    for _ in range(3):  # orthonormal to full precision, by the same multiplications
        q = q + q @ (np.eye(q.shape[1], dtype=np.longdouble) - q.T @ q) / 2
    t = q.T @ (a @ q - middle * q)
    spread = np.abs(t).max()
    if not spread:
        return q
    _, turn = np.linalg.eigh(((t + t.T) / (2 * spread)).astype(np.float64))
    return q @ turn[:, ::-1].astype(np.longdouble)


class Whitening(NamedTuple):
    """What ``whiten`` applies to a row; all of it is as large as the dimension."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of the components
    axes: np.ndarray  # unit eigenvectors, in columns
    explained: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of the rows of ``x``; nan where the eigenvalue is 0."""
        centre = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        rest = np.array([(s - self.n * c) / self.n for s, c in zip(self.sums, centre)])
        y = centred(x, np.array(centre, object)).astype(np.float64) - rest
        positive = self.values > self.trace * 1e-15
        return y @ (self.axes / np.sqrt(np.where(positive, self.values, np.nan)))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over the dimensions of (n x - S)^2, exact; None beyond a long."""
        sums = np.array(self.sums, object)
        top = max(abs(int(x.max())), abs(int(x.min()))) * self.n + max(abs(s) for s in self.sums)
        if top * top * x.shape[1] <= LIMIT:
            return ((x * self.n - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((x.astype(object) * self.n - sums) ** 2).sum(axis=1)
        return [int(v) if v <= LIMIT else None for v in exact]


def fitted(found: Moments, components: int) -> Whitening:
    values, axes = eigen(extended(found.covariance))
    k = min(components, len(values))
    square = np.longdouble(found.n) * np.longdouble(found.n)
    trace = extended(np.array([sum(int(found.covariance[i, i]) for i in range(len(values)))], object))[0]
    explained = values[:k] / trace if trace else np.full(k, np.nan)
    return Whitening(
        found.n, found.sums, (values[:k] / square).astype(np.float64), axes[:, :k].astype(np.float64),
        explained.astype(np.float64), float(trace / square),
    )


CHECK = StructType([StructField("i", IntegerType()), StructField("j", IntegerType()), StructField("v", DoubleType())])


def identity_error(fit: DataFrame, model: Whitening, d: int) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance less the identity, measured over the list; None
    where no component has a positive eigenvalue."""
    kept = np.flatnonzero(model.values > model.trace * 1e-15)
    if not len(kept):
        return None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(kept) + 1, len(kept)))
        for batch in batches:
            for x in matrices(batch.column(0), d):
                w = model.project(x)[:, kept]
                total += np.concatenate((w.T @ w, w.sum(axis=0)[None]))
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=CHECK.names
        )

    sums = np.zeros((len(kept) + 1, len(kept)))
    for r in fit.mapInArrow(scan, CHECK).groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        sums[r.i, r.j] = r.v / model.n
    return float(np.abs(sums[:-1] - np.outer(sums[-1], sums[-1]) - np.eye(len(kept))).max())


OUT = [("component", IntegerType()), ("n", LongType()), ("deviation", LongType()), ("whitened", DoubleType()), ("explained", DoubleType()), ("identity_error", DoubleType())]


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(``vec_id, component, n, deviation, whitened, explained, identity_error``) of each usable row and component.

    Rows whose vector is null or empty or has a null or non-finite entry go, and so do those that have not the
    commonest number of entries (of equally common ones the larger). Each distinct vector counts once in the fit;
    repeated rows and rows without ``vec_id`` keep their rows in the result. Vectors of fewer entries have as many
    components as entries. A component without spread has a null ``whitened``; if no vector differs, ``explained`` and
    ``identity_error`` are null too. ``deviation`` is null where it is beyond a long. An empty table gives no rows.
    Other columns are not read.
    """
    kind = embeddings.schema["vec_id"].dataType
    schema = StructType([StructField("vec_id", kind), *(StructField(n, k) for n, k in OUT)])
    rows = settle(lambda: integer_rows(embeddings))
    fit = settle(lambda: rows.select("x", "d").distinct())
    common = fit.groupBy("d").count().orderBy(F.col("count").desc(), F.col("d").desc()).head()
    if common is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    d = common.d
    fit = fit.where(F.col("d") == d).select("x")
    model = fitted(moments(fit, d), components)
    error = identity_error(fit, model, d)
    k = len(model.values)
    explained = [None if np.isnan(v) else v for v in model.explained.tolist()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in matrices(batch.column(1), d):
                m = len(x)
                ids = batch.column(0).slice(at, m).take(pa.array(np.repeat(np.arange(m), k)))
                at += m
                w = model.project(x).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                        pa.array(np.full(m * k, model.n), pa.int64()),
                        pa.array([v for v in model.deviations(x) for _ in range(k)], pa.int64()),
                        pa.array(w, mask=np.isnan(w)),
                        pa.array(explained * m, pa.float64()),
                        pa.array([error] * (m * k), pa.float64()),
                    ],
                    names=schema.names,
                )

    return rows.where(F.col("d") == d).select("vec_id", "x").mapInArrow(scan, schema)
