"""Whitening against whole-number arithmetic and numpy's eigenvectors in one process."""

import math

import numpy as np
import plain
import pytest

from tracefork.llm import whitening
from tracefork.llm.queries import op12_embedding_whitening
from tracefork.llm.tables import table

COLUMNS = "vec_id bigint, embedding array<double>"


def by_numpy(rows, components=4):
    """vec_id -> [(component, n, deviation, whitened, explained)] over the contract's fit list."""
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    whole = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in usable]
    fit = sorted({x for _, x in whole})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    off = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], object)
    cov = (off.T @ off).astype(np.float64) / float(n) ** 3
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    out = []
    for i, x in whole:
        d = [n * c - s for c, s in zip(x, sums)]
        w = (np.array([v / n for v in d]) @ axes) / np.sqrt(np.where(values > 1e-12 * values.sum(), values, np.nan))
        out.append((i, n, sum(v * v for v in d), w[:components], (values / values.sum())[:components]))
    return out


def compare(got, wanted, tolerance=1e-9):
    k = len(wanted[0][3])
    assert len(got) == k * len(wanted)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), []).append(r)
    sign = np.zeros(k)
    for i, n, deviation, w, explained in sorted(wanted, key=lambda x: -np.nan_to_num(np.abs(x[3])).max()):
        own = by[i, deviation]
        for r in own:
            c = r.component - 1
            assert r.n == n and abs(r.explained / explained[c] - 1) < 1e-9 and 0 <= r.identity_error < 1e-9
            if not sign[c]:
                sign[c] = np.sign(w[c] * r.whitened)
            assert abs(r.whitened * sign[c] - w[c]) < tolerance


def test_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, plain.SF, "embeddings").collect()]
    compare(op12_embedding_whitening(spark, plain.SF).collect(), by_numpy(rows))


@pytest.mark.parametrize("entries", [1 << 21, 12])
def test_rows_that_go_and_rows_that_repeat(spark, monkeypatch, entries):
    monkeypatch.setattr(whitening, "ENTRIES", entries)
    rng = np.random.default_rng(2)
    base = (rng.normal(size=(60, 5)) * [5, 3, 2, 1, 0.3]).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(i, base[0]) for i in range(100, 150)] + [(7, base[7]), (None, base[8])]
    odd = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [float("nan")] * 5), (204, [1.0, 2.0, 3.0, 4.0, float("inf")])]
    docs = spark.createDataFrame([(i, v, "x", 3) for i, v in rows + odd], COLUMNS + ", label string, x int")
    compare(whitening.whiten(docs).collect(), by_numpy(rows))


def test_few_entries_no_spread_and_nothing(spark):
    frame = lambda rows: whitening.whiten(spark.createDataFrame(rows, COLUMNS)).collect()
    assert frame([]) == [] and frame([(1, None), (2, [float("nan")])]) == []
    same = frame([(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(same, key=lambda r: (r.vec_id, r.component))] == [
        (i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)
    ]
    line = frame([(1, [1.0, 2.0]), (2, [3.0, 6.0]), (3, [2.0, 4.0]), (4, [1.0, 2.0, 3.0])])  # the last has another length
    assert {r.vec_id for r in line} == {1, 2, 3}
    assert all((r.whitened is None) == (r.component == 2) for r in line)
    assert all(abs(r.explained - (r.component == 1)) < 1e-12 and r.identity_error < 1e-12 for r in line)


def test_numbers_at_the_borders_of_a_long(spark):
    rows = [(1, [1e18, 0.0]), (2, [1e300, 1.0]), (3, [-1e300, 2.0]), (4, [0.1, -0.1])]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert len(got) == 8 and got[1, 1].deviation is None and got[1, 1].n == 4
    assert math.isfinite(got[2, 1].whitened) and got[4, 1].identity_error < 1e-6


def rotated(values, seed):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0].astype(np.longdouble)
    for _ in range(4):
        q = q + q @ (np.eye(len(values), dtype=np.longdouble) - q.T @ q) / 2
    return (q * np.array(values, np.longdouble)) @ q.T, q


@pytest.mark.parametrize(
    "values",
    [
        [9, 7, 4, 2, 1, 0.5, 1e-3, 0],
        [3, 3, 3, 1, 1, 1e-9, 0, 0],
        [1 + 3e-9, 1 + 2e-9, 1 + 1e-9, 1, 0.5, 0.5 - 1e-11, 1e-6, 1e-7],
        [1e6, 1e6 - 1e-5, 5, 5 - 1e-8, 5 - 2e-8, 1, 1, 1e-5],
        [0, 0, 0],
    ],
)
def test_refined_vectors_of_close_values(values):
    a, q = rotated(values, 4)
    a = (a + a.T) / 2
    got, x = whitening.eigen(a)
    top = max(abs(v) for v in values) or 1
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-17
    assert np.abs(a @ x - x * got).max() <= 1e-17 * top
    assert np.abs(got - np.sort(np.array(values, np.longdouble))[::-1]).max() <= 1e-17 * top
    for i, v in enumerate(values):
        gap = min((abs(v - w) for j, w in enumerate(values) if j != i), default=1)
        if gap > 1e-12 * top:  # the vector is determined
            assert abs(abs(x[:, i] @ q[:, i]) - 1) < 1e-12 + (1e-17 * top / gap) ** 2


def test_larger_matrices():
    rng = np.random.default_rng(6)
    m = rng.normal(size=(120, 96))
    a = (m.T @ m / 120).astype(np.longdouble)
    a = (a + a.T) / 2
    values, x = whitening.eigen(a)
    assert np.abs(a @ x - x * values).max() < 1e-16 and np.abs(x.T @ x - np.eye(96)).max() < 1e-17
    assert np.allclose(values.astype(float), np.linalg.eigvalsh(a.astype(float))[::-1], rtol=1e-9)
