"""Near duplicates by registers against quadratic comparison, and the registers' own laws."""

import random

import numpy as np
import plain
import pytest

from tracefork.llm import minhash
from tracefork.llm.queries import op11_minhash_dedup
from tracefork.llm.tables import table

COLUMNS = "doc_id bigint, text string"


def found(spark, rows):
    got = minhash.near_duplicates(spark.createDataFrame(rows, COLUMNS)).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got}


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"x{rng.randrange(10**9)}"
    return " ".join(words)


def test_components_of_the_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, plain.SF, "documents").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op11_minhash_dedup(spark, plain.SF).collect()}
    assert got == plain.components(docs, 85)


@pytest.mark.parametrize("sizes", [(1, 4_000_000, 500), (0, 900, 3)])
def test_components_of_edited_copies(spark, monkeypatch, sizes):
    """Copies around the threshold, with hub rounds and without, in whole and in small blocks."""
    rounds, size, block = sizes
    monkeypatch.setattr(minhash, "ROUNDS", max(rounds, 1))
    monkeypatch.setattr(minhash, "SLICE", size)
    monkeypatch.setattr(minhash, "BLOCK_SETS", block)
    monkeypatch.setattr(minhash, "HUB_SETS", block)
    if not rounds:
        monkeypatch.setattr(minhash, "hub_links", lambda tries, sets: tries.select("a", "b").limit(0))
        monkeypatch.setattr(minhash, "with_hubs", lambda shared: shared.selectExpr("*", "-1L hub", "n hub_n"))
    rng = random.Random(8)
    rows = []
    for n in (3, 5, 8, 40, 90, 200, 700):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        for _ in range(9):
            rows.append((len(rows) * 7 + 1, edited(rng, base, rng.randrange(0, n // 40 + 1))))
    rows += [(1000 + i, f"alone {i} " * 30) for i in range(20)]
    assert found(spark, rows) == plain.components(rows, 85)


def test_a_star_around_a_text_that_is_not_the_smallest(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, edited(rng, base, 4)) for i in range(40)] + [(40, " ".join(base))] + [(41 + i, edited(rng, base, 9)) for i in range(20)]
    assert found(spark, rows) == plain.components(rows, 85)


def test_odd_documents_by_registers(spark):
    got = minhash.near_duplicates(plain.odd(spark)).collect()
    assert len(got) == len(plain.ODD)
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None}
    assert by[1] == (0, 1, True) and by[2] == (0, 2, True) and by[3] == (0, 3, True)
    assert by[4] == (1, 4, True) and by[9] == (1, 4, False)
    assert by[5][1:] == (5, True) and by[6][1:] == (5, False)
    assert {(r.component_id, r.kept) for r in got if r.doc_id is None and r.n_shingles} == {(5, False)}
    assert minhash.near_duplicates(spark.createDataFrame([], COLUMNS)).collect() == []


def random_sets(rng, n, similarity):
    both = round(2 * n * similarity / (1 + similarity))
    x = rng.integers(1, 2**64, 2 * n - both, dtype=np.uint64)
    return np.sort(x[:n]), np.sort(x[n - both :])


def test_registers_are_mergeable_and_do_not_depend_on_the_limit():
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.integers(1, 2**64, n, dtype=np.uint64)) for n in (0, 1, 2, 7, 100, 3000)]
    registers = minhash.sketches(sets)
    assert (registers == minhash.sketches(sets, above=12.0)).all() and not registers[0].any()
    union = minhash.sketches([np.sort(np.concatenate(sets))])[0]
    assert (minhash.merged(registers) == union).all()
    assert abs(minhash.cardinality(registers)[5] / 3000 - 1) < 0.4


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.85, 0.95])
def test_likelihood_and_bands(similarity):
    rng = np.random.default_rng(4)
    pairs = [minhash.sketches(list(random_sets(rng, 400, similarity))) for _ in range(300)]
    more, less = (np.array([(a > b).sum() for a, b in pairs]), np.array([(a < b).sum() for a, b in pairs]))
    n = np.full(300, 400)
    guess = minhash.likely(more, less, n, n)
    assert abs(guess.mean() - similarity) < 0.01 and guess.std() < 1.3 * (similarity * (1 - similarity) / minhash.REGISTERS) ** 0.5
    met = np.mean([len(np.intersect1d(*minhash.band_keys(p))) > 0 for p in pairs])
    assert met == 1 if similarity >= 0.8 else met > 0.4
    if similarity >= 0.85:
        assert (guess > 0.85 - minhash.MARGIN).all()


def test_exact_comparison_at_the_border():
    one = np.arange(1, 18, dtype=np.uint64)
    assert minhash.similar(one, np.arange(1, 21, dtype=np.uint64))  # 17 of 20
    assert not minhash.similar(one[:-1], np.arange(1, 20, dtype=np.uint64))  # 16 of 19
    assert not minhash.similar(one[:0], one[:0])
