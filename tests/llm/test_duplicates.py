"""The n-gram Jaccard join and the suffix dedup against plain versions."""

import random

import numpy as np
import plain
import pytest

from tracefork.llm import ngram_join, suffix_dedup
from tracefork.llm.queries import op1_ngram_join, op3_suffix_dedup
from tracefork.llm.tables import table


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in table(spark, plain.SF, "documents").select("doc_id", "text").collect()]


def copies(seed: int, groups: int = 12, each: int = 6) -> list[tuple[int, str]]:
    """Texts of many lengths with copies that have from none to many words changed."""
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 6, 9, 30, 70, 120, 400]))]
        for c in range(each):
            words = list(base)
            for _ in range(rng.randrange(0, max(1, len(words) // 30) + 1)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            out.append((len(out), " ".join(words)))
    return out


def joined(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs).collect()}


def test_components_of_the_whole_table(spark, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op1_ngram_join(spark, plain.SF).collect()}
    assert got == plain.components(documents)


@pytest.mark.parametrize("size", [4_000_000, 3_000])
def test_components_of_edited_copies(spark, monkeypatch, size):
    monkeypatch.setattr(ngram_join, "SLICE", size)
    monkeypatch.setattr(ngram_join, "BUCKET", size)
    rows = copies(3)
    assert joined(spark, rows) == plain.components(rows)


def test_every_allocation_finds_every_similar_pair():
    rng = np.random.default_rng(5)
    for n in (4, 5, 9, 20, 50, 83, 84, 100, 215, 300, 900):
        for _ in range(20):
            r = np.unique(rng.integers(1, 2**64, n, dtype=np.uint64))
            most = ngram_join.most_apart(len(r))
            lost = int(rng.integers(0, most + 1))
            s = np.unique(np.concatenate((r[rng.permutation(len(r))[lost:]], rng.integers(1, 2**64, most - lost, dtype=np.uint64))))
            small, large = sorted((r, s), key=len)
            band = ngram_join.band_of(len(small))
            own, thin = ngram_join.keys_of(small, band, frozenset())
            if len(np.intersect1d(r, s)) * 180 < 80 * (len(r) + len(s)):
                continue
            assert band in ngram_join.bands_of(len(large))
            assert thin or len(np.intersect1d(own, ngram_join.keys_of(large, band, frozenset())[0]))


def test_deletion_neighbourhoods_meet_at_one_difference(monkeypatch):
    monkeypatch.setattr(ngram_join, "allocation", lambda band: ("deletion", 2))
    rng = np.random.default_rng(1)
    r = np.unique(rng.integers(1, 2**64, 40, dtype=np.uint64))
    s = np.delete(r, [3, 37])  # at most one in each half
    a, b = (ngram_join.keys_of(x, 9, frozenset())[0] for x in (r, s))
    assert len(np.intersect1d(a, b)) >= 1


def test_odd_documents_join(spark):
    got = ngram_join.similar_documents(plain.odd(spark)).collect()
    assert len(got) == len(plain.ODD)
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3)
    assert by[9] == (1, 4) and by[4] == (1, 4)
    assert by[5][1] == 5 and by[6][1] == 5
    assert {r.component_id for r in got if r.doc_id is None and r.n_shingles} == {5}
    one = ngram_join.one_of_each(plain.odd(spark))
    assert one.columns == ["doc_id", "text", "size", "_ID"]
    assert sorted(str(r.doc_id) for r in one.collect()) == sorted(["1", "2", "3", "4", "5", "10", "None"])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert ngram_join.similar_documents(docs).collect() == []
    assert suffix_dedup.remove_repeats(docs).collect() == []
    assert ngram_join.one_of_each(docs).collect() == []


def test_removed_bytes_of_the_whole_table(spark, documents):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op3_suffix_dedup(spark, plain.SF).collect()}
    assert got == {i: v[:4] for i, v in plain.repeats(documents).items()}


@pytest.mark.parametrize("sizes", [(1 << 19, 4_000_000, 6_000_000), (64, 300, 500)])
def test_removed_bytes_of_small_alphabets(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK", "SLICE", "PART"), sizes):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(2)
    parts = ["".join(rng.choices("abé", k=rng.choice([10, 49, 50, 51, 90]))) for _ in range(12)]
    rows = [(i * 3, "".join(rng.choices(parts, k=rng.randrange(0, 7)))) for i in range(40)] + [(500, "a" * 400), (501, "a" * 60), (502, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    for i, (n, removed, spans, digest, kept) in plain.repeats(rows).items():
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (n, removed, spans, digest)
        assert (got[i].text or "") == kept.decode(errors="ignore")


@pytest.mark.parametrize("step", [1, 11, 13, 1 << 20])
def test_ids_in_even_steps_use_all_parts(spark, step):
    ids = spark.range(0, 5000 * step, step).selectExpr("id - 7 AS id")
    rows = ids.select("id", suffix_dedup.part_column("id", 11 * 13).alias("part")).collect()
    parts = suffix_dedup.part_of(np.array([r.id for r in rows]), 11 * 13)
    assert parts.tolist() == [r.part for r in rows]
    counts = np.bincount(parts, minlength=11 * 13)
    assert counts.min() > 10 and counts.max() < 70


def test_odd_documents_dedup(spark):
    out = suffix_dedup.remove_repeats(plain.odd(spark))
    assert out.columns == ["doc_id", "text", "size", "_ID", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = out.collect()
    assert len(rows) == len(plain.ODD)
    fives = [r for r in rows if r.doc_id == 5]
    assert [r.n_removed for r in fives] == [0, 0]  # rows of one id don't repeat each other
    last = next(r for r in rows if r.doc_id is None and r.n_bytes)
    assert last.n_removed >= len(plain.LONG)
    assert next(r for r in rows if r.doc_id == 1).text is None


@pytest.mark.parametrize("shared", [1_000_000, 0])
def test_components_across_blocks_of_a_cluster(spark, monkeypatch, shared):
    """One line that all texts have makes one cluster; sizes, blocks and shuffled joins change nothing."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 3)
    monkeypatch.setattr(ngram_join, "SHARED_ROWS", shared)
    line = " the same line of seven words here"
    rows = [(i, t + line) for i, t in copies(11, groups=8)]
    assert joined(spark, rows) == plain.components(rows)


def test_blocks_meet_sets_of_about_their_size_alone(spark, monkeypatch):
    """Bytes that a set sends to a block are a part of its shingles', and a large cluster of unlike sizes is few pairs."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    monkeypatch.setattr(ngram_join, "small_side", lambda df, most: df)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(1, 2**64, 20 * 2 ** (i % 6), dtype=np.uint64)) for i in range(48)]
    near = np.sort(np.concatenate((sets[5][:-3], rng.integers(1, 2**64, 3, dtype=np.uint64))))
    sets.append(near)
    tokens = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], ngram_join.SETS)
    members = spark.createDataFrame([(i, i, 0) for i in range(len(sets))], "id bigint, c bigint, cluster bigint")
    assert [tuple(sorted(r)) for r in ngram_join.block_links(members, tokens).collect()] == [(5, 48)]
    assert all(len(ngram_join.bitmap(s)) * 8 <= s.nbytes for s in sets)
    for n in range(1, 3000):
        most = n * ngram_join.DEN // ngram_join.NUM
        assert ngram_join.class_of(most) - ngram_join.class_of(n) in (0, 1)


def test_entries_take_a_few_bytes():
    """An entry of a key or a shingle: at most 11 bytes before compression (20 before)."""
    rng = np.random.default_rng(4)
    ids = np.repeat(np.arange(10**6, 10**6 + 500), 40)
    keys = rng.integers(0, 2**64, len(ids), dtype=np.uint64)
    rows = list(ngram_join.dealt(keys, ids, np.full(len(ids), 40), 9))
    assert sum(len(x) for _, *packed in rows for x in packed) <= 11 * len(ids)
    back = [ngram_join.shared_keys((ngram_join.pa.scalar(b),), ngram_join.table_of(ngram_join.KEYED, [(b, *x), (b, *x)])) for b, *x in rows]
    assert sum(t.num_rows for t in back) == 0
    other = [ngram_join.shared_keys((ngram_join.pa.scalar(r[0]),), ngram_join.table_of(ngram_join.KEYED, [r, s])) for r, s in
             zip(rows, ngram_join.dealt(keys, ids + 7, np.full(len(ids), 41), 9))]
    assert sorted(x for t in other for x in t["id"].to_pylist()) == sorted([*ids.tolist(), *(ids + 7).tolist()])
    assert {x for t in other for x in t["n"].to_pylist()} == {40, 41}


def test_packed_numbers_come_back():
    from tracefork.llm.blocks import pack_small, pack_sorted, unpack_small, unpack_sorted

    for ids in ([], [7], [-5, -5, 0, 3], [-(2**62), 2**62 + 9], [1, 2, 400, 70_000, 2**40]):
        assert unpack_sorted(pack_sorted(np.array(ids, np.int64))).tolist() == ids
    for values in ([], [0], [255, 3], [256], [70_000], [2**40]):
        assert unpack_small(pack_small(np.array(values, np.int64))).tolist() == values


def test_one_of_each_across_blocks_of_a_cluster(spark, monkeypatch):
    """The pipeline's stage keeps the smallest id of each component where a cluster has many blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 2)
    rows = [(i, t + " the same line of seven words here") for i, t in copies(17, groups=5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(r.doc_id for r in ngram_join.one_of_each(docs).collect())
    assert kept == sorted(i for i, (_, component) in plain.components(rows).items() if i == component)
