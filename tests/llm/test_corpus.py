"""Decontamination, packing and the pipeline against plain versions."""

import random
import zlib

import corpus_pipeline
import numpy as np
import plain
import pytest
from tokenizers import Tokenizer

from tracefork.llm import decontamination, packing, quality
from tracefork.llm.queries import op9_decontamination, op10_packing
from tracefork.llm.tables import table

DOCS = "doc_id bigint, text string"
ITEMS = "item_id bigint, text string"


def digests(df):
    rows = df.collect()
    assert all(r.contaminated == (r.n_hit > 0) for r in rows)
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in rows}


def test_leaks_of_the_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, plain.SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, plain.SF, "benchmark").collect()]
    assert digests(op9_decontamination(spark, plain.SF)) == plain.leaks(docs, items)


@pytest.mark.parametrize("shard_bytes", [10**6, 60])
def test_leaks_of_small_vocabularies(spark, shard_bytes):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choices(["a", "B", "c!", "é"], k=n))
    items = [(i, text(rng.choice([1, 2, 4, 9, 10, 11, 14]) if i > 3 else 12)) for i in range(9)] + [(50, None), (51, " ! ")]
    items = [x for x in items if len((x[1] or "").split()) not in (1, 2)]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(50)] + [(99, None)]
    marked = decontamination.mark_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), shard_bytes=shard_bytes)
    assert digests(decontamination.leak_digest(marked)) == plain.leaks(docs, items)


def test_cut_passages(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [(1, "Before it, " + passage + " and after."), (2, passage), (3, "nothing here"), (4, None)]
    out = decontamination.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, passage)], ITEMS), max_coverage=0.9)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "Before it,  and after.", 3: "nothing here", 4: None}
    empty = spark.createDataFrame([], ITEMS)
    assert decontamination.decontaminate(plain.odd(spark), empty).columns == plain.odd(spark).columns
    assert digests(decontamination.leak_digest(decontamination.mark_leaks(spark.createDataFrame(docs, DOCS), empty)))[2][1] == 0
    assert decontamination.mark_leaks(spark.createDataFrame([], DOCS), empty).collect() == []


def check_packing(rows, docs, capacity=packing.CAPACITY):
    """Each document's ids, whole and in order, in sequences without gaps."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.vocabulary_path())
    library.encode_special_tokens = True
    wanted = []
    for doc, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)] if len(ids) > capacity else [0, len(ids)]
        wanted += [(doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    held: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), -(-sum(r.length for r in rows) // capacity)


def test_sequences_of_the_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, plain.SF, "documents").collect()]
    used, least = check_packing(op10_packing(spark, plain.SF).collect(), docs)
    assert used <= least + 2


def test_odd_documents_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "NUMBERED", 3)
    rows = packing.pack(plain.odd(spark)).collect()
    check_packing(rows, [(d[0], d[1]) for d in plain.ODD])
    assert packing.pack(spark.createDataFrame([], DOCS)).collect() == []
    texts = ["a  b", "  a", "it's <|endoftext|>", "\n\n a\t", "é" * 50, "日本語 テキスト"]
    check_packing(packing.pack(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect(), list(enumerate(texts)))


def test_long_runs_of_white_space_pack(spark, monkeypatch):
    texts = [" " * 1_100_000, "a" + "\n" * 1_100_000 + "b", "a\t" + " " * 1_100_000 + "\n it's \u2003\x1c"]
    check_packing(packing.pack(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect(), list(enumerate(texts)))
    monkeypatch.setattr(packing, "LONG_RUN", 3)
    library, encoder = Tokenizer.from_file(packing.vocabulary_path()), packing.Encoder(packing.vocabulary_path())
    rng = random.Random(12)
    for _ in range(3000):
        text = "".join(rng.choices([" ", " ", "\n", "\t", "\r", "\x1c", "\x85", "\u3000", "a", "it's", "7", "!", "é", "日"], k=rng.randrange(25)))
        assert encoder.ids(text).tolist() == [*library.encode(text, add_special_tokens=False).ids, packing.END_ID], repr(text)


def test_added_tokens_inside_texts(spark, tmp_path, monkeypatch):
    library = Tokenizer.from_file(packing.vocabulary_path())
    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b<|endoftext", " \n<|endoftext|>\n x"]
    texts.append(" " * 120_000 + "<|endoftext|>" + " " * 120_000 + "b")
    wanted = {}
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, packing.END_ID], "<u4")
        cut = len(ids) % packing.CAPACITY or packing.CAPACITY
        ends = [cut, *range(cut + packing.CAPACITY, len(ids) + 1, packing.CAPACITY)]
        wanted |= {(i, k): zlib.crc32(ids[max(0, e - packing.CAPACITY) if k else 0 : e].tobytes()) for k, e in enumerate(ends)}
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for out in op10_packing(spark, str(tmp_path)), corpus_pipeline.best_fit_packing(spark, docs, str(tmp_path)):
        assert {(r.doc_id, r.piece): r.ids_crc32 for r in out.collect()} == wanted
    monkeypatch.setattr(packing, "LONG_RUN", 3)
    encoder, rng = packing.Encoder(packing.vocabulary_path(), added=True), random.Random(13)
    for _ in range(3000):
        text = "".join(rng.choices([" ", " ", "\n", "<|endoftext|>", "<|endoftext|", "\u3000", "a", "it's", "7", "!"], k=rng.randrange(25)))
        assert encoder.ids(text).tolist() == [*library.encode(text, add_special_tokens=False).ids, packing.END_ID], repr(text)


def best_fit_decreasing(counts, capacity):
    gaps = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= length]
        if fits:
            gaps[min(fits, key=gaps.__getitem__)] -= length
        else:
            gaps.append(capacity - length)
    return len(gaps)


def test_rounds_are_as_good_as_one_at_a_time():
    rng = random.Random(9)
    for _ in range(30):
        counts = {rng.randrange(1, 101): rng.randrange(1, 12) for _ in range(rng.randrange(1, 25))}
        matches = packing.sweep_rounds(counts, 100)
        used = len({s + i for _, _, n, s, _ in matches for i in range(n)})
        assert used <= best_fit_decreasing(counts, 100) * 1.12 + 1
        placed = {}
        for length, first, n, _, _ in matches:
            placed.setdefault(length, set()).update(range(first, first + n))
        assert {x: len(p) for x, p in placed.items()} == counts


def test_pipeline_stage_by_stage(spark):
    docs = table(spark, plain.SF, "documents")
    plain_docs = {r.doc_id: r.text for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]
    good = steps["quality rules"](spark, docs, plain.SF)
    kept = {r.doc_id for r in quality.judge_quality(docs).collect() if r.quality.kept}
    assert {r.doc_id for r in good.collect()} == kept
    one = steps["n-gram Jaccard join"](spark, good, plain.SF)
    left = {i for i, (_, c) in plain.components([(i, plain_docs[i]) for i in kept]).items() if c == i}
    assert {r.doc_id: r.text for r in one.collect()} == {i: plain_docs[i] for i in left}
    cut = steps["suffix-array dedup"](spark, one, plain.SF)
    wanted = {i: v[4].decode(errors="ignore") for i, v in plain.repeats([(i, plain_docs[i]) for i in left]).items()}
    wanted = {i: t for i, t in wanted.items() if t.strip() or t == plain_docs[i]}
    assert {r.doc_id: r.text for r in cut.collect()} == wanted
    clean = steps["benchmark decontamination"](spark, cut, plain.SF)
    items = [(r.item_id, r.text) for r in table(spark, plain.SF, "benchmark").collect()]
    before = plain.leaks(list(wanted.items()), items)
    rows = clean.collect()
    assert {r.doc_id for r in rows} == {i for i, v in before.items() if v[1] <= 0.5 * v[0]}
    for r in rows:
        assert before[r.doc_id][1] or r.text == wanted[r.doc_id]
        assert r.n_chars == len(r.text)
    for stage in (good, one, cut, clean):
        assert stage.columns == docs.columns
    check_packing(steps["best-fit packing"](spark, clean, plain.SF).collect(), [(r.doc_id, r.text) for r in rows])
