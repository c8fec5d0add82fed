"""Fill-in-middle against a version that slices Python strings."""

import hashlib
import random

import plain
import pytest

from tracefork.llm import fill_in_middle as fim

COLUMNS = "doc_id bigint, text string"


def by_slicing(doc_id, text):
    """(code points, form, prefix, middle, output) from the contract's words."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", p, q - p, "<S>" + text[q:] + "<P>" + text[:p] + "<M>" + text[p:q]
    return n, "psm", p, q - p, "<P>" + text[:p] + "<S>" + text[q:] + "<M>" + text[p:q]


def rows_of(df):
    return [(r.doc_id, r.text, (r.fim_chars, r.fim_form, r.fim_prefix, r.fim_middle, r.fim_text), r.fim_restored) for r in df.collect()]


@pytest.mark.parametrize("size", [16_000_000, 40])
def test_texts_of_mixed_widths(spark, monkeypatch, size):
    monkeypatch.setattr(fim, "SLICE", size)
    rng = random.Random(1)
    letters = "ab<>PSM é́ß語‍😀\U0010ffff\u0000\n"
    docs = [(i, "".join(rng.choices(letters, k=rng.randrange(0, 40)))) for i in range(400)]
    docs += [(900, "é" * 50), (901, "😀"), (902, "x" * 70), (903, "<P" + "é" * 9 + ">"), (904, "a<S>b"), (905, "<<S<<M<<P" * 9)]
    got = rows_of(fim.restore(fim.fill_in_middle(spark.createDataFrame(docs, COLUMNS))))
    assert len(got) == len(docs)
    for doc_id, text, made, back in got:
        assert made == by_slicing(doc_id, text)
        assert back == text
    assert {made[1] for _, _, made, _ in got} == {"plain", "psm", "spm"}


def test_odd_documents_in_the_middle(spark):
    docs = plain.odd(spark).withColumnRenamed("size", "fim_form")
    out = fim.fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "fim_form", "_ID", "fim_chars", "fim_form_", "fim_prefix", "fim_middle", "fim_text"]
    got = sorted(([r.doc_id, r.text, (r.fim_chars, r.fim_form_, r.fim_prefix, r.fim_middle, r.fim_text)] for r in out.collect()), key=repr)
    assert got == sorted(([i, t, by_slicing(i, t)] for i, t, _, _ in plain.ODD), key=repr)
    assert fim.fim_digest(spark.createDataFrame([], COLUMNS)).collect() == []


def test_one_very_long_text(spark):
    text = "".join(random.Random(3).choices(["word ", "é", "語😀"], k=3_000_000))
    row = fim.restore(fim.fill_in_middle(spark.createDataFrame([(5, text)], COLUMNS))).head()
    assert (row.fim_chars, row.fim_form, row.fim_prefix, row.fim_middle, row.fim_text) == by_slicing(5, text)
    assert row.fim_restored == text


def test_digests_of_the_whole_table(spark):
    from tracefork.llm.queries import op13_fill_in_middle
    from tracefork.llm.tables import table

    texts = {r.doc_id: r.text for r in table(spark, plain.SF, "documents").collect()}
    rows = op13_fill_in_middle(spark, plain.SF).collect()
    assert len(rows) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        n, form, prefix, middle, output = by_slicing(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert (r.output_sha256, r.restored_sha256) == (sha(output), sha(texts[r.doc_id] or ""))
