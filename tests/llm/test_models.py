"""HTML extraction and toxicity on pages and texts that the models have not seen; exact messages on small trees."""

import html
import itertools
import random
import re
import time

import numpy as np
import plain
from pyspark.sql import functions as F

from tracefork.llm import html_extraction as extraction
from tracefork.llm import toxicity
from tracefork.llm.html_tree import RAW, read
from tracefork.llm.queries import op2_html_extraction, op7_toxicity
from tracefork.llm.tables import table


def article_lines(page: str) -> str:
    """The article of the given pages by their markup alone."""
    start, end = page.index("<article>"), page.find("</article>")
    inner = page[start : end if end >= 0 else len(page)]
    inner = re.sub(r"<[^>]*(>|$)", lambda t: " " if t[0].startswith(("<b>", "<br", "</b")) else "\n", inner)
    lines = (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in inner.split("\n"))
    return "\n".join(x for x in lines if x)


def test_articles_of_the_whole_table(spark):
    pages = {r.page_id: r.html for r in table(spark, plain.SF, "pages").collect()}
    rows = op2_html_extraction(spark, plain.SF).collect()
    assert len(rows) == len(pages)
    same = sum(r.text == article_lines(pages[r.page_id]) for r in rows)
    assert same == len(rows)
    assert all(r.n_chars == len(r.text) for r in rows)


def test_held_out_pages_with_other_parts(spark):
    pages = [r.html for r in table(spark, "/root/testdata/sf0.01", "pages").orderBy("page_id").collect()]
    model, rng, right = extraction.train(pages[:100]), random.Random(77), 0
    for page in pages[100:200]:
        tree = read(page)
        built = read(extraction.variant(rng, tree, extraction.landmark_labels(tree)))
        wanted, bare = extraction.landmark_labels(built), extraction.without_marks(built)
        content = model.marginals(extraction.Pages([bare])) > 0.5
        right += extraction.main_text(bare, content) == extraction.main_text(bare, wanted)
    assert right >= 95


def test_marginals_are_exact():
    tree = read("<div class=menu><p>a</p><ul><li>b</li></ul></div><p>c</p>")
    pages = extraction.Pages([tree])
    rng = np.random.default_rng(0)
    model = extraction.Model(rng.normal(size=extraction.FEATURES), rng.normal(size=(3, 2, 2)))
    scores, n = model.scores(pages), len(tree.tag)
    total, on = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        log = sum(scores[i] * y[i] for i in range(n))
        log += sum(model.joint[pages.kind[i], y[tree.parent[i]], y[i]] for i in range(1, n))
        total += np.exp(log)
        on += np.exp(log) * np.array(y)
    assert np.allclose(model.marginals(pages), on / total)


def test_tolerant_reading():
    tree = read("<p>a &amp; b<br>c <b>d<p>e\n f<script>var t='</p>x'</script> g<ul><li>h<li>i</ul> &copy j<div")
    assert [t for t in tree.text if t] == ["a & b c d", "e f g", "h", "i", "© j"]
    assert [t for t in read("<!-- <p>x</p> --><p>1 < 2</p>").text if t] == ["1 < 2"]
    assert read(None).text == [None] and read("").text == [None]


def texts_of(page):
    return [t for t in read(page).text if t]


def test_elements_inside_a_line_keep_the_block():
    for inside in ("<svg><path/></svg>", "<svg/>", "<script>x</script>", "<canvas>x</canvas>", "<img src=x>", "<input>", "<style>x</style>"):
        assert texts_of(f"<p>Press the {inside} button to go {inside}on</p><p>next</p>") == ["Press the button to go on", "next"]
    assert texts_of("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be") == ["Let x=2 be"]
    formula = "<math><semantics><msup><mi>x</mi><mn>2</mn></msup><annotation>x^2</annotation></semantics></math>"
    assert texts_of(f"<p>the {formula} here</p>") == ["the x2 here"]
    assert texts_of("<p>a<hr>b</p>") == ["a", "b"]


def test_deep_nesting_takes_linear_time():
    start = time.perf_counter()
    deep = 50_000
    assert texts_of("<div>" * deep + "in" + "</div>" * deep) == ["in"]
    assert texts_of("<div>" * deep + "</section></i>" * deep + "in") == ["in"]
    assert texts_of("<li><ul>" + "<div>" * deep + "<li>x</li>" * deep) == ["x"] * deep
    assert texts_of("<b>" * deep + "in" + "</i>" * deep) == ["in"]
    assert time.perf_counter() - start < 20


def test_pages_without_names_have_their_prose(spark):
    pages = [r.html for r in table(spark, "/root/testdata/sf0.01", "pages").orderBy("page_id").collect()]
    model = extraction.train(pages[:100])
    links = "".join(f'<li><a href="/{i}">Part {i}</a></li>' for i in range(8))
    prose = "<h1>Of the river</h1>" + "".join(f"<p>Paragraph {i} tells what happened by the river in that year.</p>" for i in range(4))
    wanted = "\n".join(["Of the river", *(f"Paragraph {i} tells what happened by the river in that year." for i in range(4))])
    for page in (
        f"<html><body><ul>{links}</ul>{prose}</body></html>",
        f"<html><body><div><ul>{links}</ul></div><div>{prose}</div></body></html>",
        f"<ul>{links}</ul>{prose}<footer><p>Imprint</p></footer>",
    ):
        tree = read(page)
        assert extraction.main_text(tree, model.marginals(extraction.Pages([tree])) > 0.5) == wanted


def test_sample_is_of_different_pages(spark, monkeypatch):
    monkeypatch.setattr(extraction, "SAMPLE_PAGES", 5)
    rows = [(i, None if i % 7 == 0 else f"<p>{i if i % 3 else 'same'}</p>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id bigint, html string").repartition(6)
    drawn = extraction.labelled_sample(pages)
    assert len(set(drawn)) == len(drawn) == 5 and drawn == extraction.labelled_sample(pages.repartition(2))
    assert extraction.labelled_sample(pages.limit(0)) == []


def test_raw_elements_after_letters_that_grow_in_lower_case():
    body = "".join(f"<p>{'İ' * 60}</p><{tag}>x İ</{tag.upper()}><p>Text behind a {tag} element.</p>" for tag in sorted(RAW))
    texts = [t for t in read(body).text if t]
    assert texts == [x for tag in sorted(RAW) for x in ("İ" * 60, f"Text behind a {tag} element.")]
    assert [t for t in read("<p>a</p><script>c</ſcript></script>d").text if t] == ["a", "d"]


def test_odd_pages(spark):
    rows = [(1, None, "u"), (2, "", "u"), (2, "", "u"), (3, "<" * 5000, "u"), (4, "<div>" * 3000 + "deep", "u"), (5, "plain text", "u")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, text string")
    out = extraction.extract_text(pages)
    assert out.columns == ["page_id", "text", "text_", "n_chars"]
    got = out.collect()
    assert len(got) == 6 and [r.text_ for r in got if r.page_id < 3] == ["", "", ""]
    assert extraction.extract_text(pages.limit(0)).collect() == []


def test_toxic_texts_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = toxicity.train(docs, labels.where(~held))
    assert all(a <= b for a, b in itertools.pairwise(model.thresholds))
    truth = {r.doc_id: r.toxic for r in labels.where(held).collect()}
    out = toxicity.grade_toxicity(docs.where(held), model, keep_text=False).where(F.col("doc_id").isin(list(truth))).collect()
    caught = [r.toxic for r in out if truth[r.doc_id]]
    blamed = [r.toxic for r in out if not truth[r.doc_id]]
    assert sum(caught) >= 0.85 * len(caught) and sum(blamed) <= 0.01 * len(blamed)
    assert all(0 <= r.severity <= 2 and r.toxic == (r.grade > 0) for r in out)


def test_ordinal_gradient_finds_shared_weights():
    rng = np.random.default_rng(3)
    x = [sorted(set(rng.integers(0, 6, rng.integers(0, 5)).tolist())) for _ in range(3000)]
    score = np.array([sum(1.0 + i for i in r) for r in x])
    p = 1 / (1 + np.exp(-(score[:, None] - np.array([4.0, 9.0]))))
    u = rng.random(len(x))
    model = toxicity.fit(x, (u[:, None] < p).sum(1), np.ones(len(x)), list("abcdef"))
    assert np.allclose([model.weights[c] for c in "abcdef"], np.arange(1, 7), atol=0.6)
    assert np.allclose(model.thresholds, [4, 9], atol=0.6)


def test_odd_documents_toxicity(spark):
    out = op7_toxicity(spark, plain.SF)
    assert out.count() == table(spark, plain.SF, "documents").count()
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    graded = toxicity.grade_toxicity(plain.odd(spark), toxicity.train(plain.odd(spark), labels))
    assert graded.columns == ["doc_id", "text", "size", "_ID", "severity", "grade", "toxic"]
    assert [r.toxic for r in graded.collect()] == [False] * len(plain.ODD)
