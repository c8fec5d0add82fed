"""HTML extraction by a tree-structured graphical model over DOM nodes.

Every block element and every text block of a page is a node that is content or not. A node has a potential from its
own evidence (tag, words of class, id and role, share of links); a parent and a child have a joint potential
by the kind of child. Sum-product messages go from the leaves to the root and back, which gives each node's marginal
exactly; text blocks that are content more likely than not are the main text.

Labels come from pages whose authors marked the article with a landmark element, from a bounded sample of the table,
and from built pages. Both are seen in variants without the landmark and with other page parts around and inside the
article, so that the model learns from what else tells content from the rest.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tracefork.llm.html_tree import Tree, read
from tracefork.llm.tables import free_name

#: Labelled pages: at most so many of the table, none longer than so many bytes, and so many built ones.
SAMPLE_PAGES, SAMPLE_BYTES, BUILT_PAGES = 300, 60_000, 150
VARIANTS = 3
#: Share of the built pages whose article has no name and no landmark around it.
UNNAMED = 0.15
FEATURES = 1 << 14
STEPS, RATE, DECAY = 150, 0.3, 1e-4
SEED = 11

#: Landmark elements, elements that are never part of an article, and what page parts are called.
LANDMARKS = ("article", "main")
APART = frozenset("nav header footer aside form button dialog menu".split())
NAMES = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs toc tabs pagination pager topbar links skip",
    "header": "header masthead topbar branding logo sitehead banner toolbar",
    "footer": "footer foot copyright legal colophon bottom credits imprint",
    "sidebar": "sidebar side aside related widget rail recommended trending popular more tags share social author-box",
    "notice": "notice cookie cookies consent gdpr alert warning popup modal overlay newsletter subscribe paywall message banner",
    "advert": "ad ads advert advertisement adsbox adslot sponsor sponsored promo promotion banner commercial",
    "form": "form search login signup contact subscribe field",
    "comments": "comments comment reply replies respond discussion disqus responses reader-comments thread feedback",
}
CONTENT_NAMES = "content article post entry story main body text page-content article-body post-content entry-content prose"
PART_TAGS = {
    "menu": "nav div ul", "header": "header div", "footer": "footer div", "sidebar": "aside div section", "notice": "div section p",
    "advert": "div aside p section", "form": "form div", "comments": "section div ol",
}
PHRASES = {
    "menu": "Home|About|News|Contact|Archive|Next|Previous|Log in",
    "header": "Welcome|Our site|Search the site|The daily page",
    "footer": "Copyright 2024|All rights reserved|Terms of use|Privacy policy|Imprint",
    "sidebar": "Related stories|Most read|Follow us|Tags|About the author",
    "notice": "We use cookies to improve this site|Accept all|Please turn off your ad blocker|Sign up for our newsletter",
    "advert": "Buy now|Sponsored|Limited offer|Click here for more|Best prices online",
    "form": "Your name|E-mail|Send|Search|Password|Subscribe",
    "comments": "Great read|I don't agree with this|Reply|3 days ago|Thanks for sharing|First",
}

#: Marks of the labels, with the attribute's name where nothing else is in it.
MARKS = re.compile(r"\b(?:class|id) (?:xcontent|xpart)\s*$|\b(?:class|id) (?:xcontent|xpart)\s+(?=(?:class|id)\b)|\b(?:xcontent|xpart)\b")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


#: Elements that say nothing about themselves; they and their text follow what they stand in.
PLAIN = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption dd dt dl table tbody thead tr td th hr #page html head center".split())
#: Blocks of prose, and the elements that, unnamed, only group others. A page may hold its article in these alone.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
GROUPS = frozenset("#page html body div section center".split())
#: The feature of nodes without evidence; its weight stays 0.
NONE = 0


def feature(name: str, cache: dict[str, int] = {}) -> int:  # noqa: B006  (a memory of the worker)
    known = cache.get(name)
    if known is None:
        if len(cache) > 200_000:
            cache.clear()
        known = cache[name] = 1 + zlib.crc32(name.encode()) % (FEATURES - 1)
    return known


def node_features(tree: Tree) -> list[list[int]]:
    """Feature numbers of every node: names and tags of elements, whether most of the text is links, and whether a block
    of prose has nothing but unnamed groups around it."""
    n = len(tree.tag)
    chars, linked = [len(t) if t else 0 for t in tree.text], list(tree.linked)
    for i in range(n - 1, 0, -1):
        chars[tree.parent[i]] += chars[i]
        linked[tree.parent[i]] += linked[i]
    out, unnamed = [], [False] * n
    for i in range(n):
        own = [NONE]
        around = i == 0 or unnamed[tree.parent[i]]
        unnamed[i] = around and tree.tag[i] in GROUPS and not tree.attributes[i]
        if around and tree.tag[i] in PROSE and not tree.attributes[i]:
            own.append(feature("unnamed prose"))
        mostly = linked[i] * 2 > chars[i]
        if tree.text[i] is not None:
            if mostly:
                own.append(feature("linked text"))
            if "\u00a9" in tree.text[i]:
                own.append(feature("copyright"))
        else:
            if tree.tag[i] not in PLAIN:
                own.append(feature(f"tag {tree.tag[i]}"))
            if mostly:
                own.append(feature("linked element"))
            if tree.attributes[i]:
                own += [feature(f"name {w}") for w in {w.lower() for w in WORD.findall(tree.attributes[i])}]
        out.append(own)
    return out


#: Kinds of edges, by child: a text block, a part that is named, any other element.
def edge_kind(tree: Tree, i: int) -> int:
    return 0 if tree.text[i] is not None else 1 if tree.attributes[i] or tree.tag[i] in APART else 2


class Pages:
    """The nodes of several pages in one set of arrays."""

    def __init__(self, trees: list[Tree]):
        sizes = [len(t.tag) for t in trees]
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        lists = [f for t in trees for f in node_features(t)]
        self.features = np.fromiter((x for f in lists for x in f), np.int64)
        self.first = np.concatenate(([0], np.cumsum([len(f) for f in lists])[:-1])).astype(np.int64)
        self.counts = np.array([len(f) for f in lists], np.int64)
        self.parent = np.concatenate([np.array(t.parent, np.int64) + s for t, s in zip(trees, self.starts)])
        self.parent[self.starts[:-1]] = -1
        self.kind = np.concatenate([np.array([edge_kind(t, i) for i in range(len(t.tag))], np.int64) for t in trees])
        depth = []
        for t in trees:
            own = [0] * len(t.tag)
            for i in range(1, len(own)):
                own[i] = own[t.parent[i]] + 1
            depth += own
        self.depth = np.array(depth, np.int64)
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(self.depth.max() + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


class Model:
    """Weights of the node features and joint potentials of parent and child, as log values."""

    def __init__(self, weights: np.ndarray, joint: np.ndarray):
        self.weights, self.joint = weights, joint

    def scores(self, pages: Pages) -> np.ndarray:
        return np.add.reduceat(self.weights[pages.features], pages.first)

    def marginals(self, pages: Pages) -> np.ndarray:
        """P(content) of every node: one sweep of messages up the trees and one down, level by level over all pages."""
        n = len(pages.parent)
        belief, up = np.zeros((n, 2)), np.zeros((n, 2))
        belief[:, 1] = self.scores(pages)
        for level in pages.levels[:0:-1]:
            table = self.joint[pages.kind[level]] + belief[level][:, None, :]  # [node, parent's state, own state]
            up[level] = np.logaddexp(table[:, :, 0], table[:, :, 1])
            np.add.at(belief, pages.parent[level], up[level])
        for level in pages.levels[1:]:
            outside = belief[pages.parent[level]] - up[level]
            outside -= outside.max(axis=1, keepdims=True)
            table = self.joint[pages.kind[level]] + outside[:, :, None]
            belief[level] += np.logaddexp(table[:, 0, :], table[:, 1, :])
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))


def fit(trees: list[Tree], labels: list[np.ndarray]) -> Model:
    """Joint potentials are the labelled frequencies of a child's state given its parent's, so a child without evidence
    sends an even message; node weights follow the likelihood of the labelled pages, whose gradient is what the labels
    show less what the messages expect."""
    pages, y = Pages(trees), np.concatenate(labels).astype(np.int64)
    node, child = np.repeat(np.arange(len(y)), pages.counts), np.flatnonzero(pages.parent >= 0)
    seen = np.ones((3, 2, 2))
    np.add.at(seen, (pages.kind[child], y[pages.parent[child]], y[child]), 1.0)
    model = Model(np.zeros(FEATURES), np.log(seen / seen.sum(axis=2, keepdims=True)))
    squared = np.full(FEATURES, 1e-8)
    for _ in range(STEPS):
        off = (model.marginals(pages) - y)[node]
        gradient = np.bincount(pages.features, weights=off, minlength=FEATURES) / len(trees) + DECAY * model.weights
        gradient[NONE] = 0.0
        squared += gradient**2
        model.weights -= RATE * gradient / np.sqrt(squared)
    return model


def landmark_labels(tree: Tree) -> np.ndarray | None:
    """Content is what lies in the first landmark with text, except for parts that stand apart or were put in as such
    (marked by the attribute word ``xpart``); None without a landmark."""
    inside, n = np.zeros(len(tree.tag), bool), len(tree.tag)
    roots = [i for i in range(n) if tree.tag[i] in LANDMARKS or "xcontent" in tree.attributes[i]]
    if not roots:
        return None
    for i in range(roots[0], n):
        apart = tree.tag[i] in APART or "xpart" in tree.attributes[i]
        inside[i] = not apart and (i == roots[0] or (tree.parent[i] >= 0 and inside[tree.parent[i]]))
    return inside if any(inside[i] and tree.text[i] for i in range(n)) else None


def without_marks(tree: Tree) -> Tree:
    """The tree as an unlabelled page would have it."""
    said = [MARKS.sub("", a).strip() if "x" in a else a for a in tree.attributes]
    return Tree(tree.parent, tree.tag, said, tree.text, tree.linked)


def built_part(rng: random.Random, kind: str, prose: list[str]) -> str:
    """A page part of the given kind; comments and adverts may read like prose."""
    tag = rng.choice(PART_TAGS[kind].split())
    own = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind)
    named = rng.random() < 0.8 or tag != own
    name = f'{rng.choice(["class", "class", "id"])}="xpart {rng.choice(NAMES[kind].split())}"' if named else 'class="xpart"'
    lines = rng.sample(PHRASES[kind].split("|"), rng.randint(1, 3))
    if kind in ("comments", "advert", "notice", "sidebar") and prose and rng.random() < 0.7:
        lines += rng.sample(prose, min(len(prose), rng.randint(1, 3)))
    if kind == "menu":
        inner = "".join(f'<li><a href="#">{html.escape(x)}</a></li>' for x in lines * 2)
        inner = inner if tag == "ul" else f"<ul>{inner}</ul>"
    elif tag == "p":
        inner = html.escape(" ".join(lines))
    else:
        wrap = rng.choice(["p", "div", "li", ""])
        inner = "".join(f"<{wrap}>{html.escape(x)}</{wrap}>" if wrap else html.escape(x) + " " for x in lines)
    return f"<{tag} {name}>{inner}</{tag}>"


def built_page(rng: random.Random, prose: list[str]) -> str:
    """A labelled page: paragraphs in a marked element, page parts around it and sometimes inside."""
    tag, name = rng.choice([("article", ""), ("main", ""), *[("div", n) for n in CONTENT_NAMES.split()], ("section", "content")])
    marks = f'class="xcontent {name}"' if rng.random() < 0.5 else f'class="xcontent" id="{name}"'
    body = [f"<h1>{html.escape(prose[0][:60])}</h1>"]
    for text in prose:
        shape = rng.random()
        body.append(
            f"<p>{html.escape(text)}</p>" if shape < 0.7 else f"<h2>{html.escape(text[:40])}</h2>" if shape < 0.8
            else f"<ul><li>{html.escape(text)}</li></ul>" if shape < 0.88 else f"<blockquote>{html.escape(text)}</blockquote>"
        )
        if rng.random() < 0.06:
            body.append(built_part(rng, rng.choice(["advert", "sidebar", "form", "notice"]), prose))
    if rng.random() < 0.25:
        body.append(built_part(rng, "comments", prose))
    bare = rng.random() < UNNAMED
    before = [built_part(rng, k, prose) for k in ("notice", "header", "menu", "advert") if rng.random() < 0.6]
    after = [built_part(rng, k, prose) for k in ("sidebar", "comments", "form", "advert", "footer") if rng.random() < 0.6]
    if bare:
        if rng.random() < 0.6:  # a list of links that only its links tell from the article
            entries = (f'<li><a href="#">{html.escape(x)}</a></li>' for x in rng.sample(PHRASES["menu"].split("|"), rng.randint(3, 8)))
            before.append(f'<ul class="xpart">{"".join(entries)}</ul>')
        if rng.random() < 0.5:
            return f'<html><body class="xcontent">{"".join(before)}{"".join(body)}{"".join(after)}</body></html>'
        tag, marks = "div", 'class="xcontent"'
    article = f"<{tag} {marks}>{''.join(body)}</{tag}>"
    if not bare and rng.random() < 0.3:
        article = f'<div class="{rng.choice(["wrapper", "container", "page", "layout", "row"])}">{article}</div>'
    return f"<html><body>{''.join(before)}{article}{''.join(after)}</body></html>"


def variant(rng: random.Random, tree: Tree, inside: np.ndarray) -> str:
    """A built page with the paragraphs of a labelled one."""
    prose = [t for i, t in enumerate(tree.text) if t and inside[i]][:12]
    return built_page(rng, prose)


FILLER = "the first of these was made in a small town by the river where people had lived for a long time and it is still there".split()


def train(pages: list[str]) -> Model:
    """The model from labelled pages among ``pages`` and from built pages."""
    rng, marked = random.Random(SEED), []
    for page in pages:
        tree = read(page)
        if (inside := landmark_labels(tree)) is not None:
            marked.append((tree, inside))
    built = [
        built_page(rng, [" ".join(rng.choices(FILLER, k=rng.randint(3, 60))).capitalize() + "." for _ in range(rng.randint(1, 10))])
        for _ in range(BUILT_PAGES)
    ]
    built += [variant(rng, tree, inside) for tree, inside in marked for _ in range(VARIANTS - 1)]
    for page in built:
        tree = read(page)
        if (inside := landmark_labels(tree)) is not None:
            marked.append((tree, inside))
    return fit([without_marks(t) for t, _ in marked], [i for _, i in marked])


def main_text(tree: Tree, content: np.ndarray) -> str:
    return "\n".join(t for t, p in zip(tree.text, content) if t and p)


def labelled_sample(pages: DataFrame) -> list[str]:
    """The bounded sample, the same in every run: the different pages with the smallest hashes.

    Hashes alone are ordered; only the pages of the sample leave their tasks.
    """
    able = pages.where(F.octet_length("html") <= SAMPLE_BYTES).select("html", F.xxhash64("html").alias("hash"))
    last = able.select("hash").distinct().orderBy("hash").limit(SAMPLE_PAGES).agg(F.max("hash")).head()[0]
    if last is None:
        return []
    drawn = able.where(F.col("hash") <= last).groupBy("hash").agg(F.min("html").alias("html"))
    return [r.html for r in drawn.orderBy("hash").collect()]


def extract_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``pages`` with ``text``, the main text (empty if none), and ``n_chars``, its code points; ``html`` is left out.

    Null or empty html has no text. Blocks are joined in page order by a line feed; white space inside a block is one
    blank. Empty tables give no rows; names that ``pages`` has already get a trailing underscore.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train(labelled_sample(pages)))
    left = [c for c in pages.columns if c != "html"]
    names = [free_name(pages.select(*left), n) for n in ("text", "n_chars")]
    schema = StructType([*(pages.schema[c] for c in left), StructField(names[0], StringType()), StructField(names[1], LongType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                trees = [read(page) for page in some.column(len(left)).to_pylist()]
                nodes = Pages(trees)
                content = shared.value.marginals(nodes) > 0.5
                out = [main_text(t, content[s : s + len(t.tag)]) for t, s in zip(trees, nodes.starts)]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:-1], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=schema.names
                )

    return pages.select(*left, "html").mapInArrow(extract, schema)
