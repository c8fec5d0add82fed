"""A tolerant reading of HTML into a tree of block elements with text blocks as leaves."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from dataclasses import dataclass

#: Fixed values of HTML: elements without content, of these the ones that end a block, elements whose content is left
#: out, and inline elements with those of MathML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKING = frozenset("col hr".split())
RAW = frozenset(
    "script style noscript template textarea title iframe object svg select canvas audio video annotation annotation-xml".split()
)
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var acronym nobr wbr picture ruby rb rt rp rtc "
    "math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts "
    "mprescripts mtable mtr mtd mstyle mpadded mphantom merror menclose mfenced".split()
)
#: An opening element closes these open ones, looking up no further than the stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
#: Searched in the page itself: a lower-cased copy may be longer (U+0130 becomes two characters).
RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WHITE = re.compile(r"\s+")


@dataclass
class Tree:
    """Nodes in page order; a parent comes before its children. ``text`` is None for elements."""

    parent: list[int]
    tag: list[str]
    attributes: list[str]
    text: list[str | None]
    linked: list[int]  # of a text block, the characters inside links


def read(page: str | None) -> Tree:
    """The tree of a page. Unclosed and stray tags are put up with; an unfinished last tag is dropped.

    Elements that stand inside a line (inline ones, pictures, and those whose content is left out) don't end a block. The
    open places of each tag are kept, so a tag costs the same at any depth of nesting.
    """
    tree = Tree([-1], ["#page"], [""], [None], [0])
    open_: list[int] = [0]  # open block elements
    places: dict[str, list[int]] = {}  # of each tag, its places in ``open_``
    linking = 0  # open links of the block
    parts: list[str] = []
    links: list[str] = []

    def add(tag: str, attributes: str, text: str | None, linked: int = 0) -> int:
        tree.parent.append(open_[-1])
        tree.tag.append(tag)
        tree.attributes.append(attributes)
        tree.text.append(text)
        tree.linked.append(linked)
        return len(tree.tag) - 1

    def flush() -> None:
        if parts:
            text = WHITE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                add("#text", "", text, len(WHITE.sub(" ", "".join(links)).strip()))
            parts.clear()
            links.clear()

    def innermost(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(upto: int) -> None:
        nonlocal linking
        flush()
        for node in open_[upto:]:
            places[tree.tag[node]].pop()
        del open_[upto:]
        linking = 0

    def put(piece: str) -> None:
        if piece:
            parts.append(piece)
            if linking:
                links.append(piece)

    page = page or ""
    at = 0
    for found in iter(lambda: TAG.search(page, at), None):
        put(page[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        attributes = found[3] or found[6] or ""
        if not tag:
            continue
        if found[1] or found[4]:  # closing
            if tag in INLINE:
                if tag == "a" and linking:
                    linking -= 1
            elif place := innermost((tag,)):
                close(place)
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                end = RAW_END[tag].search(page, at)
                at = end.start() if end else len(page)
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in INLINE:
            if tag == "a" and not attributes.endswith("/"):
                linking += 1
            continue
        if tag in VOID:
            if tag in BREAKING:
                flush()
            continue
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            if (place := innermost(ends)) > innermost(stops):
                close(place)
        elif tree.tag[open_[-1]] == "p":
            close(len(open_) - 1)
        flush()
        said = " ".join(" ".join(filter(None, a.groups())) for a in ATTRIBUTE.finditer(attributes)) if attributes.strip() else ""
        node = add(tag, html.unescape(said), None)
        places.setdefault(tag, []).append(len(open_))
        open_.append(node)
        linking = 0
    put(page[at:])
    flush()
    return tree
