"""Plain, quadratic or single-machine versions that the operators are compared with, and odd documents."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

LONG = " ".join(f"word{i % 977}x{i * i % 1013}" for i in range(4000))
#: (doc_id, text, and columns whose names the operators use themselves)
ODD = [
    (1, None, 1, "a"),
    (2, "", 2, "b"),
    (3, " \n\t ", 3, None),
    (4, "Ünï code and a word", 4, "c"),
    (5, LONG, 5, "d"),
    (5, LONG, 5, "d"),
    (6, LONG + " one more", 6, "e"),
    (None, LONG + " none has this id", 7, "f"),
    (None, None, None, None),
    (9, "Ünï code and a word", 9, "g"),
    (10, "same same same same " * 40, 10, "h"),
]
ODD_SCHEMA = "doc_id bigint, text string, size bigint, `_ID` string"


def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


def shingles(text: str | None) -> frozenset:
    words = SPACED.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(docs: list[tuple[int, str | None]], least: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id -> (shingles, component) by links of ``least`` percent."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in where[s])
        for s in sets[i]:
            where[s].append(i)
        for j, n in common.items():
            if 100 * n >= least * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeats(docs: list[tuple[int, str | None]], window: int = 50) -> dict[int, tuple[int, int, int, str, bytes]]:
    """doc_id -> (bytes, removed, spans, digest, kept)."""
    first: dict[bytes, int] = {}
    out = {}
    for i, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - window + 1):
            if first.setdefault(raw[s : s + window], i) < i:
                gone[s : s + window] = b"\1" * window
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def leaks(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = 10) -> dict[int, tuple]:
    """doc_id -> (words, hit, items, digest)."""
    windows = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        size = min(window, len(words))
        for s in range(len(words) - size + 1 if size else 0):
            windows[tuple(words[s : s + size])].add(str(item))
    sizes = sorted({len(w) for w in windows})
    out = {}
    for i, text in docs:
        words = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for s in range(len(words)):
            for size in sizes:
                if (own := windows.get(tuple(words[s : s + size]))) is not None and s + size <= len(words):
                    hit |= set(range(s, s + size))
                    found |= own
        out[i] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out
