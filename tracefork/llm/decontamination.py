"""Benchmark decontamination: a generalised suffix automaton of the test items, streamed over the documents.

The automaton is over words. While a document's words are fed to it, the length of the longest suffix that also
occurs in some item is known at every word. A test window is a run of ``window`` item words (a shorter item is one
window as a whole); the words below any occurrence of a window are hit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracefork.llm.tables import free_name, parts_for, settle, text_bytes
from tracefork.llm.words import alnum_words, texts

WINDOW = 10
#: Bytes of item text in one automaton. Larger benchmarks are split, and the documents pass each part in turn.
SHARD_BYTES = 8_000_000


class Automaton:
    """Generalised suffix automaton; ``items`` are (label, words) pairs."""

    def __init__(self, items: Sequence[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [
            (label, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for label, words in items if words
        ]
        for _, word_ids in coded:
            last = 0
            for word in word_ids:
                last = self._extend(last, word)
        self.shortest = min((min(len(ids), window) for _, ids in coded), default=window)
        self.full: dict[int, set[str]] = {}  # state of a window of `window` words -> items
        self.short: dict[int, list[tuple[int, set[str]]]] = {}  # state -> (length, items) of short items ending there
        for label, word_ids in coded:
            if len(word_ids) >= window:
                for _, state in self._windows(word_ids):
                    self.full.setdefault(state, set()).add(label)
            else:
                state = 0
                for word in word_ids:
                    state = self.next[state][word]
                found = self.short.setdefault(state, [])
                same = [labels for length, labels in found if length == len(word_ids)]
                if same:
                    same[0].add(label)
                else:
                    found.append((len(word_ids), {label}))
        self.short_up = self._nearest_short()

    def _extend(self, last: int, word: int) -> int:
        """The state after ``last`` by ``word``, made where it is missing."""
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            to = nxt[last][word]
            return to if length[to] == length[last] + 1 else self._split(last, word, to)
        state = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and word not in nxt[at]:
            nxt[at][word] = state
            at = link[at]
        if at >= 0:
            to = nxt[at][word]
            link[state] = to if length[to] == length[at] + 1 else self._split(at, word, to)
        return state

    def _split(self, at: int, word: int, to: int) -> int:
        """A copy of ``to`` that holds only the substrings reached from ``at`` and shorter."""
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[to]))
        length.append(length[at] + 1)
        link.append(link[to])
        link[to] = copy
        while at >= 0 and nxt[at].get(word) == to:
            nxt[at][word] = copy
            at = link[at]
        return copy

    def _nearest_short(self) -> list[int]:
        """For each state, the nearest state on its suffix path (itself included) where a short item ends, or -1."""
        up = [-1] * len(self.next)
        if self.short:
            for state in sorted(range(len(self.next)), key=self.length.__getitem__):
                up[state] = state if state in self.short else (up[self.link[state]] if state else -1)
        return up

    def _steps(self, word_ids: Iterable[int]) -> Iterator[tuple[int, int, int]]:
        """(place, state, longest matching length) after each word that matches anything."""
        state = length = 0
        for place, word in enumerate(word_ids):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
                yield place, state, length

    def _windows(self, word_ids: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(last place, state) of each run of exactly ``window`` words that some item has."""
        for place, state, length in self._steps(word_ids):
            if length >= self.window:
                while self.length[self.link[state]] >= self.window:
                    state = self.link[state]
                yield place, state

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items with occurring windows."""
        hit = np.zeros(len(words), bool)
        found: set[str] = set()
        known = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), np.int64, len(words))
        inside = np.flatnonzero(np.diff(np.concatenate(([0], (known >= 0).view(np.int8), [0]))))
        for start, end in zip(inside[::2].tolist(), inside[1::2].tolist()):
            if end - start < self.shortest:
                continue
            for place, state, length in self._steps(known[start:end].tolist()):
                place += start
                if length >= self.window:
                    whole = state
                    while self.length[self.link[whole]] >= self.window:
                        whole = self.link[whole]
                    if whole in self.full:
                        hit[place + 1 - self.window : place + 1] = True
                        found |= self.full[whole]
                at = self.short_up[state]
                while at >= 0:
                    for size, labels in self.short[at]:
                        if size <= length:
                            hit[place + 1 - size : place + 1] = True
                            found |= labels
                    at = self.short_up[self.link[at]] if at else -1
        return hit, found


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of hit words as (first, past the last)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()
    return list(zip(edges[::2], edges[1::2]))


def automata(benchmark: DataFrame, window: int, shards: int) -> Iterator[Automaton]:
    """One automaton for each part of the benchmark; a part has a bounded size and is read alone."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    for shard in range(shards):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard)
        rows = part.where(F.col("item_id").isNotNull()).collect()
        yield Automaton([(r.item_id, alnum_words((r.text or "").encode())) for r in rows], window)


def mark_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, keep_text: bool = True
) -> DataFrame:
    """``docs`` with ``leak_words`` (its words), ``leak_spans`` (maximal hit runs, as word places first and past the
    last, flat) and ``leak_items`` (sorted ids of the items found). Other columns stay as they are.

    Null or wordless texts have no words and no spans; items without words or without id are no items; a repeated item
    counts once. An empty benchmark hits nothing. The three names get a trailing underscore where ``docs`` has them.
    Without ``keep_text`` the text column is left out.
    """
    names = [free_name(docs, n) for n in ("leak_words", "leak_spans", "leak_items")]
    n_words, spans, items = names
    out = docs.select(
        "*",
        F.lit(0).cast("bigint").alias(n_words),
        F.array().cast("array<int>").alias(spans),
        F.array().cast("array<string>").alias(items),
    )
    read, parts = out.columns.index("text"), parts_for(text_bytes(benchmark), shard_bytes)
    for place, automaton in enumerate(automata(benchmark, window, parts)):
        dropped = place == parts - 1 and not keep_text
        schema = StructType([f for i, f in enumerate(out.schema) if not (dropped and i == read)])
        shared = docs.sparkSession.sparkContext.broadcast(automaton)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, dropped=dropped) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                counts, places, labels = [], [], []
                earlier = zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())
                for text, (was, had) in zip(texts(batch.column(read)), earlier):
                    words = alnum_words(text)
                    hit, found = known.match(words)
                    for a, b in zip(was[::2], was[1::2]):
                        hit[a:b] = True
                    counts.append(len(words))
                    places.append([x for run in runs(hit) for x in run])
                    labels.append(sorted(found.union(had)))
                fresh = [pa.array(counts, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(labels, pa.list_(pa.string()))]
                done = pa.RecordBatch.from_arrays([*batch.columns[:-3], *fresh], names=batch.schema.names)
                yield done.select([i for i in range(done.num_columns) if not (dropped and i == read)])

        out = (settle(out) if place else out).mapInArrow(scan, schema)
    return out


def leak_digest(marked: DataFrame) -> DataFrame:
    """Per document: word and hit counts, number and digest of the items, and whether anything was hit."""
    hit = F.aggregate(
        F.sequence(F.lit(0), F.size("leak_spans") - 1, F.lit(2)),
        F.lit(0).cast("bigint"),
        lambda acc, i: acc + F.get("leak_spans", i + 1) - F.get("leak_spans", i),
    )
    return marked.select(
        "doc_id",
        F.col("leak_words").alias("n_words"),
        F.when(F.size("leak_spans") > 0, hit).otherwise(F.lit(0).cast("bigint")).alias("n_hit"),
        F.size("leak_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("leak_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("leak_spans") > 0).alias("contaminated"),
    )


def cut_words(text: str, spans: Sequence[int]) -> str:
    """The text without its hit words; what stands between the words of a removed run goes with it."""
    raw = text.encode()
    flat = raw.translate(_MARKS)
    ends = np.flatnonzero(np.diff(np.concatenate(([0], np.frombuffer(flat, np.uint8), [0])).astype(np.int8)))
    starts, stops = ends[::2], ends[1::2]
    kept, at = [], 0
    for first, past in zip(spans[::2], spans[1::2]):
        kept.append(raw[at : starts[first]])
        at = int(stops[past - 1])
    kept.append(raw[at:])
    return b"".join(kept).decode()


_MARKS = bytes(
    1 if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0 for b in range(256)
)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without benchmark passages: hit spans are cut from the text, and a document whose hit words are more
    than ``max_coverage`` of its words goes. A document without hits is returned as it is; columns stay the same.
    """
    marked = mark_leaks(docs, benchmark, window)
    names, schema = docs.columns, docs.schema
    read = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column(read).to_pylist(), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()))
            keep = [sum(s[1::2]) - sum(s[::2]) <= max_coverage * n for _, n, s in rows]
            fresh = pa.array([cut_words(t, s) if s else t for t, _, s in rows], pa.string())
            columns = [fresh if i == read else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return marked.mapInArrow(cut, schema)
