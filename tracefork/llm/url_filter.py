"""URL filters: a trie over reversed host labels and path segments, shared with the tasks, longest match first.

A rule names a host and a path prefix. It fits its host and all subdomains where the url's path starts with the rule's.
Each trie level below the host holds one path segment; the last piece of a rule's path may end inside a segment.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from tracefork.llm.tables import free_name

#: Most rules that are shared with the tasks as one trie; more are refused, so what is broadcast stays bounded.
MAX_RULES = 1_000_000


@dataclass
class Node:
    below: dict[str, Node] = field(default_factory=dict)
    paths: Node | None = None  # of a host: the segments below it
    ends: list[tuple[str, str, str]] = field(default_factory=list)  # (rest of a segment, rule, verdict), longest first


class RuleTrie:
    """Rules are (verdict, host, path); a repeated (host, path) keeps its strictest verdict, block."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} url rules; at most {MAX_RULES} are shared with the tasks")
        self.root = Node()
        for verdict, host, path in sorted(set(rules), reverse=True):  # block after allow is dropped below
            if verdict not in ("allow", "block"):
                raise ValueError(f"a url rule says allow or block, not {verdict!r}")
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.below.setdefault(label, Node())
            node.paths = node.paths or Node()
            node = node.paths
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.below.setdefault(segment, Node())
            if all(rest != other for other, _, _ in node.ends):
                node.ends.append((rest, host + path, verdict))
                node.ends.sort(key=lambda end: -len(end[0]))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits: most host labels first, then the longest path."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            if label not in node.below:
                break
            node = node.below[label]
            best = self._in_path(node.paths, path) or best
        return best

    @staticmethod
    def _in_path(node: Node | None, path: str) -> tuple[str, str] | None:
        best, at = None, 0
        while node is not None:
            best = next(((rule, verdict) for rest, rule, verdict in node.ends if path.startswith(rest, at)), best)
            cut = path.find("/", at)
            if cut < 0:
                return best
            node, at = node.below.get(path[at:cut]), cut + 1
        return best


_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def host_and_path(url: str | None) -> tuple[str, str]:
    """The host with A-Z lower-cased, and the path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cuts = [i for i in (rest.find("?"), rest.find("#")) if i >= 0]
    rest = rest[: min(cuts)] if cuts else rest
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null where none fits) and ``verdict``.

    A url that is null or has no ``://`` has an empty host and path, fits no rule and gets the default verdict. A new
    column whose name ``pages`` has already gets a trailing underscore. Empty tables stay empty; repeated rows stay.
    """
    trie = pages.sparkSession.sparkContext.broadcast(RuleTrie(list(rules)))
    names = [free_name(pages, n) for n in ("host", "path", "rule", "verdict")]
    schema = StructType([*pages.schema, *(StructField(n, StringType()) for n in names)])
    url = pages.columns.index("url")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for batch in batches:
            parts = [host_and_path(u) for u in batch.column(url).to_pylist()]
            found = [find(*part) or (None, default) for part in parts]
            columns = [*zip(*parts)] + [*zip(*found)] if parts else [[]] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.string()) for c in columns)], names=schema.names)

    return pages.mapInArrow(judge, schema)
