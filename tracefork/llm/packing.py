"""Best-fit packing of tokenised documents into sequences of a fixed length, in bulk-synchronous rounds.

Documents and gaps are held in order of size. Lengths are whole numbers up to the sequence length, so the sorted order
is a list of runs (all pieces of one length, all gaps of one size), at most ``capacity`` of each whatever the input.
A round sweeps both lists: each run of pieces, longest first, claims its successor among the gaps, a gap takes at most
one piece a round, and where several claim it the rank decides: pieces by (length, place in their run), gaps by
(size, sequence). The gaps are updated after the sweep, and the rounds repeat. What is left when no piece fits opens
new sequences. Places inside a run are numbered on the executors, so only the run lengths reach the driver.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tracefork.llm.tables import settle

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the pre-token pattern of the vocabulary.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as PRE_TOKENS has it. In a run of about a million of it tiktoken's matcher fails, so runs from LONG_RUN
#: on are cut out before.
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
LONG_RUN = 100_000
#: Pieces of one length that one task numbers.
NUMBERED = 2_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Encoder:
    """Ids of whole texts by the byte-level vocabulary of a tokenizer file.

    The merges of such a file are ranked by their ids, so the ids are those of the file's own library; tiktoken is
    what computes them, for it is several times faster on the same texts. With ``added`` the file's added tokens are
    recognised inside texts, as the library does unless told otherwise; without, they are text like any other (the
    library's ``encode_special_tokens``).
    """

    def __init__(self, path: str, added: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary, tokens = content["model"]["vocab"], {t["content"]: t["id"] for t in content["added_tokens"]}
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        spelled = {chr(b): b for b in printable}  # a byte is spelled as itself, or from 256 on if it can't be printed
        spelled.update((chr(256 + i), b) for i, b in enumerate(b for b in range(256) if b not in printable))
        ranks = {bytes(map(spelled.__getitem__, token)): i for token, i in vocabulary.items() if token not in tokens}
        self.added = tuple(tokens) if added else ()
        special = tokens if added else {}
        self.encoding = tiktoken.Encoding("texts", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of the text and then the end id."""
        return np.concatenate([*self.coded(text or ""), [END_ID]]).astype("<u4")

    def coded(self, text: str) -> Iterator[np.ndarray]:
        """Ids of the parts of a text. A long run of white space is one pre-token and is coded by itself; its last
        character, if more text follows that is no added token, belongs to the next one."""
        at, options = 0, {"allowed_special": set(self.added), "disallowed_special": ()}
        for run in WHITE.finditer(text) if len(text) >= LONG_RUN else ():
            if run.end() - run.start() >= LONG_RUN:
                end = run.end() - (run.end() < len(text) and not text.startswith(self.added, run.end()))
                yield self.encoding.encode_to_numpy(text[at : run.start()], **options)
                yield np.array(self.encoding._encode_single_piece(text[run.start() : end]), "<u4")
                at = end
        yield self.encoding.encode_to_numpy(text[at:], **options)


PIECES = [("piece", IntegerType()), ("start", LongType()), ("length", LongType()), ("ids_crc32", LongType())]


def token_pieces(
    docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, keep_ids: bool = False, added: bool = False
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, with ``keep_ids``, the ids themselves.

    A null text is empty and has the end id alone. A document of over ``capacity`` ids is cut into whole pieces from
    its end, so only its first piece may be shorter. Repeated rows and null ids are documents of their own. ``added``
    is the encoder's.
    """
    file = path or vocabulary_path()
    fields = [docs.schema["doc_id"], *(StructField(n, t) for n, t in PIECES)]
    if keep_ids:
        fields += StructType.fromDDL("ids array<int>").fields
    schema = StructType(fields)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(file, added)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                rows: list[tuple] = []
                for doc, ids in zip(some.column(0).to_pylist(), map(encoder.ids, some.column(1).to_pylist())):
                    first = len(ids) % capacity or min(len(ids), capacity)
                    for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                        own = ids[start : start + (capacity if piece else first)]
                        rows.append((doc, piece, start, len(own), zlib.crc32(own.tobytes()), own.tolist() if keep_ids else None))
                columns = list(zip(*rows))[: len(fields)]
                types = [some.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(pieces, schema)


def sweep_rounds(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """The rounds over runs: (length, first place in its run, number, first sequence, offset) for every match.

    ``counts`` has the number of pieces of each length, 1 to ``capacity``.
    """
    left = {length: n for length, n in counts.items() if n}
    placed = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs of sequences (first, number)
    matches: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(length: int, sequence: int, n: int, size: int, into: dict[int, list[tuple[int, int]]]) -> None:
        matches.append((length, placed[length], n, sequence, capacity - size))
        placed[length] += n
        left[length] -= n
        if size > length:
            into.setdefault(size - length, []).append((sequence, n))

    def open_for(length: int, n: int) -> None:
        nonlocal opened
        put(length, opened, n, capacity, gaps)
        opened += n

    for length in sorted((x for x in left if 2 * x > capacity), reverse=True):  # no two of these share a sequence
        open_for(length, left[length])
    while any(left.values()):
        updated: dict[int, list[tuple[int, int]]] = {}
        sizes, moved = sorted(gaps), False
        for length in sorted((x for x in left if left[x]), reverse=True):
            at = bisect_left(sizes, length)
            while left[length] and at < len(sizes):
                size = sizes[at]
                if not gaps[size]:
                    at += 1
                    continue
                sequence, n = gaps[size].pop()
                taken = min(n, left[length])
                if n > taken:
                    gaps[size].append((sequence + taken, n - taken))
                put(length, sequence, taken, size, updated)
                moved = True
        for size, runs in updated.items():
            gaps.setdefault(size, []).extend(runs)
        gaps = {size: joined(runs) for size, runs in gaps.items() if runs}
        if not moved:
            need = -(-sum(x * n for x, n in left.items()) // capacity)
            for length in sorted((x for x in left if left[x]), reverse=True):
                n = min(need, left[length])
                if n:
                    open_for(length, n)
                    need -= n
    return matches


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Neighbouring runs of sequences joined; the smallest sequence last, where it is taken first."""
    out: list[tuple[int, int]] = []
    for first, n in sorted(runs):
        if out and sum(out[-1]) == first:
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append((first, n))
    return out[::-1]


def run_places(pieces: DataFrame, order: list[str], each: int = NUMBERED) -> DataFrame:
    """``pieces`` with ``_place``: the place, from 0, of each among those of its length.

    A length is dealt out over buckets of about ``each`` rows; the rows before a bucket are a running sum of counts.
    """
    sizes = pieces.groupBy("length").agg(F.ceil(F.count("*") / each).alias("_buckets"))
    dealt = pieces.join(F.broadcast(sizes), "length").withColumn("_bucket", F.pmod(F.xxhash64(*order), F.col("_buckets")))
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("length", "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )
    place = F.row_number().over(W.partitionBy("length", "_bucket").orderBy(*order)) - 1
    return (
        dealt.withColumn("_place", place)
        .join(offsets.select("length", "_bucket", "_before"), ["length", "_bucket"])
        .withColumn("_place", (F.col("_place") + F.col("_before")).cast("bigint"))
        .drop("_bucket", "_buckets", "_before")
    )


def placer(matches: list[tuple[int, int, int, int, int]]) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """From (length, place) to (sequence, offset)."""
    table = np.array(sorted(matches), np.int64).reshape(-1, 5)
    keys = table[:, 0] * (1 << 48) + table[:, 1]

    def find(length: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = table[np.searchsorted(keys, length * (1 << 48) + place, side="right") - 1]
        return row[:, 3] + place - row[:, 1], row[:, 4]

    return find


def pack(
    docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, keep_ids: bool = False, added: bool = False
) -> DataFrame:
    """Every piece of every document with ``sequence_id`` and ``offset``; offsets fill each sequence from 0 without gaps.

    Empty tables give no rows. Pieces with equal columns are told apart by their number only. ``added`` is the
    encoder's.
    """
    pieces = settle(token_pieces(docs, capacity, path, keep_ids, added))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    matches = docs.sparkSession.sparkContext.broadcast(np.array(sweep_rounds(counts, capacity), np.int64).reshape(-1, 5))
    order = ["doc_id", "piece", "start", "ids_crc32"]
    ranked = run_places(pieces, order)
    schema = StructType([*pieces.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    ranked = ranked.select(*pieces.columns, "_place")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = placer(matches.value.tolist())
        for batch in batches:
            length, own = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "_place"))
            sequence, offset = find(length, own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(place, schema)
