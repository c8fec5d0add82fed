"""Fill-in-middle: each text is cut into prefix, middle and suffix, and its parts change places between marks.

Cuts are drawn in code points and made in bytes. A batch of texts is one byte array; its sparse exception index holds,
of the multibyte characters alone, the place in code points and the bytes beyond the first, summed. A place in code
points becomes one in bytes by adding the excess of the exceptions before it, found by ``searchsorted``; between two
exceptions, where all is ASCII, that is plain arithmetic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tracefork.llm.tables import free_name
from tracefork.llm.words import slices, texts

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Texts of one array, in bytes; a longer text stands alone.
SLICE = 16_000_000
#: Of 100 texts, so many are transformed, and of 100 of these so many start with the suffix.
SHARE, SPM_SHARE = 90, 20
SEED = 1


class ExceptionIndex:
    """Places of characters in a batch of UTF-8 texts.

    ``chars`` is the number of code points before each text (and after the last), ``bytes`` the same in bytes;
    ``places`` are the code points, over the whole batch, that have more than one byte, ``excess`` the extra bytes up to
    and with each of them.
    """

    def __init__(self, raws: list[bytes]):
        self.bytes = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))))
        data = np.frombuffer(b"".join(raws), np.uint8)
        high = np.flatnonzero(data >= 0x80)
        lead = data[high] >= 0xC0
        at = np.flatnonzero(lead)  # a character's bytes stand together, so the next lead tells how many there are
        extra = np.diff(np.append(at, len(high))) - 1
        self.excess = np.concatenate(([0], np.cumsum(extra)))
        self.places = high[at] - self.excess[:-1]
        cut = np.searchsorted(high[at], self.bytes)
        self.chars = self.bytes - self.excess[cut]

    def to_bytes(self, places: np.ndarray) -> np.ndarray:
        """Byte places of code-point places, both counted over the batch."""
        return places + self.excess[np.searchsorted(self.places, places)]


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four whole numbers below 2^32 that only the seed and the id decide."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def arranged(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    """The parts between marks, prefix first (psm) or suffix first (spm)."""
    if form == "psm":
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def restored(form: str, output: bytes) -> bytes:
    """The text again. Texts that hold a mark stay plain, so the first mark of each kind is the one that was set."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    first_part, rest = output[3:].split(second, 1)
    second_part, middle = rest.split(MIDDLE, 1)
    return first_part + middle + second_part if form == "psm" else second_part + middle + first_part


def transformed(ids: list[int | None], raws: list[bytes], seed: int, share: int, spm_share: int) -> list[list]:
    """Per text: code points, form, code points of prefix and middle (None where plain), output."""
    index = ExceptionIndex(raws)
    start, count = index.chars[:-1], np.diff(index.chars)
    drawn = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
    a, b = drawn[:, 0] % (count + 1), drawn[:, 1] % (count + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    first, second = (index.to_bytes(start + cut) - index.bytes[:-1] for cut in (low, high))
    plain = (count == 0) | (drawn[:, 2] % 100 >= share)
    spm = drawn[:, 3] % 100 < spm_share
    forms, outputs = [], []
    for raw, p, q, left, suffix_first in zip(raws, first.tolist(), second.tolist(), plain.tolist(), spm.tolist()):
        form = "plain" if left or any(mark in raw for mark in (PREFIX, SUFFIX, MIDDLE)) else "spm" if suffix_first else "psm"
        forms.append(form)
        outputs.append(raw if form == "plain" else arranged(form, raw[:p], raw[p:q], raw[q:]))
    told = [form != "plain" for form in forms]
    sizes = [[v if t else None for v, t in zip(x.tolist(), told)] for x in (low, high - low)]
    return [count.tolist(), forms, *sizes, outputs]


NEW = ("fim_chars", "fim_form", "fim_prefix", "fim_middle", "fim_text")


def fill_in_middle(docs: DataFrame, seed: int = SEED, share: int = SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """``docs`` with ``fim_chars`` (code points of ``text``), ``fim_form`` (psm, spm or plain), ``fim_prefix`` and
    ``fim_middle`` (code points of these parts, null where plain) and ``fim_text`` (the output).

    The seed and ``doc_id`` alone decide the draws, so rows that repeat an id are cut at like places; a null id draws
    as the empty string. A null text is the empty text, and empty texts and those that hold a mark are plain. Texts are
    taken whole, whatever their length. Other columns stay as they are; the new names get a trailing underscore where
    ``docs`` has them. An empty table gives no rows.
    """
    names = new_names(docs)
    kinds = (LongType(), StringType(), LongType(), LongType(), StringType())
    schema = StructType([*docs.schema, *(StructField(n, k) for n, k in zip(names, kinds))])
    ids, read = docs.columns.index("doc_id"), docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, read, SLICE):
                out = transformed(some.column(ids).to_pylist(), texts(some.column(read)), seed, share, spm_share)
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                fresh = [pa.array(v, t) for v, t in zip(out, types)]
                fresh[-1] = fresh[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([*some.columns, *fresh], names=schema.names)

    return docs.mapInArrow(scan, schema)


def new_names(docs: DataFrame) -> list[str]:
    """Names of the new columns that are free in ``docs``, in the order of ``NEW``."""
    return [free_name(docs, n) for n in NEW]


def restore(made: DataFrame, form: str = "fim_form", text: str = "fim_text") -> DataFrame:
    """``made`` with ``fim_restored``: the text that the output and its form alone give back. Null outputs stay null."""
    name = free_name(made, "fim_restored")
    schema = StructType([*made.schema, StructField(name, StringType())])
    at = [made.columns.index(c) for c in (form, text)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, at[1], SLICE):
                forms, outputs = some.column(at[0]).to_pylist(), some.column(at[1]).cast(pa.binary()).to_pylist()
                back = [None if o is None else restored(f, o) for f, o in zip(forms, outputs)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(back, pa.binary()).cast(pa.string())], names=schema.names)

    return made.mapInArrow(scan, schema)


def fim_digest(docs: DataFrame) -> DataFrame:
    """Per document: code points, form, sizes of prefix and middle, digests of the output and of the restored text."""
    made = fill_in_middle(docs.select("doc_id", "text"))
    back = restore(made.drop("text"))
    digest = lambda c: F.sha2(F.col(c).cast(BinaryType()), 256)
    return back.select(
        "doc_id",
        F.col("fim_chars").alias("n"),
        F.col("fim_form").alias("form"),
        F.col("fim_prefix").alias("prefix_chars"),
        F.col("fim_middle").alias("middle_chars"),
        digest("fim_text").alias("output_sha256"),
        digest("fim_restored").alias("restored_sha256"),
    )


FIM_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
  FROM documents
),
numbers AS (
  SELECT doc_id, t, n, CAST('0x' || d[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || d[9:16] AS BIGINT) % (n + 1) AS b,
         CAST('0x' || d[17:24] AS BIGINT) % 100 AS c, CAST('0x' || d[25:32] AS BIGINT) % 100 AS e
  FROM drawn
),
cut AS (
  SELECT doc_id, t, n, least(a, b) AS p, greatest(a, b) AS q,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain'
              WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN p END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
       sha256(CASE form
         WHEN 'plain' THEN t
         WHEN 'psm' THEN '<P>' || substr(t, 1, p) || '<S>' || substr(t, q + 1) || '<M>' || substr(t, p + 1, q - p)
         ELSE '<S>' || substr(t, q + 1) || '<P>' || substr(t, 1, p) || '<M>' || substr(t, p + 1, q - p) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""
