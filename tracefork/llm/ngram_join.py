"""N-gram Jaccard join by universe partitions: sets of five-word shingles that are alike by at least 0.8.

Two such sets r, s with |r| <= |s| differ in at most |r| / 4 shingles. The universe of shingle hashes is cut into
segments, more than that number of which hold shingles of r, so at least one non-empty segment is the same in both.
Segments depend on a band of sizes; a set is indexed in its own band and, if it can have a smaller partner there, in
the band below. For each band the cheapest of three allocations is taken: single shingles, segments as a whole, or half
as many segments each with its one-deletion neighbourhood. A set with too few non-empty segments for the argument
(``thin``) sends its whole band back to single shingles, which need no argument.

Sets that share a segment are candidates. How many of a candidate's shingles any other candidate has bounds its
similarity to all of them, so most fall away before a pair is compared. What is left is compared exactly: first with
the set that shares most segments, then across the groups that this has made. There a set travels as a bitmap of its
shingles, to blocks of sets of about its size alone; two bitmaps differ in no more places than their sets in shingles,
so a pair whose bitmaps differ too much is out, and the few others are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tracefork.llm.blocks import by_bucket, joined, pack_ids, pack_small, pack_sorted, runs_of, unpack_ids, unpack_small, unpack_sorted
from tracefork.llm.components import components
from tracefork.llm.hashing import mixed
from tracefork.llm.tables import free_name, parts_for, settle, text_bytes
from tracefork.llm.words import slices, spaced_words, texts
from tracefork.session import small_side

WORDS = 5
#: Similarity is at least NUM / DEN.
NUM, DEN = 80, 100
#: Bands of sizes grow by this factor.
BAND = 1.6
#: Bytes of text in one slice, and for one bucket of segments or shingles.
SLICE, BUCKET = 4_000_000, 8_000_000
#: Sets that one task compares with a hub, sets of one block, and columns of the matrices of common bits.
HUB_SETS, BLOCK_SETS, COLUMNS = 1_000, 700, 4_096
#: Bits of a bitmap for each shingle, at least.
BITS = 4
#: Bits of a key that its bucket does not tell.
LOW = 40
#: Rows of a few numbers that may be shared with all tasks at once.
SHARED_ROWS = 1_000_000
#: What the allocation assumes: the share of shingles that some other text has, and a false candidate's cost in keys.
SHARED, CANDIDATE = 0.2, 4.0


def shingle_sets(texts_: list[bytes]) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, sorted; a text of fewer words is one shingle, without words none."""
    words = [spaced_words(t) for t in texts_]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((xxhash.xxh3_64_intdigest(w) for own in words for w in own), np.uint64, int(counts.sum()))
    acc = np.zeros(max(len(flat) - WORDS + 1, 0), np.uint64)
    for j in range(WORDS):
        acc = mixed(acc ^ flat[j : j + len(acc)]) if j else mixed(flat[: len(acc)])
    out, at = [], 0
    for n in counts.tolist():
        if n >= WORDS:
            own = np.sort(acc[at : at + n - WORDS + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif n:
            short = np.zeros(1, np.uint64)
            for word in flat[at : at + n]:
                short = mixed(short ^ word) + np.uint64(n)
            out.append(short)
        else:
            out.append(np.array([], np.uint64))
        at += n
    return out


def most_apart(n: int) -> int:
    """Most shingles by which a set of ``n`` differs from a larger one that is alike enough."""
    return n * (DEN - NUM) // NUM


@cache
def band_start(band: int) -> int:
    return 1 if band == 0 else max(band_start(band - 1) + 1, math.ceil(band_start(band - 1) * BAND))


@cache
def band_of(n: int) -> int:
    band = 0
    while band_start(band + 1) <= n:
        band += 1
    return band


def enough(m: int, n: int, least: int, need: int) -> bool:
    """Whether a set of ``n``, dealt to ``m`` segments, is all but sure to have ``need`` with ``least`` shingles or more."""
    mean = n / m
    short = math.exp(-mean) * (1 if least == 1 else 1 + mean)
    return m * (1 - short) - 6 * math.sqrt(m * short) >= need


@cache
def allocation(band: int) -> tuple[str, int]:
    """The cheapest allocation of a band: its kind and number of segments."""
    sizes = (band_start(band), band_start(band + 1) - 1)
    options: list[tuple[float, str, int]] = [(sizes[1] * (1 + CANDIDATE * SHARED), "single", 0)]
    for kind, least, share in (("whole", 1, 1), ("deletion", 2, 2)):
        m = 1
        while m < sizes[1] and not all(enough(m, n, least, most_apart(n) // share + 1) for n in sizes):
            m += 1
        if m < sizes[1]:
            keys = m if kind == "whole" else m + sizes[1]
            matched = sizes[1] / m - (kind == "deletion")
            options.append((keys * (1 + CANDIDATE * SHARED**matched), kind, m))
    return min(options)[1:]


def keys_of(tokens: np.ndarray, band: int, single: frozenset[int]) -> tuple[np.ndarray, bool]:
    """(keys of a set in a band, whether the set is too thin there to be the smaller one of a pair)."""
    kind, m = ("single", 0) if band in single else allocation(band)
    salt = np.uint64(band * 3 + {"single": 0, "whole": 1, "deletion": 2}[kind] + 1)
    own = mixed(tokens ^ mixed(np.array([salt]))[0])
    if kind == "single":
        return own, False
    segment = ((tokens >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    starts, run = runs_of(segment)
    place = segment[starts].astype(np.uint64)
    sums = np.add.reduceat(own, starts) if len(own) else own
    if kind == "whole":
        return mixed(sums + mixed(place)), len(starts) <= most_apart(len(tokens))
    sizes = np.diff(np.append(starts, len(tokens)))
    less = (sums[run] - own)[sizes[run] > 1]
    keys = np.concatenate((sums, less)) + mixed(np.concatenate((place, place[run][sizes[run] > 1])))
    return np.unique(mixed(keys)), int((sizes > 1).sum()) <= most_apart(len(tokens)) // 2


def bands_of(n: int) -> list[int]:
    """The band of a size, and the one below if a smaller partner can be in it."""
    band = band_of(n)
    below = band and -(-n * NUM // DEN) < band_start(band)
    return [band, band - 1] if below else [band]


def row_names() -> tuple[Column, Column]:
    """The id, or for rows without one a number above all ids; a hash of the text."""
    text = F.xxhash64("text")
    return F.coalesce(F.col("doc_id"), F.lit(1 << 62) + F.pmod(text, F.lit(1 << 61))).cast("bigint"), text


def named(docs: DataFrame) -> DataFrame:
    """(``_id``, ``_hash``, ``_text``) of every row."""
    ident, text = row_names()
    return docs.select(ident.alias("_id"), text.alias("_hash"), F.col("text").alias("_text"))


MEMBERS = StructType([StructField(n, LongType()) for n in ("_id", "_hash", "n", "high", "low")])
KEYED = StructType([StructField("bucket", LongType()), StructField("keys", BinaryType()), StructField("ids", BinaryType()), StructField("sizes", BinaryType())])
SHARED_KEYS = StructType([StructField("key", LongType()), StructField("id", LongType()), StructField("n", LongType())])
COUNTS = StructType([StructField("id", LongType()), StructField("o", LongType())])
PARTIAL = StructType([StructField("part", LongType()), StructField("ids", BinaryType()), StructField("counts", BinaryType())])
SETS = StructType([StructField("id", LongType()), StructField("tokens", BinaryType())])


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and two hashes of each set."""
    for batch in batches:
        for some in slices(batch, 2, SLICE):
            sets = shingle_sets(texts(some.column(2)))
            high = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).astype(np.int64)
            low = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64).astype(np.int64)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *map(pa.array, (n, high, low))], names=MEMBERS.names)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys % np.uint64(buckets)).astype(np.int64)


def short_keys(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Keys as the number of their bucket before their last ``LOW`` bits. Keys that become equal by that make candidates
    only, and those are compared exactly."""
    low = np.uint64(LOW)
    return (keys >> low) % np.uint64(buckets) << low | keys & np.uint64((1 << LOW) - 1)


def pack_low(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : LOW // 8].tobytes()


def unpack_low(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) * 8 // LOW, 8), np.uint8)
    out[:, : LOW // 8] = np.frombuffer(data, np.uint8).reshape(-1, LOW // 8)
    return out.view("<u8").ravel()


def shared_runs(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by key and id, starts of the runs of equal keys, whether each run has several ids)."""
    order = np.lexsort((ids, keys))
    k, i = keys[order], ids[order]
    starts, run = runs_of(k)
    several = np.zeros(len(starts), bool)
    several[run[i != i[starts][run]]] = True
    return order, starts, several


def dealt(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows for the buckets: of each key the first entry, and under numbers below 0, spread evenly, all entries of keys
    that several ids have already."""
    keys = short_keys(keys, buckets)
    order, starts, several = shared_runs(keys, ids)
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    known = order[several[run]]
    known = known[np.argsort(ids[known], kind="stable")]
    for bucket, at in by_bucket(bucket_of(mixed(ids[known].astype(np.uint64)), buckets)) if len(known) else ():
        at = known[at]
        yield -1 - bucket, keys[at].tobytes(), pack_sorted(ids[at]), pack_small(sizes[at])
    first = order[starts]
    first = first[np.argsort(ids[first], kind="stable")]
    for bucket, at in by_bucket((keys[first] >> np.uint64(LOW)).astype(np.int64)) if len(first) else ():
        at = first[at]
        yield bucket, pack_low(keys[at]), pack_sorted(ids[at]), pack_small(sizes[at])


def table_of(schema: StructType, rows: list[tuple]) -> pa.Table:
    kinds = {LongType(): pa.int64(), BinaryType(): pa.binary()}
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.table({f.name: pa.array(c, kinds[f.dataType]) for f, c in zip(schema, columns)})


def index(buckets: int, single: frozenset[int]):
    """Keys of every set, dealt to buckets. Thin sets report their band under a key of size -1."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 2, SLICE):
                ids, keys, owners, thin = some.column(0).to_numpy(), [], [], set()
                sets = shingle_sets(texts(some.column(2)))
                for place, tokens in enumerate(sets):
                    for band in bands_of(len(tokens)) if len(tokens) > 3 else ():
                        own, is_thin = keys_of(tokens, band, single)
                        keys.append(own)
                        owners.append((place, len(own)))
                        if is_thin and band == band_of(len(tokens)):
                            thin.add(band)
                which, many = (np.array([o[i] for o in owners], np.int64) for i in range(2))
                of = np.repeat(which, many)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                rows = list(dealt(joined(keys, "u8"), ids[of], n[of], buckets))
                rows += [(-1 - band, b"", b"", np.array([-1 - band], np.int32).tobytes()) for band in thin]
                yield from table_of(KEYED, rows).to_batches()

    return scan


def gathered(table: pa.Table, keys_in: Callable, sizes_in: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, ids, sizes) of the entries of all rows; a row's sizes are read knowing how many they are."""
    columns = [table.column(c).to_pylist() for c in ("keys", "ids", "sizes")]
    full = [(keys_in(k), unpack_sorted(i), s) for k, i, s in zip(*columns) if i]
    keys, ids = joined([k for k, _, _ in full], "u8").astype(np.uint64), joined([i for _, i, _ in full], "i8")
    return keys, ids, joined([sizes_in(s, len(i)) for _, i, s in full], "u8").astype(np.int64)


def counted(sizes: bytes, n: int) -> np.ndarray:
    return unpack_small(sizes)


def shared_keys(key: tuple, table: pa.Table) -> pa.Table:
    """The entries of a bucket whose key several ids have."""
    bucket = key[0].as_py()
    if bucket >= 0:
        low, ids, sizes = gathered(table, unpack_low, counted)
        keys = low | np.uint64(bucket << LOW)
        order, starts, several = shared_runs(keys, ids)
        keep = order[np.repeat(several, np.diff(np.append(starts, len(order))))]
        keys, ids, sizes = keys[keep], ids[keep], sizes[keep]
    else:
        keys, ids, sizes = gathered(table, lambda k: np.frombuffer(k, np.uint64), counted)
    thin = [np.frombuffer(s, np.int32)[0] for i, s in zip(table.column("ids").to_pylist(), table.column("sizes").to_pylist()) if not i]
    extra = np.array(thin, np.int64)
    return pa.table({"key": np.concatenate((keys.astype(np.int64), extra)), "id": np.concatenate((ids, extra)), "n": np.concatenate((sizes, extra))})


def token_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in slices(batch, 2, SLICE):
            tokens = [s.tobytes() for s in shingle_sets(texts(some.column(2)))]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(tokens, pa.binary())], names=SETS.names)


def token_rows(buckets: int):
    """Shingles of the candidates, dealt to buckets; 32 bits and the bucket stand for a shingle, so a count of shared
    ones may be too high, never too low. A first entry whose shingle is known to be shared has its bit unset, for it is
    counted with the known ones."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 2, SLICE):
                sets = shingle_sets(texts(some.column(2)))
                ids = np.repeat(some.column(0).to_numpy(), [len(s) for s in sets])
                tokens = joined(sets, "u8")
                order, starts, several = shared_runs(tokens, ids)
                run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
                rows = []
                known, n = np.unique(ids[order[several[run]]], return_counts=True)
                for bucket, own in by_bucket(bucket_of(mixed(known.astype(np.uint64)), buckets)) if len(known) else ():
                    rows.append((-1 - bucket, b"", pack_sorted(known[own]), pack_small(n[own])))
                by_id = np.argsort(ids[order[starts]], kind="stable")
                first, fresh = order[starts][by_id], ~several[by_id]
                for bucket, own in by_bucket(bucket_of(tokens[first] >> np.uint64(LOW), buckets)) if len(first) else ():
                    at = first[own]
                    rows.append((bucket, tokens[at].astype(np.uint32).tobytes(), pack_sorted(ids[at]), np.packbits(fresh[own]).tobytes()))
                yield from table_of(KEYED, rows).to_batches()

    return scan


def flags_in(sizes: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(sizes, np.uint8), count=n)


def shared_counts(parts: int):
    """How many shingles of each id other ids have too, as far as a bucket tells: packed rows, dealt to ``parts`` by id."""

    def count(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        keys, ids, sizes = gathered(table, lambda k: np.frombuffer(k, np.uint32), flags_in if bucket >= 0 else counted)
        if bucket >= 0:
            order, starts, several = shared_runs(keys, ids)
            run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
            lone = sizes[order] == 0
            alone = np.ones(len(starts), bool)
            alone[run[lone]] = False  # shared inside a slice
            keep = order[(several | ~alone)[run] & ~lone]
            ids, sizes = np.unique(ids[keep], return_counts=True)
        dealt = by_bucket(bucket_of(mixed(ids.astype(np.uint64)), parts)) if len(ids) else ()
        return table_of(PARTIAL, [(part, pack_ids(ids[at]), sizes[at].astype(np.int32).tobytes()) for part, at in dealt])

    return count


def summed_counts(table: pa.Table) -> pa.Table:
    """The counts of all buckets for the ids of one part."""
    ids = joined([unpack_ids(i) for i in table.column("ids").to_pylist()], "i8")
    counts = joined([np.frombuffer(c, np.int32) for c in table.column("counts").to_pylist()], "i4")
    known, at = np.unique(ids, return_inverse=True)
    return pa.table({"id": known, "o": np.bincount(at, counts, len(known)).astype(np.int64)})


def close(n: Column, m: Column, o: Column) -> Column:
    """Whether sets of sizes ``n`` and ``m`` with at most ``o`` common shingles can be alike enough."""
    return o * (DEN + NUM) >= (n + m) * NUM


def alike(common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return common * (DEN + NUM) >= (n + m) * NUM


LINKS = StructType([StructField("a", LongType()), StructField("b", LongType())])


def compare_with_hub(key: tuple, table: pa.Table) -> pa.Table:
    """Links of a hub with some of the sets that were told to try it, by exact comparison."""
    hub, ids = key[0].as_py(), table.column("id").to_numpy()
    sets = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
    centres = [s for s, i in zip(sets, ids) if i == hub]
    linked = []
    for own, i in zip(sets, ids.tolist()):
        for centre in centres if i != hub else ():
            at = np.minimum(np.searchsorted(centre, own), len(centre) - 1)
            if alike((centre[at] == own).sum(), np.int64(len(own)), np.int64(len(centre))):
                linked.append(i)
                break
    return pa.table({"a": pa.array(linked, pa.int64()), "b": pa.array([hub] * len(linked), pa.int64())})


def hub_links(best: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among the pairs (``a``, ``b``), b the hub; the sets of a hub with many are dealt to several tasks, each of
    which also gets the hub's own."""
    many = F.ceil(F.count("*") / HUB_SETS).cast("int")
    hubs = best.groupBy("b").agg(many.alias("salts")).select(F.col("b").alias("hub"), "salts")
    told = best.join(small_side(hubs, SHARED_ROWS), best.b == F.col("hub"))
    tries = told.select(F.col("a").alias("id"), "hub", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    own = hubs.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = sets.join(small_side(tries.unionByName(own), SHARED_ROWS), "id")
    return rows.groupBy("hub", "salt").applyInArrow(compare_with_hub, LINKS)


@cache
def class_start(number: int) -> int:
    """The smallest size of a class: sets that are alike enough are in one class or in neighbours."""
    return 1 if number == 0 else class_start(number - 1) * DEN // NUM + 1


@cache
def class_of(n: int) -> int:
    number = 0
    while class_start(number + 1) <= n:
        number += 1
    return number


MARKED = StructType([*(StructField(n, LongType()) for n in ("id", "c", "cluster", "n", "class")), StructField("bits", BinaryType())])


def bitmap(tokens: np.ndarray) -> bytes:
    """The places that the shingles' last bits name; the length is a power of two."""
    width = max(64, 1 << (BITS * len(tokens) - 1).bit_length())
    out = np.zeros(width, bool)
    out[(tokens & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes, classes and bitmaps of sets (``id``, ``c``, ``cluster``, ``tokens``)."""
    for batch in batches:
        sets = [np.frombuffer(t, np.uint64) for t in batch.column(3).to_pylist()]
        n = [len(s) for s in sets]
        added = [pa.array(n, pa.int64()), pa.array([class_of(x) for x in n], pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *added], names=MARKED.names)


def compare_blocks(key: tuple, table: pa.Table) -> pa.Table:
    """Pairs across components between two blocks of one cluster (or inside one block) whose bitmaps differ in no more
    places than sets that are alike enough do in shingles."""
    _, lower, i, up, j = (k.as_py() for k in key)
    ids, comp, n, size_class, block = (table.column(c).to_numpy() for c in ("id", "c", "n", "class", "block"))
    maps = [np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()]
    width = min(map(len, maps))
    folded = np.stack([np.bitwise_or.reduce(m.reshape(-1, width)) for m in maps])
    left, right = np.flatnonzero((size_class == lower) & (block == i)), np.flatnonzero((size_class == lower + up) & (block == j))
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, width, COLUMNS // 8):
        x, y = (np.unpackbits(folded[rows, at : at + COLUMNS // 8], axis=1).astype(np.float32) for rows in (left, right))
        common += x @ y.T
    ones = np.bitwise_count(folded).sum(axis=1, dtype=np.int64)
    apart = ones[left][:, None] + ones[right][None, :] - 2 * common.astype(np.int64)
    both = n[left][:, None] + n[right][None, :]
    least = np.minimum(n[left][:, None], n[right][None, :])
    found = (comp[left][:, None] != comp[right][None, :]) & alike(np.minimum((both - apart) // 2, least), both, 0)
    if not up and i == j:
        found = np.triu(found, 1)
    x, y = np.nonzero(found)
    return pa.table({"a": ids[left][x], "b": ids[right][y]})


def block_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) across components among the members (``id``, ``c``) of each ``cluster`` that may be alike. The
    sets of a cluster and a class of sizes are cut into blocks, and every pair of blocks of one class or of neighbours
    is one task, so no task grows with the cluster."""
    told = sets.join(small_side(members, SHARED_ROWS), "id").select("id", "c", "cluster", "tokens")
    rows = settle(lambda: told.mapInArrow(marked, MARKED))
    blocks = rows.groupBy("cluster", "class").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("blocks"))
    blocks = settle(blocks)
    for name, shift in (("blocks", 0), ("above", 1), ("below", -1)):
        side = blocks.select("cluster", (F.col("class") - shift).alias("class"), F.col("blocks").alias(name))
        rows = rows.join(small_side(side, SHARED_ROWS), ["cluster", "class"], "left")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    own, lower = F.col("block"), F.col("class")

    def meets(count: str, pair: Callable[[Column], tuple[Column, Column, int, Column]]) -> Column:
        each = lambda o: F.struct(*(F.lit(v).cast("long").alias(n) for n, v in zip(("lower", "i", "up", "j"), pair(o))))
        some = F.transform(F.sequence(F.lit(0), F.col(count) - 1), each)
        return F.coalesce(F.when(F.col(count) > 0, some), F.array().cast("array<struct<lower:bigint,i:bigint,up:bigint,j:bigint>>"))

    meetings = F.concat(
        meets("blocks", lambda o: (lower, F.least(own, o), 0, F.greatest(own, o))),
        meets("above", lambda o: (lower, own, 1, o)),
        meets("below", lambda o: (lower - 1, o, 1, own)),
    )
    dealt = rows.select("id", "c", "n", "class", "bits", "block", "cluster", F.explode(meetings).alias("at"))
    dealt = dealt.select("id", "c", "n", "class", "bits", "block", "cluster", "at.*")
    return dealt.groupBy("cluster", "lower", "i", "up", "j").applyInArrow(compare_blocks, LINKS).distinct()


def block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across components among the members (``id``, ``c``) of each ``cluster``, by exact comparison of the pairs
    that their bitmaps leave."""
    return hub_links(settle(lambda: block_pairs(members, sets)), sets)


def restricted(df: DataFrame, ids: DataFrame, on: list[str], how: str) -> DataFrame:
    """A semi or anti join; the ids are shared with all tasks only after a count."""
    return df.join(small_side(ids, SHARED_ROWS), on, how)


def candidate_links(rows: DataFrame, total: int, sizes: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) among distinct sets of ``rows`` (``_id``, ``_hash``, ``_text``) that join the same ids as
    all links do. ``sizes`` has ``_id`` and ``n`` of those sets."""
    buckets, single = parts_for(total, BUCKET), frozenset()
    while True:
        shared = settle(
            lambda single=single: rows.mapInArrow(index(buckets, single), KEYED).groupBy("bucket").applyInArrow(shared_keys, SHARED_KEYS)
        )
        thin = {-1 - r.n for r in shared.where("n < 0").select("n").distinct().collect()}  # numbers of bands
        if not thin:
            break
        single |= thin
    active = settle(lambda: shared.select(F.col("id").alias("_id")).distinct())
    size = settle(
        lambda: restricted(sizes, active, ["_id"], "left_semi").groupBy(F.col("_id").alias("id")).agg(F.max("n").alias("m"))
    )

    # An id meets at most as many buckets as it has shingles; parts hold the counts of that many.
    parts = parts_for(12 * (size.agg(F.sum(F.least("m", F.lit(2 * buckets)))).head()[0] or 0), BUCKET)

    def hopes() -> DataFrame:
        tried = restricted(rows, active, ["_id"], "left_semi").mapInArrow(token_rows(buckets), KEYED)
        counted = tried.groupBy("bucket").applyInArrow(shared_counts(parts), PARTIAL)
        common = counted.groupBy("part").applyInArrow(summed_counts, COUNTS).join(size, "id")
        return common.where(F.col("o") * DEN >= F.col("m") * NUM).select("id", "o")

    hopeful = settle(hopes)
    groups = settle(lambda: shared.join(small_side(hopeful, SHARED_ROWS), "id").distinct())

    def best() -> DataFrame:
        hubs = groups.groupBy("key").agg(F.min_by(F.struct("id", "n", "o"), F.struct(-F.col("o"), "id")).alias("hub"))
        tied = groups.join(hubs, "key").where(F.col("id") != F.col("hub.id"))
        able = close(F.col("n"), F.col("hub.n"), F.least("o", "hub.o", "n", "hub.n"))
        shares = tied.where(able).groupBy("id", "hub.id").agg(F.count("*").alias("keys")).toDF("a", "b", "keys")
        return shares.groupBy("a").agg(F.max_by("b", F.struct("keys", -F.col("b"))).alias("b"))

    tries = settle(best)
    kept = hopeful.select(F.col("id").alias("_id"))
    sets = settle(lambda: restricted(rows, kept, ["_id"], "left_semi").mapInArrow(token_sets, SETS))
    links = settle(lambda: hub_links(tries, sets))
    made = components(links)

    def unresolved() -> DataFrame:
        of = groups.join(made, "id", "left").withColumn("c", F.coalesce("component", "id"))
        low = of.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key", "low")
        return of.join(low, "key").select("id", "c", "low").distinct()

    members = settle(unresolved)
    if members.isEmpty():
        return links
    clusters = components(members.select(F.col("c").alias("a"), F.col("low").alias("b")))
    own = members.select("id", "c").distinct().join(clusters.select(F.col("id").alias("c"), F.col("component").alias("cluster")), "c")
    return links.unionByName(settle(lambda: block_links(own, sets)))


def grouped(docs: DataFrame) -> DataFrame:
    """(``_id``, ``_hash``, ``n``, ``component``) of every row, by the names that ``named`` gives."""
    rows = named(docs)
    members = settle(lambda: rows.mapInArrow(measure, MEMBERS))
    same = ["n", "high", "low"]
    first = members.where("n > 0").groupBy(*same).agg(F.min(F.struct("_id", "_hash")).alias("first"), F.count("*").alias("rows"))
    several = first.where("rows > 1").drop("rows")  # sets that stand alone are their own first ones
    itself = F.when(F.col("n") > 0, F.struct("_id", "_hash"))
    known = settle(
        lambda: members.join(small_side(several, SHARED_ROWS), same, "left").withColumn("first", F.coalesce("first", itself))
    )
    copies = known.where("first is not null and (_id, _hash) <> (first._id, first._hash)")
    wordless = known.where("first is null")
    skipped = copies.select("_id", "_hash").unionByName(wordless.select("_id", "_hash")).distinct()
    sizes = known.where("first is not null and (_id, _hash) = (first._id, first._hash)").select("_id", "n")
    links = candidate_links(restricted(rows, skipped, ["_id", "_hash"], "left_anti"), text_bytes(docs), sizes)
    own = copies.select(F.col("_id").alias("a"), F.col("first._id").alias("b")).where("a <> b")
    made = components(links.unionByName(own)).withColumnRenamed("id", "_id")
    out = known.join(made, "_id", "left")
    return out.select("_id", "_hash", "n", F.coalesce("component", "_id").alias("component"))


def similar_documents(docs: DataFrame) -> DataFrame:
    """(``doc_id``, ``n_shingles``, ``component_id``) for each row of ``docs``.

    The component is the smallest id reachable by links. Texts that are null or wordless have no shingles and no links.
    Rows of one id count as one document. A row without id gets its component's smallest id, null if that has none. An
    empty table gives no rows. Other columns are not read.
    """
    known = lambda c: F.when(F.col(c) < F.lit(1 << 62), F.col(c))
    return grouped(docs).select(known("_id").alias("doc_id"), F.col("n").alias("n_shingles"), known("component").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that are similar to a row of a smaller id; of repeated rows one stays."""
    groups = settle(grouped(docs))
    ids, texts_ = free_name(docs, "_id"), free_name(docs, "_hash")
    kept = groups.where("_id = component").groupBy("_id").agg(F.min("_hash").alias("_hash"), F.count("*").alias("rows"))
    kept = settle(kept)
    stays = kept.select("_id", "_hash", F.lit(True).alias("stays"))
    gone = groups.join(stays, ["_id", "_hash"], "left").where("stays is null").select("_id", "_hash").distinct()
    named_ = docs.select("*", *(c.alias(n) for c, n in zip(row_names(), (ids, texts_))))
    rename = lambda d: d.select(F.col("_id").alias(ids), F.col("_hash").alias(texts_))
    left = restricted(named_, rename(gone), [ids, texts_], "left_anti")
    repeated = rename(kept.where("rows > 1"))
    if repeated.isEmpty():
        return left.select(*docs.columns)
    once = restricted(left, repeated, [ids, texts_], "left_anti")
    twice = restricted(left, repeated, [ids, texts_], "left_semi").dropDuplicates([ids, texts_])
    return once.unionByName(twice.select(*once.columns)).select(*docs.columns)
