"""Near duplicates by SetSketch registers: sets of five-word shingles that are alike by at least 0.85.

A register holds the smallest of the random numbers that it gives the shingles of a set, as a whole number on an
exponential scale and cut off at both ends. The numbers of one shingle are a Poisson process over all registers, so only
the points below a set's own limit are made: a number that doesn't grow with the set. The registers of a union are the
larger ones of both (``merged``), and registers of two sets are equal about as often as the sets are alike.

Bands of registers become keys; sets that share a key are candidates. Of each key one set, the one with most company, is
the hub: the others are told to try it, so that a key of any size gives a row for each of its sets and not one for each
pair. Whoever tries first estimates the similarity from the registers by likelihood and, unless that is clearly too low,
compares the sets exactly. A key whose sets are not in one component by then tries another hub; what is still open
after these rounds is compared in blocks of sets of like size.

A pair of exactly 0.85 has no key in common with a chance below 1e-8, and the estimate of such a pair is below the one
that is tried on with a chance of the same order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tracefork.llm.components import components
from tracefork.llm.hashing import mixed
from tracefork.llm.ngram_join import SHARED_ROWS, named, restricted, shingle_sets
from tracefork.llm.tables import settle
from tracefork.llm.words import slices, texts
from tracefork.session import durable, small_side

#: Similarity is at least NUM / DEN.
NUM, DEN = 85, 100
#: Registers of a sketch and of one band; ``SCALE`` steps of the exponential scale are a factor of e.
REGISTERS, BAND = 160, 5
BASE, TOP = 1.001, 65_535
RATE = 20.0
#: An estimate less than this below the threshold is compared exactly (5.5 standard deviations).
MARGIN = 5.5 * math.sqrt(NUM * (DEN - NUM)) / DEN / math.sqrt(REGISTERS)
#: Bytes of text in one slice; sets that one task compares with a hub; sets and bytes of shingles of one block.
SLICE, HUB_SETS, BLOCK_SETS = 4_000_000, 1_000, 500
#: Rounds in which every open key tries a hub.
ROUNDS = 2


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers above 0 and below 1 from the high bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def minima(sets: list[np.ndarray], above: float) -> np.ndarray:
    """The smallest number of each register for each set. Points beyond ln(registers) + ``above``, by a set's size, are
    not made; registers without a point are infinite."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.full(len(sets) * REGISTERS, np.inf)
    owner = np.repeat(np.arange(len(sets)), sizes)
    tokens = np.concatenate(sets) if sets else np.array([], np.uint64)
    limit = ((math.log(REGISTERS) + above) / np.maximum(sizes, 1))[owner]
    state, x = mixed(tokens ^ np.uint64(0x9E3779B97F4A7C15)), np.zeros(len(tokens))
    while len(state):
        state = mixed(state + np.uint64(0x9E3779B97F4A7C15))
        x = x - np.log(uniform(state)) / REGISTERS
        near = x < limit
        state, x, owner, limit = state[near], x[near], owner[near], limit[near]
        register = ((mixed(state) >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(out, owner * REGISTERS + register, x)
    return out.reshape(len(sets), REGISTERS)


def sketches(sets: list[np.ndarray], above: float = 4.0) -> np.ndarray:
    """Registers of each set, in rows: floor(1 - log_b(rate-scaled minimum)), cut to 0 .. TOP. Empty sets have zeros."""
    out = minima(sets, above)
    some = np.array([len(s) > 0 for s in sets], bool)
    while True:
        short = np.flatnonzero(some & np.isinf(out).any(axis=1))
        if not len(short):
            break
        above += 8  # a register that got no point gets one with more of them; what is known stays as it is
        out[short] = minima([sets[i] for i in short], above)
    with np.errstate(divide="ignore"):
        scale = np.floor(1 - np.log(out / RATE) / math.log(BASE))
    return np.where(some[:, None], np.clip(scale, 0, TOP), 0).astype(np.uint16)


def merged(registers: np.ndarray) -> np.ndarray:
    """The registers of the union of the sets in the rows."""
    return registers.max(axis=0)


def cardinality(registers: np.ndarray) -> np.ndarray:
    """Estimated sizes of the sets in the rows, from registers within the scale."""
    mean = (BASE ** -registers.astype(np.float64)).mean(axis=1)
    return np.where(registers.any(axis=1), (1 - 1 / BASE) / (RATE * math.log(BASE) * mean), 0.0)


def likely(more: np.ndarray, less: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of sets of ``n`` and ``m``, of whose registers ``more`` are larger in the first
    and ``less`` in the second one.

    With u = n / (n + m), v = 1 - u and J the similarity, a register is larger in the first set with the chance
    p(u - v J), in the second with p(v - u J), where p(x) = -log_b(1 - x (b - 1) / b). The likelihood has one peak; it
    is found by halving on the sign of its slope.
    """
    n, m = n.astype(np.float64), m.astype(np.float64)
    u, v, same = n / (n + m), m / (n + m), REGISTERS - more - less
    step, log = (BASE - 1) / BASE, math.log(BASE)
    chance = lambda x: -np.log1p(-x * step) / log
    slope = lambda x: step / (log * (1 - x * step))
    low, high = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(30):
        j = (low + high) / 2
        x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        rest = np.maximum(1 - chance(x) - chance(y), 1e-12)
        rises = same * (v * slope(x) + u * slope(y)) / rest - more * v * slope(x) / chance(x) - less * u * slope(y) / chance(y)
        low, high = np.where(rises > 0, j, low), np.where(rises > 0, high, j)
    return (low + high) / 2


def worth_a_try(own: np.ndarray, others: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    """Whether one sketch's set may be similar enough to the sets of others."""
    more, less = (own > others).sum(axis=1), (own < others).sum(axis=1)
    able = (np.minimum(n, m) * DEN >= np.maximum(n, m) * NUM) & (n > 0) & (m > 0)
    out = np.zeros(len(m), bool)
    if able.any():
        sizes = np.full(int(able.sum()), n)
        out[able] = likely(more[able], less[able], sizes, m[able]) >= NUM / DEN - MARGIN
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are alike by NUM / DEN, exactly."""
    if not len(a) or not len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int((b[at] == a).sum())
    return common * DEN >= NUM * (len(a) + len(b) - common)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A key for each band of each sketch."""
    bands = registers.shape[1] // BAND
    words = registers[:, : bands * BAND].reshape(len(registers), bands, BAND).astype(np.uint64)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), (len(registers), bands))
    for i in range(BAND):
        key = mixed(key ^ words[:, :, i])
    return key.astype(np.int64)


MEMBERS = StructType([*(StructField(n, LongType()) for n in ("_id", "_hash", "n", "high", "low")), StructField("keys", BinaryType())])
KEYS = StructType([StructField(n, LongType()) for n in ("key", "id", "n")])
SETS = StructType([StructField("id", LongType()), StructField("tokens", BinaryType()), StructField("registers", BinaryType())])
LINKS = StructType([StructField("a", LongType()), StructField("b", LongType())])


def sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, two hashes and band keys of each set."""
    for batch in batches:
        for some in slices(batch, 2, SLICE):
            sets = shingle_sets(texts(some.column(2)))
            keys = band_keys(sketches(sets))
            high = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).astype(np.int64)
            low = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64).astype(np.int64)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            packed = pa.array([k.tobytes() for k in keys], pa.binary())
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *map(pa.array, (n, high, low)), packed], names=MEMBERS.names)


def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, n) for every band of every set."""
    bands = REGISTERS // BAND
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
        ids, n = (np.repeat(batch.column(i).to_numpy(), bands) for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, ids, n)], names=KEYS.names)


def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles and registers of each set."""
    for batch in batches:
        for some in slices(batch, 2, SLICE):
            sets = shingle_sets(texts(some.column(2)))
            columns = [[x.tobytes() for x in of] for of in (sets, sketches(sets))]
            yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, pa.binary()) for c in columns)], names=SETS.names)


def arrays(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """(ids, sets, registers in rows, set sizes)."""
    sets = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
    registers = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(len(sets), -1)
    return table.column("id").to_numpy(), sets, registers, np.fromiter(map(len, sets), np.int64, len(sets))


def try_hub(key: tuple, table: pa.Table) -> pa.Table:
    """Links of a hub with some of the sets that were told to try it."""
    hub = key[0].as_py()
    ids, sets, registers, n = arrays(table)
    linked = set()
    for centre in np.flatnonzero(ids == hub):  # rows of one id are one document
        for at in np.flatnonzero(worth_a_try(registers[centre], registers, int(n[centre]), n) & (ids != hub)):
            if similar(sets[at], sets[centre]):
                linked.add(int(ids[at]))
    return pa.table({"a": pa.array(sorted(linked), pa.int64()), "b": pa.array([hub] * len(linked), pa.int64())})


def hub_links(tries: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among the pairs (``a``, ``b``), b the hub; a hub with many is dealt to several tasks, which all get its set."""
    hubs = tries.groupBy("b").agg(F.ceil(F.count("*") / HUB_SETS).cast("int").alias("salts")).withColumnRenamed("b", "hub")
    told = tries.join(small_side(hubs, SHARED_ROWS), tries.b == F.col("hub"))
    own = hubs.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    told = told.select(F.col("a").alias("id"), "hub", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    rows = sets.join(small_side(told.unionByName(own), SHARED_ROWS), "id")
    return rows.groupBy("hub", "salt").applyInArrow(try_hub, LINKS)


def able(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can be similar."""
    return F.least(n, m) * DEN >= F.greatest(n, m) * NUM


def compare_blocks(key: tuple, table: pa.Table) -> pa.Table:
    """Links between the two sides of a pair of blocks, as many as join the same components."""
    ids, sets, registers, n = arrays(table)
    comp, side = table.column("c").to_pylist(), np.array(table.column("side").to_pylist())
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    links = []
    right = np.flatnonzero(side != 0)
    for x in np.flatnonzero(side != 1):
        for y in right[worth_a_try(registers[x], registers[right], int(n[x]), n[right])].tolist():
            a, b = top(comp[x]), top(comp[y])
            if a != b and similar(sets[x], sets[y]):
                root[a] = b
                links.append((ids[x], ids[y]))
    return pa.table({name: pa.array([link[at] for link in links], pa.int64()) for at, name in enumerate("ab")})


def block_links(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across components among the sets (``id``, ``n``, ``c``) of each ``key``.

    Sets of a key are sorted into classes by size, so that similar ones are in the same or in neighbouring classes, and a
    class into blocks of bounded size; every pair of blocks that can hold similar sets is one task.
    """
    classed = open_.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / math.log(DEN / NUM)).cast("int"))
    counted = classed.groupBy("key", "size").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("blocks"))
    after = counted.select("key", (F.col("size") - 1).alias("size"), F.col("blocks").alias("above"))
    before = counted.select("key", (F.col("size") + 1).alias("size"), F.col("blocks").alias("below"))
    plan = counted.join(after, ["key", "size"], "left").join(before, ["key", "size"], "left")
    dealt = classed.join(small_side(plan, SHARED_ROWS), ["key", "size"]).withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # A pair of blocks is named by its lower class, its block there, the step to the other class and the block in that.
    inside = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(
            F.col("size").alias("s"), F.least("i", j).alias("x"), F.lit(0).alias("step"), F.greatest("i", j).alias("y"),
            F.when(F.col("i") == j, 2).when(F.col("i") < j, 0).otherwise(1).alias("side"),
        ),
    )
    upward = F.when(F.col("above").isNotNull(), F.transform(
        F.sequence(F.lit(0), F.col("above") - 1),
        lambda j: F.struct(F.col("size").alias("s"), F.col("i").alias("x"), F.lit(1).alias("step"), j.alias("y"), F.lit(0).alias("side")),
    ))
    downward = F.when(F.col("below").isNotNull(), F.transform(
        F.sequence(F.lit(0), F.col("below") - 1),
        lambda j: F.struct((F.col("size") - 1).alias("s"), j.alias("x"), F.lit(1).alias("step"), F.col("i").alias("y"), F.lit(1).alias("side")),
    ))
    pairs = dealt.select("key", "id", "c", F.explode(F.concat(inside, *(F.coalesce(side, F.array()) for side in (upward, downward)))).alias("p"))
    rows = sets.join(small_side(pairs.select("key", "id", "c", "p.*"), SHARED_ROWS), "id")
    return rows.groupBy("key", "s", "x", "step", "y").applyInArrow(compare_blocks, LINKS)


def open_keys(shared: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (``key, id, n, c``) of the keys whose sets are in several components; c is the component so far."""
    made = components(links)
    of = shared.join(restricted_side(made), shared.id == F.col("member"), "left").drop("member")
    of = of.withColumn("c", F.coalesce("component", "id")).drop("component")
    torn = of.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    return restricted(of, torn, ["key"], "left_semi")


def restricted_side(made: DataFrame) -> DataFrame:
    return small_side(made.withColumnRenamed("id", "member"), SHARED_ROWS)


def with_hubs(shared: DataFrame) -> DataFrame:
    """``shared`` with ``hub`` and ``hub_n``: of each key the set that meets most others under all of its keys."""
    counts = shared.groupBy("key").agg(F.count("*").alias("company"))
    score = shared.join(small_side(counts, SHARED_ROWS), "key").groupBy("id").agg(F.sum("company").alias("company"))
    scored = durable(shared.join(small_side(score, SHARED_ROWS), "id"))
    best = scored.groupBy("key").agg(F.max_by(F.struct("id", "n"), F.struct("company", -F.col("id"))).alias("best"))
    best = best.select("key", F.col("best.id").alias("hub"), F.col("best.n").alias("hub_n"))
    return scored.drop("company").join(small_side(best, SHARED_ROWS), "key")


def candidate_links(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) among distinct sets that join the same ids as all links do."""
    keyed = members.select("_id", "n", "keys").mapInArrow(key_rows, KEYS)
    several = keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    shared = settle(lambda: restricted(keyed, several, ["key"], "left_semi").distinct())
    active = shared.select(F.col("id").alias("_id")).distinct()
    sets = settle(lambda: restricted(rows, active, ["_id"], "left_semi").mapInArrow(set_rows, SETS))
    links = None
    for _ in range(ROUNDS):
        hubs = durable(with_hubs(shared))
        others = hubs.where("id <> hub")
        tries = durable(others.where(able(F.col("n"), F.col("hub_n"))).select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct())
        found = settle(lambda tries=tries: hub_links(tries, sets))
        links = found if links is None else links.unionByName(found)
        shared = durable(open_keys(others.select("key", "id", "n"), links))
        if shared.isEmpty():
            return links
        open_, shared = shared, shared.drop("c")
    return links.unionByName(settle(lambda: block_links(open_, sets)))


def grouped(docs: DataFrame) -> DataFrame:
    """(``_id``, ``_hash``, ``n``, ``component``) of every row, by the names that ``named`` gives."""
    rows = named(docs)
    members = durable(rows.mapInArrow(sketch_rows, MEMBERS))
    same = ["n", "high", "low"]
    first = members.where("n > 0").groupBy(*same).agg(F.min(F.struct("_id", "_hash")).alias("first"), F.count("*").alias("rows"))
    several = first.where("rows > 1").drop("rows")
    itself = F.when(F.col("n") > 0, F.struct("_id", "_hash"))
    known = settle(lambda: members.join(small_side(several, SHARED_ROWS), same, "left").withColumn("first", F.coalesce("first", itself)))
    stands = "first is not null and (_id, _hash) = (first._id, first._hash)"
    skipped = known.where(f"not coalesce({stands}, false)").select("_id", "_hash").distinct()
    links = candidate_links(restricted(rows, skipped, ["_id", "_hash"], "left_anti"), known.where(stands))
    own = known.where("first._id <> _id").select(F.col("_id").alias("a"), F.col("first._id").alias("b")).distinct()
    made = components(links.unionByName(own)).withColumnRenamed("id", "_id")
    return known.join(made, "_id", "left").select("_id", "_hash", "n", F.coalesce("component", "_id").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(``doc_id``, ``n_shingles``, ``component_id``, ``kept``) for each row of ``docs``.

    The component is the smallest id reachable by links, and a row is kept if that is its own id. Texts that are null or
    wordless have no shingles and no links. Rows of one id count as one document and are kept or not together. A row
    without id gets its component's smallest id, null if that has none; of such a component one text is kept. An empty
    table gives no rows. Texts are taken whole, whatever their length. Other columns are not read.
    """
    known = lambda c: F.when(F.col(c) < F.lit(1 << 62), F.col(c))
    return grouped(docs).select(
        known("_id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        known("component").alias("component_id"),
        (F.col("_id") == F.col("component")).alias("kept"),
    )
