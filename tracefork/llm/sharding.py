"""Sharding by sampled splitters: records are range-partitioned by key so that the shards' sizes are near equal.

Key samples are drawn with a chance in proportion to the record's size; their quantiles bound the ranges. A range that
still holds too much is sampled again and divided. The key is (hash of the text, hash of the record), so equal texts
lie side by side and even a group of equal texts can be divided. Sizes before each range are running sums over the
list of ranges; inside a range a window sorts the records, and each falls into the shard its middle byte lies in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracefork.llm.tables import settle

#: Ranges for each shard, and the bytes after which there are more of them, so that a task sorts a bounded share.
RANGES_PER_SHARD = 8
RANGE_BYTES = 1 << 30
#: Samples for each range, and how many times its share a range may hold before it is divided.
SAMPLES = 40
OVERFULL = 2.0
ROUNDS = 12

Bounds = list[tuple[int, int]]


def below(bounds: Bounds, a: str, b: str) -> Column:
    """The number of bounds that are not above the key, by halving the sorted list: a literal tree of comparisons."""

    def find(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        x, y = bounds[middle]
        before = (F.col(a) < x) | ((F.col(a) == x) & (F.col(b) < y))
        return F.when(before, find(low, middle)).otherwise(find(middle + 1, high))

    return find(0, len(bounds))


def draw(keys: DataFrame, expected: Column) -> DataFrame:
    """Keys drawn with the given chance; the draw is a hash of the key, so it is the same in every run."""
    chance = F.pmod(F.xxhash64(F.lit("draw"), "_a", "_b", "_tie"), F.lit(1 << 30)) / float(1 << 30)
    return keys.where(chance < expected)


def splitters(keys: DataFrame, total: int, ranges: int) -> Bounds:
    """Sorted bounds of ranges of about equal size; what reaches the driver is bounded by the number of ranges."""
    wanted = ranges * SAMPLES
    sample = sorted((r._a, r._b) for r in draw(keys, F.col("size") * wanted / total).select("_a", "_b").collect())
    bounds = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    share = total / ranges
    for _ in range(ROUNDS):
        held = keys.groupBy(below(bounds, "_a", "_b").alias("_range")).agg(
            F.sum("size").alias("size"), F.min_by(F.struct("_a", "_b"), F.struct("_a", "_b")).alias("low"), F.max(F.struct("_a", "_b")).alias("high")
        )
        over = [r for r in held.where(F.col("size") > OVERFULL * share).collect() if r.low != r.high]
        if not over:
            break
        inside = F.create_map(*[x for r in over for x in (F.lit(r._range), F.lit(SAMPLES * -(-r.size // share) / r.size))])
        chance = F.try_element_at(inside, below(bounds, "_a", "_b")) * F.col("size")
        more = draw(keys, F.coalesce(chance, F.lit(0.0))).select(below(bounds, "_a", "_b").alias("_range"), "_a", "_b")
        drawn: dict[int, Bounds] = {}
        for r in more.collect():
            drawn.setdefault(r._range, []).append((r._a, r._b))
        fresh = set(bounds)
        for r in over:
            own, pieces = sorted(drawn.get(r._range, [])), int(-(-r.size // share))
            fresh |= {own[i * len(own) // pieces] for i in range(1, pieces)} if own else set()
            fresh.add(tuple(r.high))  # always divides
        bounds = sorted(fresh)
    return bounds


def shard(docs: DataFrame, shards: int = 8, ranges: int | None = None) -> DataFrame:
    """One row per record of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The size is the text's UTF-8 bytes (none for null) and 1. Shard sizes differ by no more than about one record;
    slots number each shard from 0 without gaps. Rows with equal columns are told apart by their number only. An empty
    table gives no rows.
    """
    keys = settle(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("_a"),
            F.xxhash64("doc_id").alias("_b"),
            F.xxhash64("doc_id", "text").alias("_tie"),
        )
    )
    total = keys.agg(F.sum("size")).head()[0] or 1
    ranges = ranges or max(shards * RANGES_PER_SHARD, -(-total // RANGE_BYTES))
    # Beyond a thousand ranges the bounds would no longer fit into one expression; a range is then larger, not dropped.
    bounds = splitters(keys, total, int(min(ranges, 1024)))
    order = W.partitionBy("_range").orderBy("_a", "_b", "doc_id", "size")
    ranked = settle(
        keys.withColumn("_range", below(bounds, "_a", "_b"))
        .withColumn("_upto", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("_row", F.row_number().over(order))
    )
    sizes = ranked.groupBy("_range").agg(F.sum("size").alias("size")).orderBy("_range").collect()  # one row per range
    at, before = 0, {}
    for r in sizes:
        before[r._range] = at
        at += r.size
    start = lookup(before, F.col("_range"))
    middle = (F.col("_upto") + start) * 2 - F.col("size")  # twice the place of the record's middle
    placed = ranked.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * total))).cast("int"))
    runs = placed.groupBy("_range", "shard").agg(F.count("*").alias("n"), F.min("_row").alias("first")).collect()  # <= ranges + shards
    taken: dict[int, int] = {}
    shift: dict[str, int] = {}
    for r in sorted(runs, key=lambda r: (r.shard, r._range)):
        shift[f"{r._range}:{r.shard}"] = taken.get(r.shard, 0) - r.first
        taken[r.shard] = taken.get(r.shard, 0) + r.n
    slot = F.col("_row") + lookup(shift, F.concat_ws(":", "_range", "shard"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def lookup(values: dict, key: Column) -> Column:
    """A value by key from a small literal map."""
    if not values:
        return F.lit(0).cast("bigint")
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast("bigint"))]), key)
