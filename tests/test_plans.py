"""Quantiles, numbering and salted joins, with hot keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefork.plans.numbering import number_within
from tracefork.plans.quantiles import exact_quantile, narrowed
from tracefork.plans.skew import dealt, hot_join, hot_keys, salted_join
from tracefork.session import durable, fresh_path, shared_dir, small_side


def groups():
    rng = random.Random(5)
    out = {"hot": [rng.gauss(0, 1) for _ in range(3000)], "one": [4.5], "two": [1.0, 2.0]}
    out["same"] = [7.0] * 50
    out["mostly_zero"] = [0.0] * 400 + [rng.random() for _ in range(60)]
    out["heavy_tail"] = [10.0 ** rng.uniform(-12, 12) for _ in range(300)]
    return out


@pytest.mark.parametrize("max_ranked,sample", [(1_000_000, 4096), (5, 16)])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.9, 0.99, 1.0])
def test_exact_quantile_equals_numpy(spark, max_ranked, sample, q):
    data = groups()
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("one", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.quantile for r in exact_quantile(df, ["k"], "v", q, sample, max_ranked).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        assert got[k] == pytest.approx(np.quantile(vs, q), rel=1e-12), k


def far_off():
    """Values that no equal-width bins take apart: clusters far from each other, many scales, infinite ends."""
    rng = random.Random(7)
    near, far = [1.0 + i * 2.0**-52 for i in range(600)], [1e300 + i * 1e285 for i in range(600)]
    return {
        "two_clusters": near + far,
        "uneven": near * 3 + far[:200],
        "scales": [10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(1500)],
        "infinite": [-np.inf] * 4 + near + [np.inf] * 3,
        "small": [3.0, 1.0, 2.0],
    }


@pytest.mark.parametrize("q", [0.25, 0.5, 0.75, 599.5 / 1199])
def test_narrowing_bounds_every_ranked_group(spark, q):
    data = far_off()
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    pairs = narrowed(df, ["k"], "v", q, 256, 40)
    assert 2 <= len(pairs) <= 5
    seen = []
    for rows, bounds in pairs:
        own = {r.k: r["count"] for r in rows.join(bounds, "k", "left_semi").groupBy("k").count().collect()}
        assert own == {r.k: r.left for r in bounds.collect()} and all(n <= 40 for n in own.values())
        seen += own
    assert sorted(seen) == sorted(data)
    got = {r.k: r.quantile for r in exact_quantile(df, ["k"], "v", q, 256, 40).collect()}
    assert got == {k: pytest.approx(np.quantile(vs, q), rel=1e-12) for k, vs in data.items()}


@pytest.mark.parametrize("hot_rows", [0, 100, 10_000])
def test_numbering_is_dense_and_ordered(spark, hot_rows):
    rng = random.Random(6)
    rows = [("hot" if i % 3 else f"k{i % 7}", rng.randrange(40), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, a int, b int")
    got = number_within(df, ["k"], ["a", "b"], F.floor(F.col("a") / 8), "n", hot_rows).collect()
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        wanted = sorted((a, b) for kk, a, b in rows if kk == k)
        assert [(r.a, r.b) for r in sorted((r for r in got if r.k == k), key=lambda r: r.n)] == wanted
        assert sorted(r.n for r in got if r.k == k) == list(range(len(wanted)))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join_equals_plain_join(spark, how):
    big = spark.range(500).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 1 ELSE id % 11 END AS k")
    small = spark.createDataFrame([(1, "x"), (2, "y"), (9, "z")], "k long, name string")
    salted = salted_join(big, small, ["k"], ["id"], how)
    plain = big.join(small, "k", how)
    cols = sorted(plain.columns)
    assert sorted(map(tuple, salted.select(cols).collect()), key=str) == sorted(
        map(tuple, plain.select(cols).collect()), key=str
    )


def uneven_rows(spark, n=20_000):
    """One key with 30 % of the rows, one of 10 % that is null, the rest over 400 keys."""
    key = "CASE WHEN id % 10 < 3 THEN 'hot' WHEN id % 10 = 3 THEN NULL ELSE 'k' || (id % 401) END"
    return spark.range(n).selectExpr("id", f"{key} AS k", "id % 7 AS g")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("keys", [["k"], ["k", "g"]])
@pytest.mark.parametrize("hot_rows", [100, 1_000_000])
def test_hot_join_equals_plain_join(spark, how, keys, hot_rows):
    big = uneven_rows(spark, 5000)
    small = big.where("k IS NULL OR k <> 'k3'").groupBy(*keys).agg(F.min("id").alias("low"))
    joined, plain = hot_join(big, small, keys, ["id"], how, hot_rows), big.join(small, keys, how)
    assert sorted(joined.columns) == sorted(plain.columns)
    rows = lambda d: sorted(map(tuple, d.select(sorted(plain.columns)).collect()), key=str)
    assert rows(joined) == rows(plain)


def test_only_hot_keys_are_cut(spark):
    big = uneven_rows(spark)
    hot = hot_keys(big, ["k"], 500)
    assert hot.count() == 2 and hot_keys(big, ["k"], 1_000_000) is None
    assert hot_keys(big.limit(0), ["k"], 1) is None
    pieces = {(r.k, r._salt): r["count"] for r in dealt(big, ["k"], ["id"], hot).groupBy("k", "_salt").count().collect()}
    assert {k for k, salt in pieces if salt} == {"hot", None}
    assert max(pieces.values()) <= 650 and sum(pieces.values()) == 20_000
    # Partitions of the join: the longest within three times the median, against the whole hot key without salts.
    per_task = lambda d, *by: sorted(r["count"] for r in d.repartition(12, *by).groupBy(F.spark_partition_id()).count().collect())
    salted, plain = per_task(dealt(big, ["k"], ["id"], hot), "k", "_salt"), per_task(big, "k")
    assert plain[-1] > 3 * plain[len(plain) // 2] and salted[-1] <= 3 * salted[len(salted) // 2]


class Unnamed:
    """A session without ``spark.checkpoint.dir``; its context may or may not name a folder."""

    master = "local[2]"

    def __init__(self, folder=None):
        self.folder, self.conf, self.sparkContext = folder, self, self

    def get(self, key, default):
        return default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_follows_the_session(spark, tmp_path, monkeypatch):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_dir(spark) == named.rstrip("/")
    assert shared_dir(Unnamed("hdfs:///shared/")) == "hdfs:///shared"
    monkeypatch.setattr("tempfile.tempdir", str(tmp_path))
    fresh = Unnamed()
    assert shared_dir(fresh).startswith(str(tmp_path)) and shared_dir(fresh) == fresh.folder
    fresh = Unnamed()
    fresh.master = "spark://one:7077"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(fresh)
    assert fresh_path(spark, "x").startswith(shared_dir(spark)) and fresh_path(spark, "x") != fresh_path(spark, "x")
    assert durable(spark.range(5)).count() == 5


def test_broadcast_only_below_the_bound(spark):
    plan = lambda n: spark.range(100).join(small_side(spark.range(50), n), "id")._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(50) and "broadcast" not in plan(49)
