"""Shared helpers: joins and components with hot keys, even groups, folders."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common


def test_join_spread_equals_a_join(spark):
    left = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") < 13_000, None).otherwise(F.col("id") % 500).alias("k"), "id")
    right = spark.range(0, 600, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(7, 70)], "k long, v long"))
    for how in ("inner", "left"):
        want = left.join(right, "k", how)
        got = common.join_spread(left, right, "k", how)
        assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    few = left.limit(50)
    assert common.join_spread(few, right, "k", "left").count() == 50


def test_components_with_hubs_chains_and_repeats(spark):
    rng = random.Random(3)
    edges = [(0, k) for k in range(1, 12_000)] + [(k, k + 1) for k in range(20_000, 20_040)] + [(30_000 + rng.randrange(300), 30_000 + rng.randrange(300)) for _ in range(200)]
    edges += [(b, a) for a, b in edges[-50:]] + [(5, 5), (-9, -8), (-8, -(2**63))]
    up = {}

    def root(i):
        up.setdefault(i, i)
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            i, j = sorted((root(a), root(b)))
            up[j] = i
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("n", "each"), [(1, 1), (7, 1), (50, 4), (300, 2)])
def test_keys_are_even(spark, n, each):
    keys = common.even_keys(n, each).tolist()
    assert len(set(keys)) == n * each
    rows = spark.createDataFrame([(k,) for k in keys], "k long").groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).count().collect()
    assert sorted(r["count"] for r in rows) == [each] * n


def test_a_cluster_must_name_a_shared_folder():
    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_base(session(master))
        assert common.shared_base(session(master, "s3a://bucket/x/")) == "s3a://bucket/x"
