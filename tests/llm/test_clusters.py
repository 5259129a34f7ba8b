"""Centroid clustering against all pairs compared, and against the rounds in SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import SparkSession

from veilmark.llm import clusters, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()


def plain(rows, k, rounds, dims, scale):
    """(vec_id, cluster, distance) by comparing all pairs in whole numbers."""
    own = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in own if i is not None)
    mids = [v for _, v in named[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(mids))

    for _ in range(rounds):
        by = {}
        for _, v in own:
            by.setdefault(near(v)[1], []).append(v)
        mids = [[sum(x) // len(by[c]) for x in zip(*by[c], strict=True)] if c in by else m for c, m in enumerate(mids)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in own), key=repr), mids


def shapes():
    rng = np.random.default_rng(1)
    yield rng.normal(size=(900, 8)) * 40
    yield (rng.normal(size=(20, 8)) * 300)[rng.integers(0, 20, 900)] + rng.normal(size=(900, 8)) * 3
    yield np.concatenate([rng.integers(-3, 4, (900, 2)), np.zeros((900, 6))], axis=1)
    yield np.zeros((900, 8))
    yield rng.normal(size=(900, 8)) * 1e7


def test_trees_assign_as_all_pairs_do():
    for x in shapes():
        x = np.floor(x).astype(np.int64)
        for k in (1, 2, 30):
            c = np.concatenate([x[:k], x[:2]])
            d = ((x[:, None] - c[None]) ** 2).sum(-1)
            tree, over = clusters.Tree(x), clusters.Tree(c, 1, 0)
            assert sorted(tree.order.tolist()) == list(range(len(x)))
            assert (clusters.assigned(x, tree, c, over) == d.argmin(1)).all()
            count, total = np.zeros(len(c), np.int64), np.zeros((len(c), 8), np.int64)
            clusters.sums(x, tree, c, over, count, total)
            assert (count == np.bincount(d.argmin(1), minlength=len(c))).all() and all((total[i] == x[d.argmin(1) == i].sum(0)).all() for i in range(len(c)))


def test_nodes_hold_their_points_and_clustered_data_is_pruned():
    x = np.floor(list(shapes())[1]).astype(np.int64)
    t = clusters.Tree(x)
    for n, (center, low, high, first, last) in enumerate(t.nodes.T.tolist()):
        own = x[t.order[low:high]]
        assert np.sqrt(((own - x[center]) ** 2).sum(1)).max() <= t.radius[n] * (1 + 1e-6)
        if last > first:
            assert t.nodes[1, first] == low and t.nodes[2, last - 1] == high
            mids = x[t.nodes[0, first:last]]
            assert len({tuple(m) for m in mids.tolist()}) == len(mids)
    whole, leaves = clusters.walk(x, t, x[:30], clusters.Tree(x[:30], 1, 0))
    compared = sum(len(some) * (t.nodes[2, n] - t.nodes[1, n]) for n, some in leaves)
    assert compared < 0.3 * len(x) * 30


def test_query_equals_the_rounds_in_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.sql(queries.ORACLE_SQL["op11_centroids"]).fetchall()
    assert sorted(map(tuple, queries.op11_centroids(spark, SF).collect())) == sorted(want)


def test_odd_vectors_ties_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 50)
    rng = random.Random(3)
    rows = [(i % 150, [float(rng.randint(-2, 2)) / 8 for _ in range(4)], "x", 1) for i in range(300)]
    rows += [(None, [9.0, 9.0, 9.0, 9.0], None, None), (500, None, "x", 1), (501, [1.0, None, 1.0, 1.0], "x", 1), (502, [1.0, float("nan"), 1.0, 1.0], "x", 1), (503, [float("inf")] * 4, "x", 1), (504, [1.0], "x", 1), (505, [], "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, distance int")
    for k in (3, 7, 1000):
        got = clusters.cluster(df, k, 5, 4)
        want, mids = plain([(i, v) for i, v, *_ in rows], k, 5, 4, 256)
        out = got.collect()
        assert sorted(((r.vec_id, r.cluster, r.distance) for r in out), key=repr) == want
        assert {r.inertia for r in out} == {sum(d for *_, d in want)}
        for r in out:
            assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) and r.centroid_sha256 == hashlib.sha256(",".join(map(str, mids[r.cluster])).encode()).hexdigest()
    assert clusters.cluster(df.limit(0), 3, 5, 4).collect() == []
    with pytest.raises(Exception, match="too large"):
        clusters.cluster(spark.createDataFrame([(1, [1e30] * 4)], df.schema.simpleString()[7:-1].split(",cluster")[0].replace(":", " ")), 3, 1, 4).collect()
