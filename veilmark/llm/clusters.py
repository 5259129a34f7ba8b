"""Centroid clustering by dual-tree Lloyd rounds on integer vectors.

Vectors become integers floor(scale * x).  Every BLOCK of them becomes one row with a cover tree: a node's children are a net
of its points at half its reach, farthest first, each point going to its nearest child; a node of LEAF points, or whose
net would be a quarter of its points (which prunes nothing), is a leaf.  The trees are kept as a table.  Each round a tree over
the centroids is made in every task, and pairs of nodes are walked together: a pair is dropped when its least distance
exceeds the largest that some centroid leaves to any point of the node, a node with one centroid left takes it whole (its
sums are differences of running sums), and leaf pairs are compared exactly.  A task hands on one row of sums a cluster;
the driver divides k x dims sums.  Bounds carry a slack beyond the rounding of floats, so only sure pairs are dropped.

Results by case: vectors of another length, null, or with null or non-finite components take no part; rows of one vec_id are
rows of their own; rows with null vec_id are clustered but never a first centroid; among equal hashes the smaller vector
comes first; fewer than k vectors give fewer centroids; an empty table gives no rows; extra columns are not read; a
component of LARGEST or more after scaling, whose squares would not fit a long, raises OverflowError.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.scratch import drop, folder

from .common import keep

BLOCK, LEAF, SLACK = 2048, 16, 1e-9
#: Below EXACT, dot products of floats are exact; below LARGEST, squared distances fit a long.
EXACT, LARGEST = 1 << 21, 1 << 26


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, each of a with each of b."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < EXACT:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((a - c) ** 2).sum(1) for c in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


class Tree:
    """A cover tree as arrays: a node has a center (row), a radius, children first to last, and the rows order[low:high]."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF, least_gain: int = 4):
        n = len(rows)
        points = rows.astype(np.float64)
        order = np.arange(n)
        center, radius, low, high, first, last = [0], [0.0], [0], [n], [0], [0]
        at = 0
        while at < len(center):
            a, b = low[at], high[at]
            own = order[a:b]
            to = np.sqrt(((points[own] - points[center[at]]) ** 2).sum(1))
            radius[at] = float(to.max()) * (1 + SLACK)
            net = self.net(points, own, center[at], to, leaf, least_gain)
            first[at] = last[at] = len(center)
            if net:
                chosen, owner = net
                by = np.argsort(owner, kind="stable")
                order[a:b] = own[by]
                ends = a + np.searchsorted(owner[by], np.arange(len(chosen) + 1))
                for c, x, y in zip(chosen, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    center.append(c)
                    radius.append(0.0)
                    low.append(x)
                    high.append(y)
                    first.append(0)
                    last.append(0)
                last[at] = len(center)
            at += 1
        self.order = order.astype(np.int32)
        self.nodes = np.array([center, low, high, first, last], np.int32)
        self.radius = np.array(radius)

    @staticmethod
    def net(points, own, center, to, leaf, least_gain):
        """Rows that are more than half the reach apart, and the nearest one of each row; none for a leaf."""
        if len(own) <= leaf or to.max() == 0:
            return None
        half, chosen, owner, best = to.max() / 2, [center], np.zeros(len(own), np.int32), to.copy()
        most = len(own) // least_gain if least_gain else len(own)
        while True:
            far = int(best.argmax())
            if best[far] <= half:
                return chosen, owner
            if len(chosen) >= most:
                return None
            d = np.sqrt(((points[own] - points[own[far]]) ** 2).sum(1))
            nearer = d < best
            owner[nearer], best[nearer] = len(chosen), d[nearer]
            chosen.append(int(own[far]))

    @classmethod
    def read(cls, order: bytes, nodes: bytes, radius: bytes) -> Tree:
        t = cls.__new__(cls)
        t.order, t.nodes, t.radius = np.frombuffer(order, np.int32), np.frombuffer(nodes, np.int32).reshape(5, -1), np.frombuffer(radius, np.float64)
        return t


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from first to last of each entry, and the entry of each."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), of


def walk(rows: np.ndarray, tree: Tree, centroids: np.ndarray, over: Tree) -> tuple[list, list]:
    """(whole, leaves): nodes that one centroid takes as (node, centroid), and (node, centroids left) to be compared."""
    x, c = rows.astype(np.float64), centroids.astype(np.float64)
    q, r = np.array([0]), np.array([0])
    center, _, _, first, last = tree.nodes
    own, _, _, down, end = over.nodes
    whole, leaves = [], []
    while len(q):
        d = np.sqrt(((x[center[q]] - c[own[r]]) ** 2).sum(1))
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        sizes = np.diff(starts, append=len(q))
        most = np.repeat(np.minimum.reduceat(d, starts), sizes) + tree.radius[q]
        stay = d - tree.radius[q] - over.radius[r] <= most * (1 + SLACK) + SLACK
        q, r = q[stay], r[stay]
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        sizes = np.diff(starts, append=len(q))
        inner = end[r] > down[r]
        rest = np.add.reduceat(inner.astype(np.int64), starts)
        q_leaf = first[q[starts]] == last[q[starts]]
        done_whole = (sizes == 1) & (rest == 0)
        done_leaf = q_leaf & (rest == 0) & ~done_whole
        for i in np.flatnonzero(done_whole):
            whole.append((int(q[starts[i]]), int(own[r[starts[i]]])))
        for i in np.flatnonzero(done_leaf):
            leaves.append((int(q[starts[i]]), np.sort(own[r[starts[i] : starts[i] + sizes[i]]])))
        # The wider side of what is left goes down.
        reach = np.maximum.reduceat(np.where(inner, over.radius[r], -1.0), starts)
        done = done_whole | done_leaf
        by_r = ~done & (q_leaf | (reach >= tree.radius[q[starts]]))
        turn_r = np.repeat(by_r, sizes)
        turn_q = np.repeat(~done & ~by_r, sizes)
        below, of = spread(down[r[turn_r & inner]], end[r[turn_r & inner]])
        new_q, new_r = [q[turn_r & ~inner], q[turn_r & inner][of]], [r[turn_r & ~inner], below]
        below, of = spread(first[q[turn_q]], last[q[turn_q]])
        q, r = np.concatenate([*new_q, below]), np.concatenate([*new_r, r[turn_q][of]])
        by = np.argsort(q, kind="stable")
        q, r = q[by], r[by]
    return whole, leaves


def assigned(rows: np.ndarray, tree: Tree, centroids: np.ndarray, over: Tree) -> np.ndarray:
    """Each row's nearest centroid; of equal ones the smaller number."""
    out = np.empty(len(rows), np.int64)
    whole, leaves = walk(rows, tree, centroids, over)
    _, low, high, *_ = tree.nodes
    for node, c in whole:
        out[tree.order[low[node] : high[node]]] = c
    for node, some in leaves:
        own = tree.order[low[node] : high[node]]
        out[own] = some[squared(rows[own], centroids[some]).argmin(1)]
    return out


def sums(rows: np.ndarray, tree: Tree, centroids: np.ndarray, over: Tree, count: np.ndarray, total: np.ndarray) -> None:
    """Adds a block's counts and sums by cluster."""
    running = np.concatenate([np.zeros((1, rows.shape[1]), np.int64), np.cumsum(rows[tree.order], axis=0)])
    whole, leaves = walk(rows, tree, centroids, over)
    _, low, high, *_ = tree.nodes
    for node, c in whole:
        count[c] += high[node] - low[node]
        total[c] += running[high[node]] - running[low[node]]
    for node, some in leaves:
        own = tree.order[low[node] : high[node]]
        near = some[squared(rows[own], centroids[some]).argmin(1)]
        np.add.at(count, near, 1)
        np.add.at(total, near, rows[own])


FOREST = "ids binary, nulls binary, rows binary, tree_order binary, nodes binary, radius binary"


def usable(vectors: DataFrame, dims: int, id_col: str, vec_col: str) -> DataFrame:
    """id long, v array<double> of the rows that take part."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).filter((F.size("v") == dims) & ~F.coalesce(odd, F.lit(True)))


def forest(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """One row a block: its ids, integer vectors and tree."""

    def grow(batches):
        ids, nulls, rows, n = [], [], [], 0

        def block():
            own = np.concatenate(rows)
            t = Tree(own)
            data = [np.concatenate(ids).tobytes(), np.concatenate(nulls).tobytes(), own.astype("<i4").tobytes(), t.order.tobytes(), t.nodes.tobytes(), t.radius.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in data], names=["ids", "nulls", "rows", "tree_order", "nodes", "radius"])

        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                x = np.floor(scale * part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                if np.abs(x).max(initial=0) >= LARGEST:
                    raise OverflowError("a component is too large for squared distances to fit a long")
                if n + len(x) > BLOCK:
                    yield block()
                    ids, nulls, rows, n = [], [], [], 0
                ids.append(part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                nulls.append(part.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
                rows.append(x.astype(np.int64))
                n += len(x)
        if n:
            yield block()

    return rows.mapInArrow(grow, FOREST)


def blocks_of(batch: pa.RecordBatch, dims: int):
    for ids, nulls, rows, order, nodes, radius in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        yield np.frombuffer(ids, "<i8"), np.frombuffer(nulls, np.uint8), np.frombuffer(rows, "<i4").astype(np.int64).reshape(-1, dims), Tree.read(order, nodes, radius)


def one_round(trees: DataFrame, centroids: np.ndarray, dims: int) -> list[list[int]]:
    """The centroids after a round."""
    held = trees.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        c = held.value
        over, count, total = Tree(c, 1, 0), np.zeros(len(c), np.int64), np.zeros((len(c), dims), np.int64)
        for b in batches:
            for _, _, rows, tree in blocks_of(b, dims):
                sums(rows, tree, c, over, count, total)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(count[met]), pa.array(total[met].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = trees.mapInArrow(run, "cluster bigint, n bigint, total array<bigint>")
    added = parts.select("cluster", "n", F.posexplode("total").alias("dim", "x")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    new = centroids.tolist()
    for r in added.collect():  # k x dims rows at most
        new[r["cluster"]][r["dim"]] = int(r["x"]) // r["n"]
    held.unpersist()
    return new


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    rows = usable(vectors, dims, id_col, vec_col)
    drawn = rows.filter(F.col("id").isNotNull()).withColumn("h", F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256))
    start = [r["v"] for r in drawn.orderBy("h", "v").select("v").limit(k).collect()]
    path = folder(spark, "forest")
    forest(rows, dims, scale).write.option("compression", "zstd").option("parquet.block.size", 1 << 24).parquet(path)
    trees = spark.read.schema(FOREST).parquet(path)
    centroids = np.floor(scale * np.array(start, np.float64).reshape(-1, dims)).astype(np.int64)
    for _ in range(rounds if start else 0):
        new = np.array(one_round(trees, centroids, dims), np.int64)
        if (new == centroids).all():  # so will the rounds after it be
            break
        centroids = new
    held = spark.sparkContext.broadcast(centroids)

    def last(batches):
        c = held.value
        over = Tree(c, 1, 0) if len(c) else None
        for b in batches:
            for ids, nulls, rows, tree in blocks_of(b, dims):
                if over:
                    near = assigned(rows, tree, c, over)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls.astype(bool)), pa.array(near.astype(np.int32)), pa.array(((rows - c[near]) ** 2).sum(1))], names=["vec_id", "cluster", "distance"])

    done = keep(trees.mapInArrow(last, "vec_id bigint, cluster int, distance bigint"), "clusters")
    drop(spark, path)
    own = {r["cluster"]: r["d"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows at most
    table = [(i, own[i], sum(own.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist()) if i in own]
    named = spark.createDataFrame(table, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return done.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def lloyd_sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:") -> str:
    """The same rounds, written out for DuckDB."""
    steps = [
        f"v as (select row_number() over () as i, vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)",
        f"c0 as (select row_number() over (order by sha256('{seed}' || vec_id), v) - 1 as c, v as m from v where vec_id is not null order by c limit {k})",
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} as (select i, vec_id, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d, v from v, c{n})")
        steps.append(f"a{n} as (select i, any_value(vec_id) as vec_id, min_by(c, (d, c)) as c, min(d) as d, any_value(v) as v from d{n} group by i)")
        if n < rounds:
            steps.append(f"s{n} as (select c, j, cast(sum(v[j]) as hugeint) as s, count(*) as n from a{n}, range(1, {dims + 1}) t(j) group by c, j)")
            steps.append(f"c{n + 1} as (select c, coalesce(any_value(new), any_value(m)) as m from c{n} left join (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by j) as new from s{n} group by c) using (c) group by c)")
    last = f"select vec_id, cast(c as int) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(m, ',')) as centroid_sha256 from a{rounds} join c{rounds} using (c)"
    return f"with {', '.join(x.replace(' as (', ' as materialized (', 1) for x in steps)} {last}"
