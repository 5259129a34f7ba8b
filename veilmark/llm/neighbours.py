"""Nearest neighbours by score-aware anisotropic quantisation: four-bit codes, table scans, exact reranking.

Codebooks of 16 centroids for each 4 dimensions are fitted on at most SAMPLE unit vectors so that residual error along
the vector weighs ETA times the rest.  Every row is coded once, two codes a byte, into a kept table.  A scan adds up
table entries for CHUNK rows at a time and scores the RERANK best of them exactly, in double precision; each task hands on
its k best of each query.  Queries go round in blocks of at most BLOCK, which bounds what is broadcast; a scan reads the
whole table, so work grows with rows times queries.

Results by case: vectors that are null, zero, hold null or non-finite components, or have another length than most
(of two lengths as frequent, the longer) take no part, nor do rows without vec_id; repeated vectors are ordered by vec_id;
rows that share a vec_id are candidates each, but not for a query of that vec_id; fewer than k candidates give them all;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import keep

WIDTH, CODES, ETA, SAMPLE = 4, 16, 4.0, 8_000
RERANK, CHUNK, BLOCK, SIDE = 400, 16_384, 32_768, 128


def fit(x: np.ndarray) -> np.ndarray:
    """Codebooks [subspace, code, WIDTH]."""
    rng, m = np.random.default_rng(3), x.shape[1] // WIDTH
    parts = x.reshape(len(x), m, WIDTH)
    books = np.stack([parts[rng.choice(len(x), CODES, replace=len(x) < CODES), j] for j in range(m)])
    for _ in range(6):
        codes = encode(x, books)
        took = books[np.arange(m), codes]
        along = (parts * (parts - took)).sum(2)
        for j in range(m):
            rest = along.sum(1) - along[:, j]
            p = parts[:, j]
            for c in range(CODES):
                own = codes[:, j] == c
                if own.any():
                    q = p[own]
                    left = own.sum() * np.eye(WIDTH) + (ETA - 1) * q.T @ q
                    right = q.sum(0) + (ETA - 1) * q.T @ (rest[own] + (q * q).sum(1))
                    books[j, c] = np.linalg.solve(left, right)
    return books


def encode(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Coordinate descent on the anisotropic loss."""
    m = len(books)
    parts = x.reshape(len(x), m, WIDTH)
    square = ((parts[:, :, None] - books[None]) ** 2).sum(3)
    dot = (parts * parts).sum(2)[:, :, None] - np.einsum("nmw,mcw->nmc", parts, books)
    codes, rows = square.argmin(2), np.arange(len(x))
    along = dot[rows[:, None], np.arange(m), codes].sum(1)
    for _ in range(2):
        for j in range(m):
            rest = along - dot[rows, j, codes[:, j]]
            codes[:, j] = (square[:, j] + (ETA - 1) * (rest[:, None] + dot[:, j]) ** 2).argmin(1)
            along = rest + dot[rows, j, codes[:, j]]
    return codes


def usable(df: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(good, F.lit(False)))
    most = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("embedding") == (most[0] if most else 0))


def units(a: np.ndarray) -> np.ndarray:
    """Unit vectors, padded to whole subspaces.  Scaled first, so that squares neither overflow nor vanish."""
    a = a / np.abs(a).max(axis=1, keepdims=True)
    return np.pad(a / np.linalg.norm(a, axis=1, keepdims=True), ((0, 0), (0, -a.shape[1] % WIDTH)))


def vectors(column) -> np.ndarray:
    """An Arrow column of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def build(df: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray | None, DataFrame]:
    """(codebooks, kept table of vec_id, embedding, code); no codebooks if no row is usable."""
    rows = usable(df)
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select(F.col("embedding").cast("array<double>").alias("v")).toArrow().column(0).combine_chunks()
    if not len(some):
        return None, rows
    books = fit(units(vectors(some)))

    def code(batches):
        for b in batches:
            codes = encode(units(vectors(b.column(1))), books).astype(np.uint8) if b.num_rows else np.zeros((0, len(books)), np.uint8)
            codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
            packed = codes[:, ::2] | codes[:, 1::2] << 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in packed], pa.binary())], names=["vec_id", "embedding", "code"])

    return books, keep(rows.mapInArrow(code, StructType(list(rows.schema.fields)).add("code", "binary")), "index")


def search(df: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by every, its k nearest of all others."""
    spark = df.sparkSession
    books, index = build(df)
    out = "query_id bigint, vec_id bigint, score double"
    if books is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    asked = index.filter(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() * 2 // BLOCK))
    found = []
    for b in range(blocks):
        got = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select("vec_id", F.col("embedding").cast("array<double>").alias("v")).toArrow().combine_chunks()
        if not got.num_rows:
            continue
        held = spark.sparkContext.broadcast((got.column(0).to_numpy(), units(vectors(got.column(1).combine_chunks())), books))

        def scan(batches, held=held):
            ids, asked, books = held.value
            m = len(books)
            best_score, best_id = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, np.int64)

            def look(rows):
                own = np.concatenate([r.column(0).to_numpy() for r in rows])
                x = units(np.concatenate([vectors(r.column(1)) for r in rows]))
                packed = np.frombuffer(b"".join(c for r in rows for c in r.column(2).to_pylist()), np.uint8).reshape(len(own), -1)
                codes = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(own), -1)[:, :m]
                n = min(RERANK, len(own))
                for a in range(0, len(ids), SIDE):
                    q = asked[a : a + SIDE]
                    table = np.einsum("qmw,mcw->mcq", q.reshape(len(q), m, WIDTH), books).astype(np.float32)
                    rough = np.zeros((len(own), len(q)), np.float32)
                    for j in range(m):
                        rough += table[j][codes[:, j]]
                    top = np.argpartition(-rough, n - 1, axis=0)[:n]
                    for i in range(len(q)):
                        c = top[:, i]
                        c = c[own[c] != ids[a + i]]
                        s, v = np.concatenate([best_score[a + i], x[c] @ q[i]]), np.concatenate([best_id[a + i], own[c]])
                        order = np.lexsort((v, -s))[:k]
                        best_score[a + i], best_id[a + i] = s[order], v[order]

            waiting, n = [], 0
            for batch in batches:
                waiting.append(batch)
                n += batch.num_rows
                if n >= CHUNK:
                    look(waiting)
                    waiting, n = [], 0
            if n:
                look(waiting)
            at, rank = np.nonzero(best_score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(best_id[at, rank]), pa.array(best_score[at, rank])], names=["query_id", "vec_id", "score"])

        found.append(keep(index.mapInArrow(scan, out), "found"))
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return whole.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
