"""Near duplicates: fast similarity sketching, banding, exact verification, components.

Sketch: in round r every shingle is hashed to a bin; a bin keeps the least (round, hash).  Rounds go on until no bin is
empty; from round T on, round T+i fills bin i directly, so 2T rounds always fill all.  BANDS bands of ROWS coordinates
miss a pair at 0.85 with a chance of (1-0.85^5)^25 = 4e-7, one at 0.8 with 4.9e-5.

Every row gets a number of its own, fixed in a kept table, so rows with null or shared ids are judged by their own text.
Equal shingle sets are one class with one representative.  A round of hubs comes first: each bucket's first class is
verified against all others and leaves the bucket, since all its links are known; that joins most of a group of copies.
Buckets still mixed are dealt into blocks of about BLOCK members, and each pair of blocks is one bounded task group that
bounds all similarities from above by bit maps of the sets, in matrix products; only pairs in different components whose
bound reaches the threshold become rows.  So no link inside a bucket is lost.  Links are confirmed on full shingle sets.  A
bucket of n texts that stay unlinked moves n * n / BLOCK short rows.  What is grouped by a bucket or class is combined
before the shuffle and kept, so the joins back to the rows are joins of two plain tables, whose large keys Spark splits.

Results by case: null or wordless texts have no shingles and no links; fewer than k words make one shingle; repeated
rows share a class; of a component's ids the least is its name, null where none has an id; extra columns are not read;
an empty table gives no rows; texts are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.scratch import drop, folder

from .common import WORD, keep, map_texts

T, BANDS, ROWS = 125, 25, 5
BLOCK, SLOTS = 256, 2048
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Distinct words of which a task remembers the hashes.
MEMO = 500_000
NONE = np.iinfo(np.uint64).max


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def shingler(k: int):
    """text -> sorted distinct 64-bit hashes of its shingles: words are hashed once, and their hashes combined in order."""
    memo: dict[bytes, int] = {}

    def shingles(text: str | bytes | None) -> np.ndarray:
        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
        # bytes.lower() and split() know ASCII only: A-Z, and the six characters that no word holds.
        words = data.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        codes = list(map(memo.get, words))
        if None in codes:
            if len(memo) > MEMO:
                memo.clear()
            for i, c in enumerate(codes):
                if c is None:
                    codes[i] = memo[words[i]] = xxhash.xxh3_64_intdigest(words[i])
        a, n = np.array(codes, np.uint64), min(k, len(words))
        h = np.full(len(a) - n + 1, n, np.uint64)
        for i in range(n):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + a[i : len(a) - n + 1 + i])
        return np.unique(h)

    return shingles


def sketch(items: np.ndarray) -> np.ndarray:
    """As many rounds at once as about 1,000 hashes make."""
    out, empty, r = np.full(T, NONE, np.uint64), np.ones(T, bool), 0
    salt = np.arange(1, 2 * T + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    while r < T and empty.any():
        n = min(T - r, max(1, 1024 // len(items)))
        h = mixed(items[None] ^ salt[r : r + n, None])
        own = np.full(n * T, NONE, np.uint64)
        np.minimum.at(own, ((h % np.uint64(T)).astype(np.int64) + T * np.arange(n)[:, None]).ravel(), h.ravel())
        own = own.reshape(n, T)
        found = own != NONE
        fill = empty & found.any(axis=0)
        out[fill] = own[found.argmax(axis=0)[fill], fill]
        empty &= ~fill
        r += n
    for i in np.flatnonzero(empty):
        out[i] = mixed(items ^ salt[T + i]).min()
    return out


def bitmap(items: np.ndarray) -> bytes:
    """A bit for each of SLOTS slots that holds a shingle."""
    on = np.zeros(SLOTS, np.uint8)
    on[(items >> np.uint64(20)) % np.uint64(SLOTS)] = 1
    return np.packbits(on).tobytes()


def near_in_blocks(rows: DataFrame, percent: int, work: str) -> DataFrame:
    """Distinct pairs (a, b) of a bucket, in different components, that their bit maps do not rule out.

    A shingle of one set whose slot is empty in the other is not common: sets of n and m shingles have at most
    min(n - own slots, m - own slots) in common.
    """
    parts = keep(rows.groupBy("band", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "parts", work)
    dealt = rows.join(parts, ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("id", "band"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("band", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "comp", "n_shingles", "bits")
    keys = ["band", "key", "lo", "hi"]

    def within(g):
        n, own, comp, ids = (g[c].to_numpy() for c in ("n_shingles", "own", "comp", "id"))
        on = np.unpackbits(np.frombuffer(b"".join(g["bits"]), np.uint8).reshape(len(g), -1), axis=1).astype(np.float32)
        both, held = on @ on.T, on.sum(1)
        most = np.minimum(n[:, None] - (held[:, None] - both), n[None] - (held[None] - both))
        near = (100 * most >= percent * (n[:, None] + n[None] - most)) & (comp[:, None] != comp[None]) & (ids[:, None] < ids[None])
        if g["lo"].iat[0] != g["hi"].iat[0]:
            near &= own[:, None] != own[None]
        x, y = np.nonzero(near)
        return ids[x], ids[y]

    def scan(batches):
        import pandas as pd

        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            marks = rest[keys].to_numpy()
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1
            for i, j in zip([0, *cuts[:-1]], cuts):
                a, b = within(rest.iloc[i:j])
                if len(a):
                    yield pd.DataFrame({"a": a, "b": b})
            rest = rest.iloc[cuts[-1] :] if len(cuts) else rest
        if rest is not None and len(rest):
            a, b = within(rest)
            yield pd.DataFrame({"a": a, "b": b})

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(scan, "a bigint, b bigint").distinct()


def sketched(docs: DataFrame, k: int, id_col: str) -> DataFrame:
    def setup():
        shingles = shingler(k)

        def batch(texts):
            n, ident, bands, bits = [], [], [], []
            for t in texts:
                s = shingles(t)
                n.append(len(s))
                ident.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bits.append(bitmap(s) if len(s) else None)
                b = np.zeros(BANDS, np.uint64)
                if len(s):
                    for x in sketch(s).reshape(BANDS, ROWS).T:
                        b = mixed(b * np.uint64(0x9E3779B97F4A7C15) + x)
                bands.append(b.view(np.int64).tolist() if len(s) else [])
            return {"n_shingles": n, "ident": ident, "bits": bits, "bands": bands}

        return batch

    return map_texts(docs, [id_col], "n_shingles bigint, ident binary, bits binary, bands array<bigint>", setup, as_bytes=True)


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets satisfy 100 * common >= percent * union."""
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    @F.pandas_udf("boolean")
    def same(x, y):
        import pandas as pd

        shingles, memo = shingler(k), {}

        def of(t):
            if t not in memo:
                if len(memo) > 200:
                    memo.clear()
                memo[t] = shingles(t)
            return memo[t]

        out = []
        for s, t in zip(x, y, strict=True):
            s, t = of(s), of(t)
            common = len(np.intersect1d(s, t, assume_unique=True))
            out.append(100 * common >= percent * (len(s) + len(t) - common))
        return pd.Series(out)

    return pairs.join(a, "a").join(b, "b").filter(same("ta", "tb")).select("a", "b")


def components(nodes: DataFrame, links: DataFrame, work: str) -> DataFrame:
    """id, comp: least id reachable.  Labels spread along links until none changes; each step is a kept table."""
    both = keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links", work)
    now = keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "id"), "comp", work)
    while True:
        near = both.join(now.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("c"))
        jump = now.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        fresh = keep(now.join(near, "id").join(jump, "comp", "left").select("id", F.least("comp", "c", F.coalesce("up", "comp")).alias("comp"), F.col("comp").alias("old")), "comp", work)
        changed = fresh.filter("comp <> old").limit(1).count()
        now = fresh.select("id", "comp")
        if not changed:
            return nodes.join(now, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def contracted(comp: DataFrame, links: DataFrame, work: str) -> DataFrame:
    """id, comp after more links: components of the old components that the links touch, then one lookup."""
    end = lambda c: comp.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}"))
    over = keep(links.join(end("a"), "a").join(end("b"), "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "joins", work)
    if over.isEmpty():
        return comp
    root = components(over.select(F.col("a").alias("id")).union(over.select("b")).distinct(), over, work).select(F.col("id").alias("comp"), F.col("comp").alias("root"))
    return keep(comp.join(root, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")), "comp", work)


def classes(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """number, n_shingles, comp (the least number reachable; the own one of wordless rows) of a kept table of number, text."""
    spark = rows.sparkSession
    work = folder(spark, "classes")
    base = keep(sketched(rows, k, "number"), "sketch")
    least = F.min(F.struct(F.col("number").alias("id"), "n_shingles", "bits", "bands"))
    reps = keep(base.filter(F.col("ident").isNotNull()).groupBy("ident").agg(least.alias("r")).select("ident", "r.*"), "reps", work)
    banded = reps.select("id", "n_shingles", F.posexplode("bands").alias("band", "key"))
    hub = F.min(F.struct("id", "n_shingles"))
    buckets = keep(banded.groupBy("band", "key").agg(F.count("*").alias("n"), hub.alias("h")).filter("n > 1").select("band", "key", F.col("h.id").alias("hub"), F.col("h.n_shingles").alias("hub_n")), "buckets", work)
    met = keep(banded.join(buckets, ["band", "key"]).filter("id <> hub").select("band", "key", "id", "n_shingles", "hub", "hub_n"), "met", work)
    # Sets whose sizes differ too much cannot be linked.
    fits = 100 * F.least("n_shingles", "hub_n") >= percent * F.greatest("n_shingles", "hub_n")
    star = keep(met.filter(fits).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs", work)
    seen = met.select("id").union(met.select("hub")).distinct()
    texts = keep(rows.select(F.col("number").alias("id"), "text").join(seen, "id", "left_semi"), "texts", work)
    comp = contracted(reps.select("id", F.col("id").alias("comp")), keep(verify(star, texts, k, percent), "verified", work), work)
    # Buckets that still hold two components, without their hubs.
    live = met.select("band", "key", "id").join(comp, "id")
    mixed_up = keep(live.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("band", "key"), "mixed", work)
    live = keep(live.join(mixed_up, ["band", "key"], "left_semi"), "live", work).join(reps.select("id", "n_shingles", "bits"), "id")
    left = keep(near_in_blocks(live, percent, work).join(star, ["a", "b"], "left_anti"), "pairs", work)
    comp = contracted(comp, keep(verify(left, texts, k, percent), "verified", work), work)
    named = keep(reps.select("ident", "id").join(comp, "id").select("ident", "comp"), "named")
    drop(spark, work)
    # Wordless rows get a key of their own, so they do not meet in one task.
    lone = base.select("number", "n_shingles", F.coalesce("ident", F.col("number").cast("string").cast("binary")).alias("ident"))
    return lone.join(named, "ident", "left").select("number", "n_shingles", F.coalesce("comp", "number").alias("comp"))


def numbered(docs: DataFrame) -> DataFrame:
    """docs as a kept table with a number for each row, which stays as it is written there."""
    return keep(docs.withColumn("number", F.monotonically_increasing_id()), "rows")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_shingles, component_id, kept."""
    rows = numbered(docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text")))
    found = keep(classes(rows.select("number", "text"), k, percent).join(rows.select("number", "id"), "number"), "found")
    # Only components of two rows or more need a name that is not their own id.
    named = found.groupBy("comp").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    out = found.join(keep(named, "names"), "comp", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("least", "id").alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
