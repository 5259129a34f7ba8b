"""Benchmark decontamination: rare word n-gram seeds join texts to test items, then local alignment scores the copy.

Texts meet all SEED-grams of the items.  Hits on an item become passages where hits of a NEED-th of its grams lie within
twice its length, so a copy may be edited anywhere and a common gram alone starts nothing; hits that one alignment could
bridge share a passage, which reaches as far as the item's rest could pay for (twice its length in gaps).  A passage is
aligned if it holds a seed: a gram of the item that the corpus has RARE times or, of a larger corpus, in one of COMMON
places at most, or the rarest that the corpus has of each STRIDE grams, so items of common words have seeds too.  While the
benchmark has BOUND grams at most (checked), they go to every task as sorted hashes and one pass over the texts finds hits and
counts grams; beyond it, the texts' grams pass a Bloom filter of FILTER bits and are joined to the items' by a shuffle.
Passages are joined to the items by number, and Smith-Waterman aligns them word by word, a row of the table at a time; what
is left beside a match is aligned again, and passages much longer than the item are taken in overlapping parts, so time
stays linear in the text.

Results by case: null and empty texts or items match nothing, nor do items of fewer than SEED words, which any text may
hold by chance; repeated rows give repeated matches; rows of the benchmark that share an item_id or have none are items of
their own; every copy of an item in a text is reported, the better of two that overlap, the first of two alike; texts are
scanned whole; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, map_texts
from .minhash import MEMO, mixed, numbered

SEED, STRIDE, LEAST, BOUND = 3, 4, 0.5, 2_000_000
NEED, RARE, COMMON, FILTER = 8, 64, 20_000, 1 << 27
WORDS = re.compile(r"\w+")
MATCH, MISS, GAP = 2, 1, 1
#: Parts of long passages, and what two of them share, in lengths of the item.
PART, SHARED = 12, 4


#: ASCII in lower case, and a blank for what no word holds.
PLAIN = bytes(ord(chr(i).lower()) if chr(i).isalnum() or i == 95 else 32 for i in range(128)) + bytes(range(128, 256))


def coder():
    """text (or its UTF-8) -> hashes of its words in lower case.  What lies between ASCII signs is looked up whole, and cut
    into words only where it holds other characters and was not met before."""
    memo: dict[bytes, bytes] = {}

    def codes(text: str | bytes | None) -> np.ndarray:
        parts = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").translate(PLAIN).split()
        out = list(map(memo.get, parts))
        if None in out:
            if len(memo) > MEMO:
                memo.clear()
            for i, c in enumerate(out):
                if c is None:
                    p = parts[i]
                    words = (p,) if p.isascii() else [w.lower().encode("utf-8", "surrogatepass") for w in WORDS.findall(p.decode("utf-8", "surrogatepass"))]
                    out[i] = memo[p] = b"".join([xxhash.xxh3_64_intdigest(w).to_bytes(8, "little") for w in words])
        return np.frombuffer(b"".join(out), "<u8")

    return codes


def grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of each SEED words."""
    n = len(codes) - SEED + 1
    h = np.full(max(0, n), SEED, np.uint64)
    for i in range(SEED if n > 0 else 0):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n])
    return h.view(np.int64)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: (score, first, end) of the best local alignment in text.

    Gaps within a row are a running maximum.  Of equal ways a match or miss comes first, then a word of the item left out,
    then one of the text; of equal scores the one that ends first in the item, then in the text.
    """
    n, at = len(text), np.arange(len(text) + 1)
    row, first = np.zeros(n + 1, np.int64), at.copy()
    best = (0, 0, 0)
    for x in item:
        score, origin = np.zeros(n + 1, np.int64), at.copy()
        step = row[:-1] + np.where(text == x, MATCH, -MISS)
        ok = step > 0
        score[1:][ok], origin[1:][ok] = step[ok], np.where(row[:-1] > 0, first[:-1], at[:-1])[ok]
        up = row - GAP
        ok = up > score
        score[ok], origin[ok] = up[ok], first[ok]
        slope = score + GAP * at
        top = np.maximum.accumulate(slope)
        left = np.maximum.accumulate(np.where(slope == top, at, 0))
        row, first = top - GAP * at, origin[left]
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), int(first[j]), j)
    return best


def copies(item: np.ndarray, text: np.ndarray) -> list[tuple[float, int, int]]:
    """(score, first, end) of alignments of LEAST or more that do not overlap, by place."""
    size, found = len(item), []
    starts = range(0, max(1, len(text) - SHARED * size), (PART - SHARED) * size) if len(text) > PART * size else (0,)
    todo = [(a, min(len(text), a + PART * size)) for a in starts]
    while todo:
        low, high = todo.pop()
        if high - low < LEAST * size:  # fewer words cannot score LEAST
            continue
        s, a, b = align(item, text[low:high])
        if s and s >= LEAST * MATCH * size:
            found.append((s / (MATCH * size), low + a, low + b))
            todo += [(low, low + a), (low + b, high)]
    taken: list = []
    for s, a, b in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
        if all(b <= c or d <= a for _, c, d in taken):
            taken.append((s, a, b))
    return sorted(taken, key=lambda x: x[1:])


def supported(at: np.ndarray, place: np.ndarray, size: int, need: int) -> list[tuple[int, int]]:
    """Hits (place in the text, in the item) round which, within twice the item's length, `need` places of it or more are hit."""
    if len(at) < need:
        return []
    if need == 1:
        return list(zip(at.tolist(), place.tolist(), strict=True))
    low, high = np.searchsorted(at, at - 2 * size), np.searchsorted(at, at + 2 * size, "right")
    some = np.flatnonzero(high - low >= need).tolist()
    out, last = [], (-1, -1, False)
    for i in some:
        a, b = int(low[i]), int(high[i])
        if (a, b) != last[:2]:
            last = (a, b, len(set(place[a:b].tolist())) >= need)
        if last[2]:
            out.append((int(at[i]), int(place[i])))
    return out


def passages(text: str | bytes, codes: np.ndarray, found: np.ndarray, hits: tuple[np.ndarray, ...]) -> list[tuple]:
    """(item, codes, starts, ends, grams) of each stretch of a text where hits lie; hits: place in the text, item, place in
    the item, its length in words and the hits that it needs."""
    at, item, place, size, need = hits
    order = np.lexsort((place, at, item))
    at, item, place, size, need = (x[order] for x in (at, item, place, size, need))
    cuts = np.flatnonzero(np.diff(item, prepend=-1))
    spots, out = None, []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(item)]):
        ranges: list = []
        n = int(size[a])
        for x, y in supported(at[a:b], place[a:b], n, int(need[a])) if b - a >= need[a] else ():
            low, high = max(0, x - 3 * y - SEED), min(len(codes), x + 3 * (n - y) + SEED)
            if ranges and (low <= ranges[-1][1] or x - ranges[-1][2] <= n):
                ranges[-1] = [min(low, ranges[-1][0]), max(high, ranges[-1][1]), x, [*ranges[-1][3], x]]
            else:
                ranges.append([low, high, x, [x]])
        for low, high, _, own in ranges:
            if spots is None:
                spots = np.array([m.span() for m in WORDS.finditer(text.decode("utf-8", "surrogatepass") if isinstance(text, bytes) else text)], np.int32)
            out.append((int(item[a]), codes[low:high].tobytes(), spots[low:high, 0].tobytes(), spots[low:high, 1].tobytes(), np.unique(found[own]).tobytes()))
    return out


PASSAGE = "array<struct<item:bigint,codes:binary,starts:binary,ends:binary,grams:binary>>"
NAMES = ("item", "codes", "starts", "ends", "grams")


def _passage_array(rows: list[list[tuple]]) -> pa.Array:
    kind = pa.list_(pa.struct([("item", pa.int64()), *((n, pa.binary()) for n in NAMES[1:])]))
    return pa.array([[dict(zip(NAMES, p, strict=True)) for p in own] for own in rows], kind)


def seeds_of(items: np.ndarray, places: np.ndarray, grams_: np.ndarray, spread: np.ndarray, total: int) -> np.ndarray:
    """The sorted grams that are seeds; spread: how often the corpus has each."""
    there = spread > 0
    items, places, grams_, spread = items[there], places[there], grams_[there], spread[there]
    rare = spread <= max(RARE, total // COMMON)
    order = np.lexsort((grams_, spread, places // STRIDE, items))
    first = (np.diff(items[order], prepend=-1) != 0) | (np.diff(places[order] // STRIDE, prepend=-1) != 0)
    rare[order[first]] = True
    return np.unique(grams_[rare])


def _placed(items: DataFrame) -> DataFrame:
    """item, gram, place, size, need: one row a gram of an item."""
    n = F.size("grams")
    need = F.greatest(F.lit(1), F.floor(F.size(F.array_distinct("grams")) / NEED)).cast("int")
    return items.select(F.col("number").alias("item"), (n + SEED - 1).alias("size"), need.alias("need"), F.posexplode("grams").alias("place", "gram"))


def _scanned(rows: DataFrame, keys: list[str], placed: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(kept passages, seeds): one pass over the texts, with the items' grams in every task."""
    spark = rows.sparkSession
    table = placed.orderBy("gram", "item", "place").select("gram", "item", "place", "size", "need").toArrow()  # BOUND rows at most
    held = spark.sparkContext.broadcast(tuple(c.to_numpy().astype(np.int64) for c in table.columns))
    n_keys = len(keys)

    def scan(batches):
        codes, (grams_, items, places, sizes, needs) = coder(), held.value
        own, first = np.unique(grams_, return_index=True)
        last = np.append(first[1:], len(grams_))
        n, total = np.zeros(len(own), np.int64), 0
        kinds = None
        for b in batches:
            kinds = [c.type for c in b.columns[:n_keys]]
            rows, out = [], []
            for i, text in enumerate(b.column(n_keys).to_pylist()):
                c = codes(text)
                found = grams(c)
                total += len(found)
                at = np.searchsorted(own, found)
                hit = np.flatnonzero(own[np.minimum(at, len(own) - 1)] == found) if len(own) else at[:0]
                if not len(hit):
                    continue
                k = at[hit]
                np.add.at(n, k, 1)
                many = last[k] - first[k]
                to = np.repeat(first[k] - np.cumsum(many) + many, many) + np.arange(many.sum())
                met = passages(text, c, found, (np.repeat(hit, many), items[to], places[to], sizes[to], needs[to]))
                if met:
                    rows.append(i)
                    out.append(met)
            if rows:
                yield pa.RecordBatch.from_arrays([*(x.take(pa.array(rows)) for x in b.columns[:n_keys]), _passage_array(out), pa.nulls(len(rows), COUNTS)], names=[*b.schema.names[:n_keys], "__passages", "__counts"])
        if kinds is not None:
            seen = np.flatnonzero(n)
            counts = [{"gram": g, "n": k} for g, k in zip([None, *own[seen].tolist()], [total, *n[seen].tolist()], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in kinds), _passage_array([[]]), pa.array([counts], COUNTS)], names=[*(f"k{i}" for i in range(n_keys)), "__passages", "__counts"])

    made = rows.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col("__text").cast("binary"))
    fields = [T.StructField(f.name, f.dataType, True) for f in made.schema.fields[:n_keys]]
    scanned = made.mapInArrow(scan, T.StructType(fields + T.StructType.fromDDL(f"__passages {PASSAGE}, __counts array<struct<gram:bigint,n:bigint>>").fields))
    whole = keep(scanned.select(F.struct(F.lit(True).alias("_"), *[F.col(f"k{i}") for i in range(n_keys)]).alias("row"), "__passages", "__counts"), "passages")
    counted = whole.filter(F.col("__counts").isNotNull()).select(F.explode("__counts").alias("c")).groupBy("c.gram").agg(F.sum("c.n").alias("n")).toArrow()  # BOUND rows at most
    spread = dict(zip(counted.column(0).to_pylist(), counted.column(1).to_pylist(), strict=True))
    grams_, items, places, *_ = held.value
    seeds = seeds_of(items, places, grams_, np.array([spread.get(g, 0) for g in grams_.tolist()], np.int64), spread.get(None, 0))
    return whole.select("row", F.explode("__passages").alias("p")), seeds


COUNTS = pa.list_(pa.struct([("gram", pa.int64()), ("n", pa.int64())]))


def _bits(grams_: DataFrame) -> np.ndarray:
    """A Bloom filter of one hash: FILTER bits, which the driver gathers as blocks of 32,768."""
    at = grams_.select(F.col("gram").bitwiseAND(FILTER - 1).alias("at"))
    blocks = at.groupBy(F.shiftright("at", 15).alias("block")).agg(F.expr("bitmap_construct_agg(at & 32767)").alias("bits")).collect()
    out = np.zeros(FILTER // 8, np.uint8)
    for r in blocks:
        out[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _joined(rows: DataFrame, keys: list[str], placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passages, seeds as a table): texts' grams joined to those of the items."""
    rows = keep(rows.withColumn("__row", F.monotonically_increasing_id()), "texts")
    placed = keep(placed, "grams")
    held = rows.sparkSession.sparkContext.broadcast(_bits(placed))

    def every():
        codes, bits = coder(), held.value

        def batch(found):
            at, gram, total = [], [], []
            for t in found:
                g = grams(codes(t))
                to = g & (FILTER - 1)
                hit = np.flatnonzero(bits[to >> 3] >> (to & 7).astype(np.uint8) & 1)
                at.append(hit.tolist())
                gram.append(g[hit].tolist())
                total.append(len(g))
            return {"at": at, "gram": gram, "total": total}

        return batch

    met = keep(map_texts(rows, ["__row"], "at array<int>, gram array<bigint>, total bigint", every, "__text", as_bytes=True), "met")
    total = met.agg(F.sum("total")).first()[0] or 0
    own = met.select("__row", F.explode(F.arrays_zip("at", "gram")).alias("x")).select("__row", "x.at", "x.gram")
    own = keep(own.join(placed.select("gram").distinct(), "gram"), "hits")
    spread = own.groupBy("gram").agg(F.count("*").alias("spread"))
    there = placed.join(spread, "gram")
    first = F.min(F.struct("spread", "gram"))["gram"].alias("gram")
    seeds = there.filter(F.col("spread") <= max(RARE, total // COMMON)).select("gram").unionByName(there.groupBy("item", F.floor(F.col("place") / STRIDE)).agg(first).select("gram")).distinct()
    hits = own.join(placed, "gram").groupBy("__row", "item").agg(F.collect_list(F.struct("at", "place", "size", "need")).alias("h"))
    hits = hits.filter(F.size("h") >= F.get("h", F.lit(0))["need"]).groupBy("__row").agg(F.flatten(F.collect_list(F.transform("h", lambda h: F.struct(h["at"].alias("at"), F.col("item").alias("item"), h["place"].alias("place"), h["size"].alias("size"), h["need"].alias("need"))))).alias("__hits"))

    def cut(batches):
        codes = coder()
        for b in batches:
            out = []
            for t, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                c = codes(t)
                out.append(passages(t, c, grams(c), tuple(np.array([h[x] for h in found], np.int64) for x in ("at", "item", "place", "size", "need"))))
            yield pa.RecordBatch.from_arrays([b.column(0), _passage_array(out)], names=["row", "__passages"])

    cols = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]
    hit = rows.join(hits, "__row").select(F.struct(F.lit(True).alias("_"), *cols).alias("row"), "__text", "__hits")
    made = hit.mapInArrow(cut, T.StructType([hit.schema["row"], *T.StructType.fromDDL(f"__passages {PASSAGE}").fields]))
    return keep(made.select("row", F.explode("__passages").alias("p")), "passages"), seeds


def find(docs: DataFrame, benchmark: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, item_id, score (alignment over the most it could be), start, end: one row a copy of LEAST or more."""
    spark = docs.sparkSession
    texts = numbered(benchmark.select("item_id", F.col("text").cast("string").alias("text")))

    def words():
        codes = coder()

        def batch(found):
            made = [codes(t) for t in found]
            return {"codes": [c.tobytes() for c in made], "grams": [grams(c).tolist() for c in made]}

        return batch

    items = keep(map_texts(texts, ["number", "item_id"], "codes binary, grams array<bigint>", words), "items")
    placed = _placed(items)
    rows = docs.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text_col}`").cast("string").alias("__text"))
    if placed.count() <= BOUND:
        met, seeds = _scanned(rows, keys, placed)
        held = spark.sparkContext.broadcast(seeds)
        pairs = met
    else:
        met, seeds = _joined(rows, keys, placed)
        met = keep(met.withColumn("id", F.monotonically_increasing_id()), "passages")

        @F.pandas_udf("array<bigint>")
        def listed(g: pd.Series) -> pd.Series:
            return pd.Series([np.frombuffer(x, np.int64) for x in g])

        good = met.select("id", F.explode(listed("p.grams")).alias("gram")).join(seeds, "gram", "left_semi").select("id").distinct()
        pairs, held = met.join(good, "id", "left_semi"), None
    pairs = pairs.select("row", "p.*").join(items.select(F.col("number").alias("item"), "item_id", F.col("codes").alias("target")), "item")

    @F.pandas_udf("array<struct<score:double,start:int,end:int>>")
    def aligned(target: pd.Series, codes: pd.Series, starts: pd.Series, ends: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        seeds = None if held is None else held.value
        for t, c, a, b, g in zip(target, codes, starts, ends, own, strict=True):
            item, text = np.frombuffer(t, np.uint64), np.frombuffer(c, np.uint64)
            if seeds is not None and not met_by(np.frombuffer(g, np.int64), seeds) or np.isin(text, item).sum() < LEAST * len(item):
                out.append([])
                continue
            first, last = np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)
            out.append([{"score": s, "start": int(first[i]), "end": int(last[j - 1])} for s, i, j in copies(item, text)])
        return pd.Series(out)

    done = pairs.select("row", "item_id", F.explode(aligned("target", "codes", "starts", "ends", "grams")).alias("m"))
    return done.select(*[F.col(f"row.k{i}").alias(k) for i, k in enumerate(keys) if k not in ("item_id", "score", "start", "end")], "item_id", "m.score", "m.start", "m.end")


def met_by(own: np.ndarray, seeds: np.ndarray) -> bool:
    """Whether one of own is among the sorted seeds."""
    at = np.searchsorted(seeds, own)
    return bool(len(seeds) and (seeds[np.minimum(at, len(seeds) - 1)] == own).any())
