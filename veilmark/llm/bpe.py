"""BPE by a distinct-word table.

Words are runs between ASCII white space, at which the tokenizer always splits; units are words whose signs at the end
part from a letter or digit before them, in lower case if ASCII, as the tokenizer does both.  Frequent words and their
units (at most 3 x HEAD, merged from each task's most frequent words) are encoded once, in one task, and go to every
task by the driver.  One pass over the texts turns each block of rows (BLOCK bytes of text at most, one text at least) into a stream of numbers, of the frequent words and units, or of the block's own distinct rare units, which it hands
on dealt by their hash.  That table is kept in the shared folder.  Rare units meet their equals, each is encoded once, and the ids
return to the block by position, so a unit travels once a block however often it is written there.  Texts themselves do
not travel unless their column is asked for, and then packed by block.  Which units are in the head, and where blocks end, changes no result.
Decoding looks ids up in the vocabulary's piece table, whose size is fixed: the join's small side sits in the plan.

Results by case: null counts as empty and stays null, and empty texts have no ids; repeated rows are all returned; texts
are encoded whole; an empty table gives none; extra columns pass through, but for one named like the output, which the
output replaces.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import keep

HEAD, LOCAL_HEAD = 1 << 18, 1 << 16
#: Bytes of text in a block, and occurrences of rare units that one deal of them takes.
BLOCK, DEAL = 1 << 23, 200_000
SPACE = re.compile("[ \t\n\x0b\f\r]+")
SIGNS = ".,;:!?%*"
#: Characters that are letters or digits in every version of Unicode.
FIRM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") | frozenset(map(chr, (*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))))
#: The length of a null text.
NULL = 0xFFFFFFFF
#: What a row of the kept table holds.
UNITS, STREAM, TEXTS, ROW = 0, 1, 2, 3


def tokenizer(source: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(source)
    t.no_truncation()
    t.no_padding()
    return t


def words_of(text: str | None) -> list[str]:
    return [w for w in SPACE.split(text or "") if w]


def units(word: str) -> list[str]:
    core = word.rstrip(SIGNS)
    tail = word[len(core) :] if core and core[-1] in FIRM else ""
    core = core if tail else word
    core = core.lower() if core.isascii() and "<|" not in core else core
    return [core, tail] if tail else [core]


def head_table(docs: DataFrame, text_col: str, head: int, source: str) -> tuple[bytes, np.ndarray, np.ndarray, int]:
    """At most head frequent words and their units, with a space between each two; how many ids each has, and the ids; how often
    all other words occur.

    Every task counts its words, drops seldom ones as its table fills, and hands on LOCAL_HEAD; one task, bounded by head, encodes."""

    def count(batches):
        seen: Counter = Counter()
        total = 0
        for b in batches:
            for t in b.column(0).to_pylist():
                words = (t or b"").split()
                total += len(words)
                seen.update(words)
                if len(seen) > 4 * LOCAL_HEAD:
                    seen = Counter(dict(seen.most_common(LOCAL_HEAD)))
        top = seen.most_common(LOCAL_HEAD)
        words, counts = [w for w, _ in top], [n for _, n in top]
        yield pa.RecordBatch.from_arrays([pa.array([None, *words], pa.binary()), pa.array([total, *counts], pa.int64())], names=["word", "n"])

    def encoded(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, rest = [], 0
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rest += n if w is None else -n
                if w is not None:
                    words.append(w.decode("utf-8", "replace"))
        top = list(dict.fromkeys([*words, *(u for w in words for u in units(w))]))
        t, sizes, flat = tokenizer(source), array("q"), array("i")
        for i in range(0, len(top), 4096):
            for e in t.encode_batch_fast(top[i : i + 4096], add_special_tokens=False):
                sizes.append(len(e.ids))
                flat.extend(e.ids)
        row = (" ".join(top).encode(), sizes.tobytes(), flat.tobytes())
        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in row), pa.array([rest], pa.int64())], names=["words", "sizes", "flat", "rest"])

    counted = docs.select(F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")).mapInArrow(count, "word binary, n bigint")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.col("word").isNotNull(), F.desc("n"), "word").limit(head + 1)
    rows = top.mapInArrow(encoded, "words binary, sizes binary, flat binary, rest bigint").collect()
    if not rows:
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int32), 0
    r = rows[0]
    return bytes(r["words"]), np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["flat"], np.int32), r["rest"]


@lru_cache(maxsize=1)
def numbers(head: bytes) -> dict[bytes, bytes]:
    """word -> its number in four bytes, of words with a space between each two."""
    return {w: n.to_bytes(4, "little") for n, w in enumerate(head.split(b" "))} if head else {}


def filled(stream: np.ndarray, flat: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a stream of units, of which number u holds sizes[u] ids of flat, and where each text of lengths units ends."""
    n = sizes[stream]
    ends = np.concatenate([[0], np.cumsum(n)])
    first = np.cumsum(sizes) - sizes
    return flat[np.repeat(first[stream] - ends[:-1], n) + np.arange(ends[-1])], ends[np.concatenate([[0], np.cumsum(lengths)])]


def packed(numbers: np.ndarray, squeeze) -> bytes:
    """Compressed, with all low bytes before all higher ones."""
    return squeeze.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes, widen) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(widen.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def encode(docs: DataFrame, source: str, text_col: str = "text", out_col: str = "ids", head: int = HEAD, drop_text: bool = False) -> DataFrame:
    """docs (without the text if drop_text) plus out_col array<int>."""
    spark = docs.sparkSession
    words, sizes, flat, rest = head_table(docs, text_col, head, source)
    held, held_source = spark.sparkContext.broadcast(words), spark.sparkContext.broadcast(source)
    # The frequent come first, so their numbers are small.
    table = spark.sparkContext.broadcast((sizes, flat))
    del words, sizes, flat
    deals = 1 + rest // DEAL
    cols = [c for c in docs.columns if c not in (out_col, text_col)]
    row = F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)]).alias("row")
    given = docs.select(F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"), row)
    made = StructType.fromDDL("block bigint, kind int, at int, deal int, data binary").add("row", given.schema["row"].dataType)

    def streams(batches):
        import zstandard

        squeeze, known = zstandard.ZstdCompressor(level=9), numbers(held.value)
        size = len(known)

        def blocks():
            """Lists of texts and their rows: as many as BLOCK bytes of text hold, one at least, across batches."""
            texts, rows, room = [], [], BLOCK
            for b in batches:
                found, first = b.column(0).to_pylist(), 0
                for i, text in enumerate(found):
                    need = len(text or b"") + 64
                    if need > room and (texts or i > first):
                        yield texts + found[first:i], [*rows, b.column(1).slice(first, i - first)]
                        texts, rows, first, room = [], [], i, BLOCK
                    room -= need
                texts += found[first:]
                rows.append(b.column(1).slice(first))
            if texts:
                yield texts, rows

        for texts, rows in blocks():
            number, parts = {}, {}
            lengths, stream = [], []
            for text in texts:
                words = (text or b"").split()
                codes = list(map(known.get, words))
                if None in codes:
                    for i, c in enumerate(codes):
                        if c is None:
                            w = words[i]
                            if w not in parts:
                                ids = b""
                                for u in units(w.decode("utf-8", "replace")):
                                    k = u.encode()
                                    ids += known[k] if k in known else (size + number.setdefault(k, len(number))).to_bytes(4, "little")
                                parts[w] = ids
                            codes[i] = parts[w]
                data = b"".join(codes)
                lengths.append(len(data) // 4)
                stream.append(data)
            flat = np.frombuffer(b"".join(stream), "<u4").copy()
            # Gaps are numbered by deal, then as they came.
            rare = list(number)
            dealt = np.array([zlib.crc32(u) % deals for u in rare], np.int64)
            order = np.argsort(dealt, kind="stable")
            place = np.empty(len(rare), np.uint32)
            place[order] = np.arange(size, size + len(rare), dtype=np.uint32)
            gap = flat >= size
            flat[gap] = place[flat[gap] - size]
            cuts = np.flatnonzero(np.diff(dealt[order], prepend=-1)).tolist()
            packs = [squeeze.compress(b" ".join(rare[k] for k in order[i:j])) for i, j in zip(cuts, [*cuts[1:], len(rare)])]
            packs.append(packed(np.concatenate([np.array([len(texts), *lengths]), flat]), squeeze))
            kinds = [UNITS] * (len(packs) - 1) + [STREAM]
            if not drop_text:
                sizes = np.array([NULL if t is None else len(t) for t in texts], "<u4")
                packs.append(squeeze.compress(sizes.tobytes() + b"".join(t or b"" for t in texts)))
                kinds.append(TEXTS)
            n, k = len(texts), len(packs)
            spare = k - len(cuts)
            key = uuid.uuid4().int >> 65
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * (n + k), pa.int64()), pa.array(kinds + [ROW] * n, pa.int32()), pa.array([*cuts, *[n] * spare, *range(n)], pa.int32()), pa.array([*dealt[order][cuts].tolist(), *[None] * (n + spare)], pa.int32()), pa.array(packs + [None] * n, pa.binary()), pa.concat_arrays([pa.nulls(k, rows[0].type), *rows])],
                names=["block", "kind", "at", "deal", "data", "row"],
            )

    blocks = keep(given.mapInArrow(streams, made), "blocks")

    def encoded(batches):
        import zstandard

        # One core a task: the library would otherwise take all of an executor's.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        squeeze, widen = zstandard.ZstdCompressor(level=5), zstandard.ZstdDecompressor()
        t, last, ids = tokenizer(held_source.value), None, {}
        for b in batches:
            counts, out = [], []
            for deal, data in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if deal != last:
                    last, ids = deal, {}
                rare = widen.decompress(data).split(b" ")
                fresh = [u for u in rare if u not in ids]
                for i in range(0, len(fresh), 4096):
                    part = fresh[i : i + 4096]
                    for u, e in zip(part, t.encode_batch_fast([u.decode("utf-8", "replace") for u in part], add_special_tokens=False), strict=True):
                        ids[u] = e.ids
                own = [ids[u] for u in rare]
                counts.append(len(own))
                out.append(packed(np.array([*map(len, own), *(i for x in own for i in x)]), squeeze))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([UNITS] * len(out), pa.int32()), pa.array(counts, pa.int32()), pa.array(out, pa.binary())], names=["block", "at", "kind", "n", "data"])

    found = blocks.filter(F.col("kind") == UNITS).select("block", "at", "deal", "data").repartition("deal").sortWithinPartitions("deal").mapInArrow(encoded, "block bigint, at int, kind int, n int, data binary")
    both = found.withColumn("row", F.lit(None).cast(given.schema["row"].dataType)).unionByName(blocks.filter(F.col("kind") != UNITS).select("block", "at", "kind", F.lit(None).cast("int").alias("n"), "data", "row"))

    def joined(batches):
        import zstandard

        widen, (head_sizes, head_flat) = zstandard.ZstdDecompressor(), table.value
        last, sizes, flats, flat, ends, whole, cuts = None, [], [], head_flat, [], b"", []
        for b in batches:
            rows, ids, texts = [], [head_flat[:0]], []
            block, at, kind, n, data = (b.column(i).to_pylist() for i in range(5))
            for i in range(b.num_rows):
                if block[i] != last:
                    last, sizes, flats = block[i], [head_sizes], [head_flat]
                if kind[i] == UNITS:
                    x = unpacked(data[i], widen)
                    sizes.append(x[: n[i]])
                    flats.append(x[n[i] :].astype(np.int32))
                elif kind[i] == STREAM:
                    x = unpacked(data[i], widen)
                    k = int(x[0])
                    flat, ends = filled(x[1 + k :], np.concatenate(flats), np.concatenate(sizes), x[1 : 1 + k])
                elif kind[i] == TEXTS:
                    data_of = widen.decompress(data[i])
                    lengths, whole = np.frombuffer(data_of[: 4 * at[i]], "<u4"), data_of[4 * at[i] :]
                    real = np.where(lengths == NULL, 0, lengths).astype(np.int64)
                    cuts = [None if z == NULL else (e - z, e) for z, e in zip(lengths.tolist(), np.cumsum(real).tolist(), strict=True)]
                else:
                    rows.append(i)
                    if not drop_text:
                        texts.append(cuts[at[i]] and whole[slice(*cuts[at[i]])])
                    ids.append(flat[ends[at[i]] : ends[at[i] + 1]])
            to = np.cumsum([*map(len, ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(5).take(pa.array(rows, pa.int64())), pa.array([None] * len(rows) if drop_text else texts, pa.binary()), pa.ListArray.from_arrays(pa.array(to), pa.array(np.concatenate(ids)))], names=["row", "text", "ids"])

    out = both.select("block", "at", "kind", "n", "data", "row").repartition("block").sortWithinPartitions("block", "kind", "at").mapInArrow(joined, StructType().add("row", given.schema["row"].dataType).add("text", "binary").add("ids", ArrayType(IntegerType())))
    text = F.col("text").cast("string").alias(text_col)
    return out.select(*[text if c == text_col else F.col(f"row.c{cols.index(c)}").alias(c) for c in docs.columns if c != out_col and not (drop_text and c == text_col)], F.col("ids").alias(out_col))


def decode(df: DataFrame, source: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df plus out_col: ids through the piece table, joined as the tokenizer does without a decoder: by one space.

    The table is one literal of the plan (an id is its place there), so no row is exploded to be joined and put together
    again; an id outside it gives nothing, a null list an empty text."""
    t = tokenizer(source)
    pieces = F.split(F.lit("\x01".join(t.id_to_token(i) or "" for i in range(t.get_vocab_size()))), "\x01")
    return df.withColumn(out_col, F.coalesce(F.array_join(F.transform(F.col(ids_col), lambda i: F.get(pieces, i)), " "), F.lit("")))


def digest(df: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return df.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))
