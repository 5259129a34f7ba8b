"""Training order: a keyed Feistel permutation with cycle-walking gives each sequence one global slot.

Texts become token ids of a byte-level vocabulary in one narrow pass; every task lays its texts one after the other, each closed by the end mark, and
cuts the run into sequences of STRIDE ids, so only a task's last one is padded.  The sequences are kept in the shared
folder, compressed with a dictionary of a few texts' ids until they are written, which fixes their numbers: a sequence's number is its place in its task's run, offset by what earlier tasks hold
(one count a task), so no key and no group of copies meets in one task.  The number is permuted within [0, n), and range
partitions of slots write fixed-stride records: shard=S/piece=P holds records of shard S from its record P on, up to the next
piece, so record r begins at byte (r - P) * stride of the piece with the greatest P up to r, and reading can resume there.
Pieces are of PIECE records (4 MB) and, in tables of more than PIECES of them, of twice, four times ... up to LARGE (136 MB).  A record is STRIDE little-endian ids of WIDTH bytes, then the FIELDS as text of fixed width, then
END, two characters of three bytes: the second or the first would begin at the high byte of an id, which is always less.

Results by case: null and empty texts, and texts without a token, hold no ids and no end mark; repeated rows and rows with
equal or null doc_id keep ids of their own; ties do not arise, numbers are distinct; texts of any length are cut, never
shortened; other columns are not read; an empty table gives no sequence.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import keep, scratch_root

STRIDE, WIDTH, ROUNDS = 2048, 2, 4
PIECE, LARGE, PIECES, END = 1024, 32_768, 1024, "￿￿"
#: Width of each text field after the ids: the slot, and the document and place in its ids of the first id here.
FIELDS = {"slot": 19, "doc_id": 20, "at": 10, "n_ids": 4}
RECORD = WIDTH * STRIDE + sum(FIELDS.values()) + len(END.encode())
#: Ids from here on could hold a byte of END at their high end.
MOST = 0xEF00
#: Texts that the dictionary of the kept sequences is made of; it changes their size only.
SAMPLE, DICTIONARY = 500, 112_640


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The image of x under a bijection of [0, n)."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)
    x, todo = x.astype(np.uint64).copy(), np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for r in range(ROUNDS):
            h = right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (1 << 64) - 1)
            h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            left, right = right, left ^ h & mask
        x[todo] = left << np.uint64(half) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Ranks and the pattern of a public vocabulary."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, public_tokenizers.PATTERN


def token_bytes(vocab: tuple[dict[bytes, int], str]):
    """A function from a text to its ids, WIDTH bytes each."""
    import tiktoken

    ranks, pattern = vocab
    if max(ranks.values()) >= MOST:
        raise ValueError("ids of this vocabulary do not fit into WIDTH bytes before END")
    coder = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: np.array(coder.encode_ordinary(text), f"<u{WIDTH}").tobytes() if text else b""


def dictionary(docs: DataFrame, vocab) -> bytes:
    """What few ids compress with; empty for tables too small to train one."""
    import zstandard

    ids_of = token_bytes(vocab)
    texts = [r[0] for r in docs.select(F.substring("text", 1, 8 * STRIDE)).filter(F.length("text") > 0).limit(SAMPLE).collect()]
    data = b"".join(map(ids_of, texts))
    size = WIDTH * STRIDE
    return zstandard.train_dictionary(DICTIONARY, [data[i : i + size] for i in range(0, len(data), size)]).as_bytes() if len(data) > 10 * DICTIONARY else b""


def sequences(docs: DataFrame, vocab, end_id: int, helper: bytes) -> DataFrame:
    """run (task << 33 | place), doc_id, at, n_ids, packed: kept, so that each row keeps its number."""
    held = docs.sparkSession.sparkContext.broadcast((vocab, helper))

    def cut(batches):
        import zstandard

        ids_of, size = token_bytes(held.value[0]), WIDTH * STRIDE
        squeeze = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(held.value[1]) if held.value[1] else None)
        close = end_id.to_bytes(WIDTH, "little")
        rest, first = b"", (None, 0)
        out = {"doc_id": [], "at": [], "n_ids": [], "packed": []}

        def rows():
            made = pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["at"], pa.int64()), pa.array(out["n_ids"], pa.int32()), pa.array(out["packed"], pa.binary())], names=list(out))
            for x in out.values():
                x.clear()
            return made

        def put(doc_id, at, data):
            out["doc_id"].append(doc_id)
            out["at"].append(at)
            out["n_ids"].append(len(data) // WIDTH)
            out["packed"].append(squeeze.compress(data))

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = ids_of(text)
                if not data:
                    continue
                data += close
                done = 0
                while len(rest) + len(data) - done >= size:
                    take = size - len(rest)
                    put(*(first if rest else (doc_id, done // WIDTH)), rest + data[done : done + take])
                    rest, done = b"", done + take
                if done < len(data):
                    first = first if rest else (doc_id, done // WIDTH)
                    rest += data[done:]
                if len(out["n_ids"]) >= 256:
                    yield rows()
        if rest:
            put(*first, rest)
        yield rows()

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = texts.mapInArrow(cut, "doc_id bigint, at bigint, n_ids int, packed binary")
    return keep(made.select(F.monotonically_increasing_id().alias("run"), "*"), "sequences")


def unpacked(df: DataFrame, helper: bytes) -> DataFrame:
    """df with ids (STRIDE of them, zeros after n_ids) in place of packed, which is its last column."""
    held = df.sparkSession.sparkContext.broadcast(helper)

    def widen(batches):
        import zstandard

        open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held.value) if held.value else None)
        for b in batches:
            ids = [open_.decompress(x).ljust(WIDTH * STRIDE, b"\0") for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.binary())], names=[*b.schema.names[:-1], "ids"])

    return df.mapInArrow(widen, StructType(df.schema.fields[:-1]).add("ids", "binary"))


def piece_records(total: int) -> int:
    size = PIECE
    while size < LARGE and total > size * PIECES:
        size *= 2
    return size


def placed(rows: DataFrame, key: int, shard_records: int) -> DataFrame:
    """doc_id, at, n_ids, slot, shard, record, packed of sequences."""
    rows = rows.withColumn("task", F.shiftright("run", 33))
    # One row a task: the running count goes to every task.
    sizes = rows.groupBy("task").agg(F.count("*").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy()).alias("total"))

    @F.pandas_udf("bigint")
    def slot(number, total):
        import pandas as pd

        return pd.Series(permute(number.to_numpy(), int(total.iloc[0]), key) if len(number) else [])

    number = F.col("base") + F.col("run").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = rows.join(F.broadcast(base), "task").withColumn("slot", slot(number, "total"))
    return numbered.select("doc_id", "at", "n_ids", "slot", F.floor(F.col("slot") / shard_records).cast("int").alias("shard"), (F.col("slot") % shard_records).cast("int").alias("record"), "packed")


def write(docs: DataFrame, path: str, key: int = 20_240_601, shard_records: int = 65_536, vocab=None, end_id: int = 50_256) -> None:
    """Files of records of RECORD bytes in slot order; zeros follow a record's n_ids ids.  end_id closes each text."""
    vocab = vocab or vocabulary()
    helper = dictionary(docs, vocab)
    cut = sequences(docs, vocab, end_id, helper)
    size = piece_records(cut.count())
    rows = placed(cut, key, shard_records).withColumn("piece", (F.floor(F.col("record") / size) * size).cast("int"))
    # A range of slots a task, and each piece in one.
    dealt = unpacked(rows.repartitionByRange("shard", "piece").select("shard", "piece", "record", *FIELDS, "packed"), helper).sortWithinPartitions("shard", "piece", "record")
    fields = [F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("")), n, " ").cast("binary") for c, n in FIELDS.items()]
    dealt.select("shard", "piece", F.concat("ids", *fields).cast("string").alias("value")).write.partitionBy("shard", "piece").option("lineSep", END).option("compression", "none").text(path)


def read(spark, path: str) -> DataFrame:
    """slot, doc_id, at, n_ids, ids, and shard and piece by the file, of every record that write() made."""
    raw = spark.read.option("lineSep", END).text(path).withColumn("data", F.col("value").cast("binary"))
    if "shard" not in raw.columns:  # nothing was written
        raw = raw.withColumns({"shard": F.lit(0), "piece": F.lit(0)}).limit(0)
    begin, out = WIDTH * STRIDE + 1, {}
    for c, n in FIELDS.items():
        text = F.trim(F.expr(f"substring(data, {begin}, {n})").cast("string"))
        out[c] = F.when(text != "", text).cast("int" if c == "n_ids" else "bigint")
        begin += n
    found = raw.select(*[v.alias(c) for c, v in out.items()], "data", "shard", "piece")
    return found.select(*FIELDS, F.expr(f"substring(data, 1, {WIDTH} * n_ids)").alias("ids"), "shard", "piece")


def written(docs: DataFrame, key: int = 20_240_601, shard_records: int = 65_536) -> DataFrame:
    """slot, shard, record, doc_id, at, n_ids and ids_crc32 of records written and read back."""
    spark = docs.sparkSession
    path = f"{scratch_root(spark)}/order-{uuid.uuid4().hex}"
    write(docs, path, key, shard_records)
    return read(spark, path).select("slot", "shard", (F.col("slot") % shard_records).cast("int").alias("record"), "doc_id", "at", "n_ids", F.crc32("ids").alias("ids_crc32"))
