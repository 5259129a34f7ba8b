"""Hilbert-curve sharding, DataFrame operations only.

Language, source and text size are quantised to LEVEL bits each at approximate quantiles (strings by their leading
bytes, so order is kept), interleaved to a Hilbert index, and rows are cut into runs along (cell, text hash, doc_id).
Rows are range-partitioned and sorted along the curve and kept; a row's rank is its place in its partition plus what
earlier partitions hold, one count each.  A number of its own ends each row's key, so ranges split hot cells, copies and
repeated rows alike.  Law: rows.

Results by case: null metadata quantises lowest; null text has size 16 and the crc32 of nothing; repeated rows and rows
alike in cell, text and doc_id take neighbouring slots in any order; texts count whole; an empty table gives no rows;
columns named like an output are not returned by assign(), and written by write() as they are but for shard and slot,
which the outputs replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

LEVEL = 4


def hilbert(coords: tuple[int, ...], bits: int) -> int:
    """Index of a cell along the Hilbert curve: per level one digit, read in the frame of the cell reached so far.

    The frame is a rotation of the axes and a mask of mirrored ones, carried from the top bit down.
    """
    n = len(coords)
    whole = (1 << n) - 1
    rotate = lambda x, k: (x << k % n | x >> n - k % n) & whole
    index = flip = turn = 0
    for level in reversed(range(bits)):
        word = sum((c >> level & 1) << j for j, c in enumerate(coords))
        digit = rotate(word ^ flip, n - (turn + 1) % n)
        for s in (1, 2, 4):
            digit ^= digit >> s
        low = (digit - 1) // 2 * 2 if digit else 0
        odd = digit - (digit % 2 == 0) if digit else 0
        ones = (~odd & odd + 1).bit_length() - 1
        index = index << n | digit
        flip ^= rotate(low ^ low >> 1, (turn + 1) % n)
        turn = (turn + ones % n + 1) % n
    return index


def quantised(df: DataFrame, dims: dict) -> DataFrame:
    """Adds q_<name>: each numeric expression cut at its approximate quantiles to 0 .. 2^LEVEL - 1."""
    cuts = [i / (1 << LEVEL) for i in range(1, 1 << LEVEL)]
    edges = df.agg(*[F.percentile_approx(e, cuts, 10_000).alias(k) for k, e in dims.items()]).first()
    return df.withColumns({f"q_{k}": sum([F.when(e > v, 1).otherwise(0) for v in edges[k] or []], F.lit(0)).cast("int") for k, e in dims.items()})


def leading(col):
    """The first seven bytes of a string as a number that sorts like it."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(F.coalesce(col, F.lit("")), "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("bigint"), F.lit(0))


def ranked(docs: DataFrame, shards: int, carry: bool) -> DataFrame:
    """The columns of assign(), after the whole document as the struct row if carry."""
    row = [F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")] if carry else []
    raw = docs.select(*row, "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), leading(F.col("lang")).alias("k_lang"), leading(F.col("source")).alias("k_source"))
    cells = quantised(raw, {"lang": F.col("k_lang"), "source": F.col("k_source"), "size": F.col("size")})
    side = 1 << LEVEL
    # The curve's table has 4096 numbers whatever the input: it is part of the plan.
    curve = F.lit([hilbert((i // side**2, i // side % side, i % side), LEVEL) for i in range(side**3)])
    boxed = cells.withColumn("box", (F.col("q_lang") * side + F.col("q_source")) * side + F.col("q_size"))
    rows = boxed.withColumn("cell", F.element_at(curve, F.col("box") + 1)).withColumn("own", F.monotonically_increasing_id())
    order = ["cell", "text_crc32", "doc_id", "own"]
    laid = keep(rows.drop("box", "k_lang", "k_source").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "curve")
    # One row a partition.
    parts = laid.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("low"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", "low", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    numbered = laid.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(parts), "part").withColumn("rank", F.col("at") - F.col("low") + F.col("before"))
    # The first (total mod shards) shards take one row more.
    least, more = F.floor(F.col("total") / shards), F.col("total") % shards
    big = more * (least + 1)
    shard = F.when(F.col("rank") < big, F.floor(F.col("rank") / (least + 1))).otherwise(more + F.floor((F.col("rank") - big) / F.greatest(least, F.lit(1))))
    first = F.when(shard <= more, shard * (least + 1)).otherwise(big + (shard - more) * least)
    return numbered.select(*(["row"] if carry else []), "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), (F.col("rank") - first).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("cell").alias("hilbert"))


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    return ranked(docs, shards, False)


def write(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Documents in files by shard, sorted along the curve inside."""
    rest = [(i, c) for i, c in enumerate(docs.columns) if c not in ("shard", "slot")]
    placed = ranked(docs, shards, True).select(*[F.col(f"row.c{i}").alias(c) for i, c in rest], "shard", "slot")
    placed.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
