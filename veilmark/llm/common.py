"""Shared plumbing of the training-data operators: shared scratch tables, Arrow batch helpers, word rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.scratch import keep, scratch_root

#: A word of the shingle operators: a run of anything but the six ASCII white-space characters.
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def session_defaults(spark: SparkSession) -> None:
    """Small Arrow batches, since one text may be megabytes long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_texts(
    df: DataFrame,
    keys: list[str],
    schema: str,
    setup: Callable[[], Callable[[list], dict[str, list]]],
    text_col: str = "text",
    as_bytes: bool = False,
) -> DataFrame:
    """A narrow, Arrow-batched pass over whole texts, as UTF-8 if as_bytes.

    setup() runs once a task and returns batch(texts) -> columns by name; the key columns pass through unchanged, but for
    those named like a column that is made, which the made one replaces.
    """
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(schema)
    keys = [k for k in keys if k not in made.names]
    text = F.col(f"`{text_col}`").cast("string")
    picked = df.select(*[F.col(f"`{k}`") for k in keys], (text.cast("binary") if as_bytes else text).alias("__text"))
    target = StructType([picked.schema[k] for k in keys] + list(made.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(target)
        work = None
        for b in batches:
            work = work or setup()
            made = work(b.column(len(keys)).to_pylist())
            cols = [b.column(i).cast(out.field(i).type) for i in range(len(keys))]
            cols += [pa.array(made[f.name], type=f.type) for f in list(out)[len(keys) :]]
            yield pa.RecordBatch.from_arrays(cols, schema=out)

    return picked.mapInArrow(run, target)


def crc_mod(col, n: int):
    """crc32 of the value written as text, modulo n; null for null."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary") if isinstance(col, str) else col.cast("string").cast("binary")), F.lit(n))


__all__ = ["ASCII_SPACE", "WORD", "crc_mod", "documents", "keep", "map_texts", "scratch_root", "session_defaults"]
