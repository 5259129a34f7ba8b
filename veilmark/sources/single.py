"""One ordered output file: parts are written in order by all tasks, then laid end to end by the file system, and the whole is renamed into place."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veilmark.scratch import drop, folder


def write_lines(df: DataFrame, order: list, line: Column, path: str, lead: str = "", between: str = "\n", trail: str = "\n") -> None:
    """lead, the lines of df by order with `between` after each but the last, and trail (lead and trail alone if there are none)."""
    spark = df.sparkSession
    at = folder(spark, "single")
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(line.alias("line")).write.option("lineSep", between).text(at)
    join_parts(spark, at, path, lead, between, trail)
    drop(spark, at)


def join_parts(spark: SparkSession, at: str, path: str, lead: str, between: str, trail: str) -> None:
    """The bytes of all parts in a folder as one file; they pass through a buffer, never whole."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(at), jvm.org.apache.hadoop.fs.Path(path)
    fs, to = source.getFileSystem(conf), target.getFileSystem(conf)
    parts = sorted((str(s.getPath().getName()), s) for s in fs.listStatus(source) if s.getPath().getName().startswith("part-"))
    parts = [s for _, s in parts if s.getLen() > 0]
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}._writing")
    out = to.create(draft, True)
    out.write(bytearray((lead if parts or between != ",\n" else lead.strip()).encode()))
    for n, s in enumerate(parts):
        stream = fs.open(s.getPath())
        if n == len(parts) - 1:  # without what stands between lines
            stream = jvm.org.apache.commons.io.input.BoundedInputStream(stream, s.getLen() - len(between.encode()))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
        stream.close()
    out.write(bytearray((trail if parts else trail.lstrip("\r\n")).encode()))
    out.close()
    to.delete(target, True)
    if not to.rename(draft, target):
        raise OSError(f"{path} could not be put in place")


def csv_field(value: Column, delimiter: str) -> Column:
    """Quoted only where it must be; null is empty."""
    value = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(value.rlike('[\\r\\n"' + ("\\" if delimiter in "\\]^-[" else "") + delimiter + "]"), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def csv_name(name: str, delimiter: str) -> str:
    return '"' + name.replace('"', '""') + '"' if any(c in name for c in ('"', "\r", "\n", delimiter)) else name


def write_csv(df: DataFrame, order: list, columns: list[str], path: str, delimiter: str = ",", header: bool = True) -> None:
    """Lines end as the csv module ends them."""
    lead = delimiter.join(csv_name(c, delimiter) for c in columns) + "\r\n" if header else ""
    line = F.concat_ws(delimiter, *[csv_field(F.col(f"`{c}`"), delimiter) for c in columns])
    write_lines(df, order, line, path, lead, "\r\n", "\r\n")


@F.arrow_udf(StringType())
def _pretty(records: pa.Array) -> pa.Array:
    lines = (None if r is None else json.dumps(json.loads(r), ensure_ascii=False, indent=2) for r in records.to_pylist())
    return pa.array([None if x is None else "  " + x.replace("\n", "\n  ") for x in lines], pa.string())


def write_json(df: DataFrame, order: list, path: str, record: str = "record") -> None:
    """An array of the records' JSON, each key and value where it stood, by two blanks a level."""
    write_lines(df.filter(F.col(record).isNotNull()), order, _pretty(F.col(record)), path, "[\n", ",\n", "\n]")


def write_text(df: DataFrame, order: list, path: str, text: Column) -> None:
    write_lines(df, order, F.coalesce(text, F.lit("")), path)
