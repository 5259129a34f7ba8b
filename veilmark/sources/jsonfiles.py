"""JSON files of any shape as records: one row a record, its text as it stands there, in the order of the file.

Lines are read as lines.  Arrays, single objects and objects one after the other, in one line or in many, are cut by Spark at
closing braces, so one large file is many tasks: each piece counts its quotes and brackets for both cases, that it begins in a
string and that it does not; sums along a split and along the splits of a file tell which case holds, how deep each
piece lies, and which record it belongs to.  No task reads a whole file.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilmark.scratch import folder, keep

RECORDS = "file string, rec_idx struct<block:bigint,at:bigint>, record string"


def source_path() -> Column:
    """The file that a row was read from, as file systems name it."""
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:/+", "file:/")


def head(spark: SparkSession, path: str, size: int = 1 << 16) -> bytes:
    """The first bytes of a file in any store."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = to.getFileSystem(spark._jsc.hadoopConfiguration()).open(to)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def ends_line(spark: SparkSession, path: str) -> bool:
    """Whether a file's last byte ends a line."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getFileStatus(to).getLen()
    stream = fs.open(to)
    try:
        stream.seek(max(0, size - 1))
        return bytes(stream.readNBytes(1)) == b"\n"
    finally:
        stream.close()


def files_at(spark: SparkSession, path: str) -> list[str]:
    """The files that a path, folder or pattern names, by name."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s for top in fs.globStatus(to) or () for s in (fs.listStatus(top.getPath()) if top.isDirectory() else [top])]
    return sorted(str(s.getPath()) for s in found if s.isFile() and not s.getPath().getName().startswith(("_", ".")))


def in_lines(start: bytes) -> bool:
    """Whether a file that begins so holds one whole record a line."""
    text = start.decode("utf-8-sig", "ignore").lstrip()
    line, more, _ = text.partition("\n")
    if not line.startswith("{") or not more and len(start) >= 1 << 16:
        return False
    try:
        json.loads(line)
    except ValueError:
        return False
    return True


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    df = spark.read.text(paths).select("value", source_path().alias("file"), F.col("_metadata.file_block_start").alias("block"))
    text = F.regexp_replace("value", r"^[\s\x{FEFF}]+|\s+$", "")
    return df.select("file", F.struct("block", F.monotonically_increasing_id().alias("at")).alias("rec_idx"), text.alias("record")).filter(F.length("record") > 0)


def _depth(parts: Column, odd: int) -> Column:
    """Brackets opened less those closed in every second part, from the first (0) or the second (1)."""
    count = lambda p: F.length(F.regexp_replace(p, r"[^{\[]", "")) - F.length(F.regexp_replace(p, r"[^}\]]", ""))
    own = F.filter(parts, lambda p, i: i % 2 == odd)
    return F.aggregate(own, F.lit(0), lambda total, p: total + count(p))


def _cut(spark: SparkSession, paths: list[str]) -> DataFrame:
    raw = spark.read.option("lineSep", "}").text(paths)
    raw = raw.select(source_path().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    # No piece begins or ends within an escape, since a brace is never escaped.
    parts = F.split(F.regexp_replace("text", r"\\.", ""), '"', -1)
    pieces = keep(raw.withColumn("parts", parts).select("file", "block", "at", "text", ((F.size("parts") - 1) % 2).alias("odd"), _depth(F.col("parts"), 0).alias("out"), _depth(F.col("parts"), 1).alias("in")), "pieces")
    # One task a split, as it was read.
    split = Window.partitionBy("file", "block").orderBy("at")
    upto, before = split.rowsBetween(Window.unboundedPreceding, 0), split.rowsBetween(Window.unboundedPreceding, -1)
    files = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    now = pieces.withColumn("flip", F.sum("odd").over(upto) % 2).withColumn("was", (F.col("flip") + F.col("odd")) % 2)
    # If the split begins outside of a string (a) or in one (b): brackets of the piece, and its closing brace if that counts.
    for case, outside in (("a", 0), ("b", 1)):
        own = F.when(F.col("was") == outside, F.col("out")).otherwise(F.col("in"))
        now = now.withColumn(f"d{case}", own).withColumn(f"c{case}", F.when(F.col("flip") == outside, 1).otherwise(0))
        now = now.withColumn(f"u{case}", F.coalesce(F.sum(F.col(f"d{case}") - F.col(f"c{case}")).over(before), F.lit(0)) + F.col(f"d{case}"))
    now = keep(now, "pieces")
    splits = now.groupBy("file", "block").agg((F.sum("odd") % 2).alias("odd"), *[F.sum(F.col(f"d{c}") - F.col(f"c{c}")).alias(f"t{c}") for c in "ab"])
    splits = splits.withColumn("inside", F.coalesce(F.sum("odd").over(files), F.lit(0)) % 2)
    splits = splits.withColumn("low", F.coalesce(F.sum(F.when(F.col("inside") == 0, F.col("ta")).otherwise(F.col("tb"))).over(files), F.lit(0))).select("file", "block", "inside", "low")
    # Depth after the text of each piece and, if its brace closes one, after that; records end where depth is back at the top.
    top = now.groupBy("file").agg(F.min_by(F.regexp_extract("text", r"^[\s\x{FEFF}]*(.)", 1), F.struct("block", "at")).alias("begins"), F.max(F.struct("block", "at")).alias("end"))
    at = now.join(splits, ["file", "block"]).join(top, "file")
    of = lambda name: F.when(F.col("inside") == 0, F.col(f"{name}a")).otherwise(F.col(f"{name}b"))
    at = at.withColumns({"depth": F.col("low") + of("u"), "closes": of("c"), "base": (F.col("begins") == "[").cast("int")})
    # A file's last piece ends with a brace only if something is open after it.
    last = (F.struct("block", "at") == F.col("end")) & (F.col("depth") <= 0)
    closes = (F.col("closes") == 1) & ~last
    at = at.withColumn("ends", (closes & (F.col("depth") - 1 == F.col("base"))).cast("int")).withColumn("text", F.when(last, F.col("text")).otherwise(F.concat("text", F.lit("}"))))
    at = at.withColumn("n", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    done = keep(at.select("file", "block", "at", "text", "ends", "n"), "pieces")
    ends = done.groupBy("file", "block").agg(F.sum("ends").alias("ends")).withColumn("earlier", F.coalesce(F.sum("ends").over(files), F.lit(0))).select("file", "block", "earlier")
    whole = done.join(ends, ["file", "block"]).groupBy("file", (F.col("earlier") + F.col("n")).alias("no")).agg(F.array_sort(F.collect_list(F.struct("block", "at", "text"))).alias("p"))
    text = F.regexp_replace(F.array_join(F.transform("p", lambda x: x["text"]), ""), r"^[\s,\[\x{FEFF}]+", "")
    found = whole.select("file", F.struct(F.lit(0).cast("bigint").alias("block"), F.col("no").alias("at")).alias("rec_idx"), text.alias("record"))
    # What is left after the last record is its array's end; anything else is no record.
    odd = F.when(F.col("record").startswith("{"), F.col("record")).otherwise(F.raise_error(F.concat(F.lit("not a record: "), F.substring("record", 1, 60))))
    return found.filter(~F.col("record").rlike(r"^[\s\],]*$")).withColumn("record", odd)


def json_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, rec_idx (place in the file) and record, the JSON text of one."""
    paths = [p for x in ([path] if isinstance(path, str) else path) for p in files_at(spark, x)]
    lines = [p for p in paths if in_lines(head(spark, p))]
    other = [p for p in paths if p not in set(lines)]
    made = [read(spark, some) for read, some in ((_lines, lines), (_cut, other)) if some]
    if not made:
        return spark.createDataFrame([], RECORDS)
    return made[0].unionByName(made[1]) if len(made) > 1 else made[0]


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """Columns of all records: those of unlike keys get null for what they lack, and of unlike types text."""
    paths = files_at(spark, path)
    if not paths:
        raise ValueError(f"no file at {path}")
    if all(in_lines(head(spark, p)) for p in paths):
        return spark.read.json(paths)
    # One record a line, without the line ends between its values.
    at = folder(spark, "lines")
    json_records(spark, path).orderBy("file", "rec_idx").select(F.regexp_replace("record", r"[\r\n]+", " ")).write.text(at)
    return spark.read.json(at)
