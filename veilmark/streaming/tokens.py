"""Token numbering on a stream: each micro-batch adds its new values to a dictionary in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.operators.text import detect_spans, splice
from veilmark.operators.tokens import occurrences, token_dictionary, with_numbers, with_tokens
from veilmark.scratch import keep, with_tables

WORDS = "batch bigint, grp string, prefix string, norm string, original string, num bigint, token string"


def dictionary_at(spark, path: str, before: int | None = None) -> DataFrame:
    """The dictionary so far (of batches before a number)."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], WORDS)
    found = spark.read.schema(WORDS).parquet(path)
    return found if before is None else found.filter(F.col("batch") < before)


def pseudonymise_batch(key: str, text_col: str, dictionary: str, out: str, numbering: str = "type", **options) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: a batch's new values are numbered after those of earlier batches, and its rows written.

    Each batch reads the dictionary so far; streaming.state keeps it in a state store instead.  Both tables are written under the batch's number and replaced if it is run again, so each batch counts once.
    """

    def run(batch: DataFrame, number: int) -> None:
        with with_tables(batch.sparkSession):
            write(batch, number)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = keep(detect_spans(batch, text_col, **options).withColumn("__row", F.monotonically_increasing_id()), "stream")
        spans = occurrences(rows.select(F.col(key).alias("__key"), "__row", "spans"), "__key")
        old = dictionary_at(spark, dictionary, number).select("grp", "prefix", "norm", "original", "num", "token")
        made = token_dictionary(spans, "__key", "__row", numbering=numbering)
        fresh = made.join(old.select("grp", "norm").distinct(), ["grp", "norm"], "left_anti")
        # Numbers of the new values alone, after the highest of their group: one row a group.
        again = keep(fresh.select("grp", "prefix", "norm", "original", "num"), "fresh")
        top = old.groupBy("grp").agg(F.max("num").alias("__top"))
        rank = with_numbers(again.select("grp", "norm", "num").distinct().withColumnRenamed("num", "__pos"), "grp", "__pos").select("grp", "norm", F.col("num").alias("__n"))
        placed = again.join(rank, ["grp", "norm"]).join(F.broadcast(top), "grp", "left").withColumn("num", F.col("__n") + F.coalesce("__top", F.lit(0)))
        new = placed.select(F.lit(number).cast("bigint").alias("batch"), "grp", "prefix", "norm", "original", "num", F.concat(F.lit("["), "prefix", F.lit("_"), F.col("num").cast("string"), F.lit("]")).alias("token"))
        new.write.mode("overwrite").parquet(f"{dictionary.rstrip('/')}/part={number}")
        words = dictionary_at(spark, dictionary, number + 1).select("grp", "prefix", "norm", "original", "num", "token")
        pieces = with_tokens(spans, words, numbering).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("token").alias("repl")))).alias("__pieces"))
        done = rows.join(pieces, "__row", "left").withColumn("result", F.when(F.col("__pieces").isNull(), F.col(text_col)).otherwise(splice(F.col(text_col), F.col("__pieces"))))
        done.select(*batch.columns, "result").write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return run
