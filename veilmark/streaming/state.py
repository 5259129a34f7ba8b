"""Token numbering on a stream with a state store: what each value's number is lies there by type, so a batch costs what it
brings, however large the dictionary has grown, and a restart goes on where the last committed batch ended."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from veilmark.operators.rewrite import splice
from veilmark.operators.text import detect_spans
from veilmark.operators.tokens import NUMBERING, norm_of, prefix_of
from veilmark.scratch import drop, folder

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UNIT = "row string, place int, grp string, prefix string, norm string, original string, start int, end int, data string"
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class Numbers(StatefulProcessor):
    """Of one type and lane: the number of each value, and how many there are."""

    def __init__(self, lanes: int):
        self.lanes = lanes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "norm string", "num bigint")
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Rows with their numbers, and whether a number is given out here."""
        lane, had = key[1], self.count.get()[0] if self.count.exists() else 0
        n, met = had, {}
        for part in rows:
            nums, fresh = [], []
            for norm in part["norm"]:
                new = False
                if norm is None:
                    nums.append(None)
                else:
                    if norm not in met:
                        new = not self.known.containsKey((norm,))
                        met[norm] = n * self.lanes + lane + 1 if new else self.known.getValue((norm,))[0]
                        if new:
                            self.known.updateValue((norm,), (met[norm],))
                            n += 1
                    nums.append(met[norm])
                fresh.append(new)
            yield part.assign(num=pd.Series(nums, dtype="Int64", index=part.index), fresh=fresh)
        if n != had:
            self.count.update((n,))

    def close(self) -> None:
        pass


def units(stream: DataFrame, text_col: str, numbering: str, lanes: int, options: dict) -> DataFrame:
    """One row a span, and one with the columns of each record, that meet again by a name of their own."""
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in stream.columns]), TIMES)
    found = detect_spans(stream.withColumns({"__row": F.uuid(), "__data": record}), text_col, "__spans", **options)
    none = F.lit(None).cast("string")
    kind = lambda s: s["entity_type"]
    head = F.struct(F.lit(-1).alias("place"), F.lit("").alias("grp"), none.alias("prefix"), none.alias("norm"), none.alias("original"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.col("__data").alias("data"))

    def unit(s, i):
        norm = norm_of(kind(s), s["value"], numbering)
        norm = F.when(F.length(norm) > 0, norm)
        grp = kind(s) if numbering == "type" else prefix_of(kind(s))
        return F.struct(i.alias("place"), grp.alias("grp"), prefix_of(kind(s)).alias("prefix"), norm.alias("norm"), (s["value"] if numbering == "exact" else F.trim(s["value"])).alias("original"), s["start"].alias("start"), s["end"].alias("end"), none.alias("data"))

    rows = found.select(F.col("__row").alias("row"), F.explode(F.concat(F.array(head), F.transform("__spans", unit))).alias("u")).select("row", "u.*")
    return rows.withColumn("lane", F.pmod(F.xxhash64(F.coalesce("norm", "row")), F.lit(lanes)).cast("int"))


def pseudonymise_stream(stream: DataFrame, text_col: str, out: str, dictionary: str, checkpoint: str, numbering: str = "type", lanes: int = 1, trigger: dict | None = None, **options) -> StreamingQuery:
    """A started query that writes each batch's records with result to out/batch=<n> and its new tokens to dictionary/batch=<n>.

    lanes: so many tasks number the values of one type; with one, numbers are 1, 2, ... in order of arrival, with more each
    task gives out every lanes-th number, so they are as unique but not gapless.  A batch that is run again replaces
    what it wrote.  Null text stays null; a column named result is replaced.
    """
    if numbering not in NUMBERING:
        raise ValueError(f"numbering is one of {NUMBERING}")
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    schema, columns = stream.schema, stream.columns

    def write(batch: DataFrame, number: int) -> None:
        at = folder(spark, "stream")
        batch.write.parquet(at)  # the state is gone through once
        own = spark.read.schema(batch.schema).parquet(at)
        token = F.when(F.col("num").isNull(), F.concat(F.lit("["), "prefix", F.lit("]"))).otherwise(F.concat(F.lit("["), "prefix", F.lit("_"), F.col("num").cast("string"), F.lit("]")))
        new = own.filter("fresh").select("grp", "prefix", "norm", "original", "num", token.alias("token"))
        new.write.mode("overwrite").parquet(f"{dictionary.rstrip('/')}/batch={number}")
        pieces = own.filter("place >= 0").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", token.alias("repl")))).alias("pieces"))
        rows = own.filter("place < 0").select("row", F.from_json("data", schema, TIMES).alias("r")).join(pieces, "row", "left")
        text = F.col("r")[text_col]
        done = rows.withColumn("result", F.when(F.col("pieces").isNull(), text).otherwise(splice(text, F.col("pieces"))))
        done.select(*[F.col("r")[c].alias(c) for c in columns if c != "result"], "result").write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")
        drop(spark, at)

    made = units(stream, text_col, numbering, lanes, options).groupBy("grp", "lane")
    numbered = made.transformWithStateInPandas(Numbers(lanes), outputStructType=f"{UNIT}, lane int, num bigint, fresh boolean", outputMode="append", timeMode="none")
    writer = numbered.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start()
