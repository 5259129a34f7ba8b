"""Spans of two tables fused: rules that Spark ran, and a model that ran elsewhere."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions.detectors import Span, winner
from veilmark.operators.text import SPANS, span_array

FIELDS = ("start", "end", "entity_type", "value", "score", "source", "risk_type")
#: Characters of a text that one task orders.
WIDTH = 1 << 20


def folded(spans: list[Span]) -> list[Span]:
    """Spans in order, of two that overlap the winner."""
    kept: list[Span] = []
    for s in spans:
        if kept and s.start < kept[-1].end and kept[-1].start < s.end:
            kept[-1] = winner(kept[-1], s)
        else:
            kept.append(s)
    return kept


def fuse_tables(rules: DataFrame, model: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """key and the fields of spans, one row each: as functions.detectors.fuse fuses both lists of a text.

    Spans that overlap each other in a chain are a group, which no other span can change.  Groups are found by the furthest
    end so far, within stretches of `width` characters and then from stretch to stretch, so a long text is many tasks; each group is
    folded on its own.  Of spans with one start and end the rules' come first, then by their other fields.  Rows without a
    start or end are left out; null keys are a text of their own; extra columns are not read.
    """
    side = lambda df, n: df.select(F.col(f"`{key}`").alias("k"), F.lit(n).alias("side"), *[F.col(f).cast("int" if f in ("start", "end") else "double" if f == "score" else "string").alias(f) for f in FIELDS])
    spans = side(rules, 0).unionByName(side(model, 1)).filter(F.col("start").isNotNull() & F.col("end").isNotNull())
    spans = spans.withColumn("stretch", F.floor(F.col("start") / width))
    order = [F.col("start"), F.col("end").desc(), F.col("side"), *map(F.col, FIELDS[2:])]
    own = Window.partitionBy("k", "stretch").orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("k").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    # The furthest end of all stretches before.
    ends = spans.groupBy("k", "stretch").agg(F.max("end").alias("far")).select("k", "stretch", F.max("far").over(earlier).alias("far"))
    same = lambda a, b: (F.col(f"{a}.k").eqNullSafe(F.col(f"{b}.k"))) & (F.col(f"{a}.stretch") == F.col(f"{b}.stretch"))
    reach = F.greatest(F.max("end").over(before), F.col("far"))
    met = spans.alias("a").join(ends.alias("b"), same("a", "b")).select("a.*", "b.far")
    met = met.withColumn("first", F.when(F.coalesce(F.col("start") >= reach, F.lit(True)), F.col("start"))).drop("far")
    # A group is named by its first start, which a stretch may have from one before it.
    starts = met.groupBy("k", "stretch").agg(F.max("first").alias("open")).select("k", "stretch", F.max("open").over(earlier).alias("open"))
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    named = met.alias("a").join(starts.alias("b"), same("a", "b")).select("a.*", "b.open")
    named = named.withColumn("at", F.coalesce(F.max("first").over(upto), F.col("open")))
    place = F.struct("start", (-F.col("end")).alias("e"), "side", *FIELDS[2:])
    groups = named.groupBy("k", "at").agg(F.array_sort(F.collect_list(place)).alias("s"))

    @F.arrow_udf(SPANS)
    def kept(found: pa.Array) -> pa.Array:
        return span_array([folded([Span(s["start"], -s["e"], *(s[f] for f in FIELDS[2:])) for s in own]) for own in found.to_pylist()])

    return groups.select(F.col("k").alias(key), F.explode(kept("s")).alias("s")).select(key, *[F.col(f"s.{f}") for f in FIELDS])


def with_spans(df: DataFrame, spans: DataFrame, key: str, out_col: str = "spans") -> DataFrame:
    """df plus its spans from a table of them, in order, an empty list where there are none; keys of df are taken as unique."""
    row = F.struct("start", (-F.col("end")).alias("e"), *FIELDS[2:])
    lists = spans.groupBy(F.col(key).alias("__k")).agg(F.array_sort(F.collect_list(row)).alias("__s"))
    plain = F.transform("__s", lambda s: F.struct(s["start"].alias("start"), (-s["e"]).alias("end"), *[s[f].alias(f) for f in FIELDS[2:]]))
    out = df.join(lists, F.col(f"`{key}`") == F.col("__k"), "left").withColumn("__spans", F.coalesce(plain, F.array().cast(SPANS)))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != out_col], F.col("__spans").alias(out_col))
