"""Span detection, rewriting, scoring and validating of free text as DataFrame stages."""

from __future__ import annotations

from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions.detectors import detect
from veilmark.operators.tokens import occurrences, person_key, prefix_of, splice, token_dictionary, with_tokens
from veilmark.operators.tokens import restore as _restore
from veilmark.scratch import keep, small_batches

SPAN = "struct<start:int,end:int,entity_type:string,value:string,score:double,source:string,risk_type:string>"
SPANS = f"array<{SPAN}>"
POINTS = {"finance": 5, "direct": 3, "tech": 2, "indirect": 1}


def detect_spans(df: DataFrame, text_col: str = "text", out_col: str = "spans", **options) -> DataFrame:
    """Adds spans: narrow, Arrow-batched (the session's batches become small, see scratch.small_batches); options as
    functions.detectors.detect.  Null and empty text have no spans.

    Options `names` may be a DataFrame of kind ("first" or "family") and word: then the words of doubtful persons are
    joined to it, so a list of any size works; a frozenset goes to every task and is for small lists.
    """
    small_batches(df.sparkSession)
    names = options.get("names")
    if isinstance(names, DataFrame):
        early = {**options, "names": None, "whitelist": (), "blacklist": ()}
        found = _checked(_spans(df, text_col, out_col, early), names, out_col)
        return _listed(found, text_col, out_col, options.get("whitelist", ()), options.get("blacklist", ()))
    return _spans(df, text_col, out_col, options)


def _spans(df: DataFrame, text_col: str, out_col: str, options: dict) -> DataFrame:
    options = {**options, **{k: frozenset(options[k]) for k in ("whitelist", "blacklist") if options.get(k)}}

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        return span_array([detect(t, **options) for t in texts.to_pylist()])

    return df.withColumn(out_col, spans(F.col(text_col)))


def span_array(found: list[list]) -> pa.Array:
    """Lists of spans, column by column."""
    kinds = (("start", pa.int32()), ("end", pa.int32()), ("entity_type", pa.string()), ("value", pa.string()), ("score", pa.float64()), ("source", pa.string()), ("risk_type", pa.string()))
    flat = list(zip(*chain.from_iterable(found), strict=True)) or [()] * len(kinds)
    rows = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(flat, kinds, strict=True)], fields=[pa.field(n, t) for n, t in kinds])
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), rows)


def _checked(df: DataFrame, names: DataFrame, out_col: str) -> DataFrame:
    """Drops doubtful persons none of whose words is in names: a join of their words, each once a row."""
    rows = keep(df.withColumn("__row", F.monotonically_increasing_id()), "doubtful")
    doubtful = lambda s: (s["source"] == "ner") & (s["entity_type"] == "personne") & (s["score"] < 0.7)
    values = F.transform(F.filter(out_col, doubtful), lambda s: F.upper(s["value"]))
    words = rows.select("__row", F.explode(F.array_distinct(F.flatten(F.transform(values, lambda v: F.split(v, r"\s+"))))).alias("word")).filter(F.length("word") >= 2)
    plain = F.translate("word", "ÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝŸ", "AAAAAACEEEEIIIINOOOOOUUUUYY")
    asked = words.withColumn("spelt", F.array_distinct(F.array(F.concat(F.lit("family "), "word"), F.concat(F.lit("first "), "word"), F.concat(F.lit("first "), plain))))
    known = names.select(F.concat("kind", F.lit(" "), F.upper(F.trim("word"))).alias("spelt")).distinct()
    good = asked.select("__row", "word", F.explode("spelt").alias("spelt")).join(known, "spelt", "left_semi").groupBy("__row").agg(F.collect_set("word").alias("__good"))
    kept = F.filter(out_col, lambda s: ~doubtful(s) | F.arrays_overlap(F.split(F.upper(s["value"]), r"\s+"), F.coalesce("__good", F.array().cast("array<string>"))))
    return rows.join(good, "__row", "left").withColumn(out_col, kept).select(*df.columns)


def _listed(df: DataFrame, text_col: str, out_col: str, whitelist, blacklist) -> DataFrame:
    from veilmark.functions.detectors import Span, apply_lists

    whitelist, blacklist = frozenset(whitelist), frozenset(blacklist)

    @F.arrow_udf(SPANS)
    def listed(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        return span_array([apply_lists(t or "", [Span(**x) for x in own], whitelist, blacklist) for t, own in rows])

    return df.withColumn(out_col, listed(F.col(text_col), F.col(out_col)))


def explode_spans(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.posexplode("spans").alias("span_ord", "s")).select(key, "span_ord", "s.*")


def anonymise(df: DataFrame, text_col: str = "text", mark: str = "***") -> DataFrame:
    """Irreversible: each span becomes mark; no dictionary is made."""
    pieces = F.transform("spans", lambda s: F.struct(s["start"], s["end"], F.lit(mark).alias("repl")))
    return df.withColumn("result", splice(F.col(text_col), pieces))


def redact(df: DataFrame, text_col: str = "text", how: str = "redact") -> DataFrame:
    """Extension, documented for the reference but not built there: "redact" prints a block of the span's length, "hash" its MD5."""
    repl = (lambda s: F.repeat(F.lit("█"), s["end"] - s["start"])) if how == "redact" else (lambda s: F.md5(s["value"].cast("binary")))
    return df.withColumn("result", splice(F.col(text_col), F.transform("spans", lambda s: F.struct(s["start"], s["end"], repl(s).alias("repl")))))


def pseudonymise(df: DataFrame, key: str, text_col: str = "text", numbering: str = "type") -> tuple[DataFrame, DataFrame]:
    """(rows with result, dictionary) of rows with spans.

    Rows and their spans are kept once, so nothing is detected again; only rows that have spans meet their tokens.  Numbers
    follow key, then the row's place; rows with null or equal keys are told apart.  Null text stays null; a column named result
    is replaced.  Texts that hold what looks like a token already are not guarded: restoring turns it into its original.
    """
    rows = keep(df.withColumn("__row", F.monotonically_increasing_id()), "spans")
    spans = occurrences(rows.filter(F.size("spans") > 0).select(F.col(key).alias("__key"), "__row", "spans"), "__key")
    words = token_dictionary(spans, "__key", "__row", numbering=numbering)
    pieces = with_tokens(spans, words, numbering).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("token").alias("repl")))).alias("__pieces"))
    changed = rows.filter(F.size("spans") > 0).join(pieces, "__row").withColumn("__result", splice(F.col(text_col), F.col("__pieces")))
    same = rows.filter((F.size("spans") == 0) | F.col("spans").isNull()).withColumn("__result", F.col(text_col))
    out = [*[F.col(f"`{c}`") for c in df.columns if c != "result"], F.col("__result").alias("result")]
    return changed.select(*out).unionByName(same.select(*out)), words


def restore(df: DataFrame, words: DataFrame, key: str | None = None, text_col: str = "result") -> DataFrame:
    """df plus restored and n_restored; see operators.tokens.restore.  No key is needed."""
    return _restore(df, words, text_col)


def risk_level(score):
    return F.when(score == 0, "NUL").when(score < 10, "FAIBLE").when(score < 50, "MODÉRÉ").when(score < 100, "ÉLEVÉ").otherwise("CRITIQUE")


def points(risk):
    """Points of a category; an unknown one counts one."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in POINTS.items() for x in kv]), risk), F.lit(1))


def with_risk(df: DataFrame) -> DataFrame:
    """score, level and counts by category of each row."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["risk_type"] == k))
    out = df.withColumn("score", F.aggregate("spans", F.lit(0), lambda a, s: a + points(s["risk_type"])).cast("bigint"))
    return out.withColumn("level", risk_level(F.col("score"))).withColumns({f"n_{k}": of(k).cast("bigint") for k in POINTS})


def validate(df: DataFrame, key: str, text_col: str = "result") -> DataFrame:
    """Spans left after masking; tokens themselves are no leaks."""
    left = explode_spans(detect_spans(df, text_col, fort=True, tech=True), key)
    return left.filter(~(F.col("value").startswith("[") & F.col("value").endswith("]")))


def clean(df: DataFrame, key: str, text_col: str = "result") -> DataFrame:
    """key, clean, n_leaks of every row."""
    found = F.filter("spans", lambda s: ~(s["value"].startswith("[") & s["value"].endswith("]")))
    return detect_spans(df, text_col, fort=True, tech=True).select(key, (F.size(found) == 0).alias("clean"), F.size(found).cast("bigint").alias("n_leaks"))


__all__ = ["POINTS", "SPANS", "anonymise", "clean", "detect_spans", "explode_spans", "person_key", "points", "prefix_of", "pseudonymise", "redact", "restore", "risk_level", "splice", "token_dictionary", "validate", "with_risk"]
