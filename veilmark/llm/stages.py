"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, decontaminate, language, minhash
from .common import keep, session_defaults
from .secrets import redact_secrets

#: Half of the letters.  Of sf0.01's 1,000 texts with letters the least likely has -8.0 a letter, FLOOR is -10.6, Polish,
#: Hungarian and random letters have -11.6 to -12.3.
LEAST_FIT = 0.5


def whole(docs):
    """The rows in one struct, so that no name of theirs clashes with a stage's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"))


def text_of(docs):
    return F.col(f"row.c{docs.columns.index('text')}").cast("string").alias("text")


def split(rows, columns):
    return rows.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)])


def language_stage(spark, docs, sf_dir):
    """Rejects documents without a letter, and those of which no learned language fits LEAST_FIT of the letters; lang stays as given."""
    session_defaults(spark)
    found = language.identify(whole(docs).withColumn("text", text_of(docs)), language.train(docs), ["row"])
    return split(found.filter(F.col("fit") >= LEAST_FIT), docs.columns)


def plain_columns(docs):
    """Columns of the row that can be hashed."""
    return [F.col(f"row.c{i}") for i, f in enumerate(docs.schema) if "map<" not in f.dataType.simpleString()]


def dedup_stage(spark, docs, sf_dir):
    """One document of each group of near copies (five words, 0.8) stays, that of the least doc_id (null last, then by a hash of the row).

    Rows are told apart by a number of their own, so rows with null or shared doc_id are judged by their own text.  Of
    wordless rows, which are no one's copies, those equal in all columns stay once.
    """
    session_defaults(spark)
    rows = minhash.numbered(whole(docs))
    ids = rows.select("number", F.col(f"row.c{docs.columns.index('doc_id')}").alias("id"), *[F.xxhash64(F.lit(seed), *plain_columns(docs)).alias(c) for seed, c in ((0, "h"), (1, "i"))])
    found = minhash.classes(rows.select("number", text_of(docs)), 5, 80).join(ids, "number")
    lone = [F.when(F.col("n_shingles") == 0, F.col(c)).alias(c) for c in ("h", "i")]
    first = found.groupBy(F.when(F.col("n_shingles") > 0, F.col("comp")).alias("comp"), *lone).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("h").alias("hash"), "number")).alias("first"))
    return split(rows.join(first.select("first.number"), "number", "left_semi"), docs.columns)


def decontaminate_stage(spark, docs, sf_dir):
    """Cuts documents that hold a copy of a benchmark item: rows of one text (by two hashes of it) fare alike, whatever their ids."""
    session_defaults(spark)
    rows = whole(docs)
    text = F.coalesce(text_of(docs), F.lit(""))
    rows = rows.withColumns({"h": F.xxhash64(text), "i": F.xxhash64(F.lit(1), text)})
    found = decontaminate.find(rows.select("h", "i", text_of(docs)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["h", "i"])
    return split(rows.join(keep(found.select("h", "i").distinct(), "copies"), ["h", "i"], "left_anti"), docs.columns)


def secret_stage(spark, docs, sf_dir):
    session_defaults(spark)
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def bpe_stage(spark, docs, sf_dir):
    """Adds ids and n_tokens, in place of columns of these names."""
    from .queries import tokenizer_source

    session_defaults(spark)
    return bpe.encode(docs, tokenizer_source(), head=1 << 17).withColumn("n_tokens", F.size("ids").cast("bigint"))
