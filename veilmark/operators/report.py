"""What a run did: counts, samples, scores of records and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilmark.operators.text import risk_level

LEVELS = ("NUL", "FAIBLE", "MODÉRÉ", "ÉLEVÉ", "CRITIQUE")


def type_counts(occ: DataFrame) -> DataFrame:
    """entity_type, n, with a row of null type for the total."""
    return occ.rollup("entity_type").agg(F.count("*").alias("n"))


def samples(occ: DataFrame, *order: str, most: int = 5) -> DataFrame:
    """entity_type, rank, original (60 characters) and token, if there is one, of the first of each type.

    The limit on the rank is applied in each task before the shuffle, so few rows of a type travel.
    """
    w = Window.partitionBy("entity_type").orderBy(*order)
    ranked = occ.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return ranked.select("entity_type", "rank", F.substring("value", 1, 60).alias("original"), *[c for c in ("token",) if c in occ.columns])


def details(occ: DataFrame) -> DataFrame:
    """One row: replacements by category of risk."""
    n = lambda k: F.count_if(F.col("risk_type") == k).alias(k)
    return occ.agg(*[n(k) for k in ("direct", "finance", "tech", "indirect")])


def file_score(rows: DataFrame) -> DataFrame:
    """records, errors, score, mean and level of rows with score; the level is that of the sum, as in the reference."""
    wrong = F.count("error") if "error" in rows.columns else F.lit(0)
    total = rows.agg(F.count("*").alias("records"), wrong.cast("bigint").alias("errors"), F.coalesce(F.sum("score"), F.lit(0)).cast("bigint").alias("score"))
    return total.withColumns({"mean": F.when(F.col("records") > 0, F.col("score") / F.col("records")), "level": risk_level(F.col("score"))})


def level_distribution(rows: DataFrame) -> DataFrame:
    """level, n for all five levels, also those that no record has."""
    spark: SparkSession = rows.sparkSession
    levels = spark.range(len(LEVELS)).select(F.get(F.lit(list(LEVELS)), F.col("id").cast("int")).alias("level"))
    return levels.join(rows.groupBy("level").agg(F.count("*").alias("n")), "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


def distinct_values(occ: DataFrame) -> DataFrame:
    return occ.select("entity_type", "value").distinct()


def report(rows: DataFrame, occ: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """One row: records, errors, score, mean, level, replacements, tokens and a map of replacements by type."""
    by_type = occ.groupBy("entity_type").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("replacements"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("by_type"))
    size = (words.select("token").distinct() if words is not None else rows.limit(0)).agg(F.count("*").alias("tokens"))
    # Three tables of one row each.
    return file_score(rows).join(F.broadcast(by_type)).join(F.broadcast(size))


def by_file(done, rows: DataFrame | None = None) -> DataFrame:
    """The report of each value of a run's `per` (structure.Processed): records, errors, score, mean, level, replacements,
    tokens and a map of replacements by type.  rows: the run's rows, if they are kept as a table."""
    per, place, (score, _, error) = done.per, done.place, done.names
    rows = done.rows if rows is None else rows
    out = rows.groupBy(per).agg(F.count("*").alias("records"), F.count(error).alias("errors"), F.coalesce(F.sum(score), F.lit(0)).cast("bigint").alias("score"))
    types = done.occurrences.groupBy(F.col(place).alias(per), "entity_type").agg(F.count("*").alias("n")).groupBy(per)
    types = types.agg(F.sum("n").cast("bigint").alias("replacements"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("by_type"))
    out = out.join(types, per, "left")
    if done.tokens is not None:
        out = out.join(done.tokens.groupBy(F.col(place).alias(per)).agg(F.count_distinct("token").alias("tokens")), per, "left")
    none = F.create_map().cast("map<string,bigint>")
    found = {"replacements": F.coalesce("replacements", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0)) if done.tokens is not None else F.lit(0), "by_type": F.coalesce("by_type", none)}
    return out.withColumns({**found, "mean": F.col("score") / F.col("records"), "level": risk_level(F.col("score"))}).select(per, "records", "errors", "score", "mean", "level", "replacements", "tokens", "by_type")
