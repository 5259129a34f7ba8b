"""Readers and writers by file extension, dictionaries, word lists, folders."""

from __future__ import annotations

import csv
import io
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.sources.jsonfiles import RECORDS, ends_line, files_at, head, json_records, load_json, source_path
from veilmark.sources.office import SHEETS, TEXTS, load_office, office_records, save_office
from veilmark.sources.single import write_csv, write_json, write_lines, write_text

EXTENSIONS = ("json", "csv", "tsv", "txt", "md", "xlsx", "xls", "ods", "odt", "docx", "pdf")


def detect_format(path: str) -> str:
    """The extension in lower case, with its dot; '' without one."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return f".{name.rsplit('.', 1)[-1].lower()}" if "." in name.lstrip(".") else ""


def load(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "utf-8", header: bool = True) -> DataFrame:
    """JSON (array, object, objects, lines; records of unlike keys get null for what they lack), CSV and TSV as strings, sheets
    as strings, TXT, MD, ODT, DOCX and PDF as one record of texte and _source.  Others raise ValueError."""
    kind = detect_format(path)[1:]
    if kind == "json":
        return load_json(spark, path)
    if kind in ("csv", "tsv"):
        df = spark.read.csv(path, header=header, sep=delimiter or ("\t" if kind == "tsv" else ","), encoding=encoding, multiLine=True, escape='"')
        return df if header else df.toDF(*[f"col_{i}" for i in range(len(df.columns))])
    if kind in ("txt", "md"):
        return spark.read.text(path, wholetext=True).select(F.col("value").alias("texte"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("_source"))
    if kind in SHEETS or kind in TEXTS:
        return load_office(spark, path, kind, header)
    raise ValueError(f"no reader for .{kind}")


def with_order(df: DataFrame, name: str = "rec_idx") -> DataFrame:
    """df plus its order as read: rising, not gapless.  Keep it as a table before it is shuffled."""
    return df.withColumn(name, F.monotonically_increasing_id())


def first_rows(df: DataFrame, n: int | None, order: str = "rec_idx") -> DataFrame:
    """The first n rows in file order; all for 0 or None."""
    return df.orderBy(order).limit(n) if n else df


def csv_header(spark: SparkSession, path: str, delimiter: str, encoding: str) -> tuple[str, ...]:
    """The names in a file's first line."""
    text = head(spark, path).decode(encoding, "ignore").lstrip("\ufeff")
    return tuple(next(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter), ()))


def csv_records(spark: SparkSession, paths: list[str], delimiter: str | None = None, encoding: str = "utf-8", header: bool = True) -> DataFrame:
    """file, rec_idx and record (JSON text): files of one header are read together, so no column is read under another's name."""
    groups: dict[tuple, list[str]] = {}
    for p in paths:
        sep = delimiter or ("\t" if detect_format(p) == ".tsv" else ",")
        groups.setdefault((sep, csv_header(spark, p, sep, encoding)), []).append(p)
    made = []
    for (sep, names), some in groups.items():
        names = names if header else tuple(f"col_{i}" for i in range(len(names)))
        cols = [f"c{i}" for i in range(len(names))]
        if not cols:
            continue
        schema = ", ".join(f"{c} string" for c in cols)
        # The header is skipped as a row of its own, whatever its names.
        df = spark.read.csv(some, schema=schema, header=header, sep=sep, encoding=encoding, multiLine=True, escape='"', enforceSchema=True)
        file = df.select(*cols, source_path().alias("file"))
        # Of two columns of one name the last counts.
        record = F.to_json(F.struct(*[F.coalesce(c, F.lit("")).alias(n) for n, c in dict(zip(names, cols, strict=True)).items()]))
        made.append(file.select("file", F.struct(F.lit(0).cast("bigint").alias("block"), F.monotonically_increasing_id().alias("at")).alias("rec_idx"), record.alias("record")))
    return reduce(DataFrame.unionByName, made) if made else spark.createDataFrame([], RECORDS)


def text_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    df = spark.read.text(paths, wholetext=True).select("value", source_path().alias("file"))
    zero = F.lit(0).cast("bigint")
    return df.select("file", F.struct(zero.alias("block"), zero.alias("at")).alias("rec_idx"), F.to_json(F.struct(F.col("value").alias("texte"), F.element_at(F.split("file", "/"), -1).alias("_source"))).alias("record"))


def load_records(spark: SparkSession, path: str | list[str], delimiter: str | None = None, encoding: str = "utf-8", header: bool = True) -> DataFrame:
    """Files of any formats in one table: file_id (the name), file, rec_idx (place in the file), record (JSON text with the
    keys, order and types of that record alone) and file_error of files that cannot be read."""
    paths = [p for x in ([path] if isinstance(path, str) else path) for p in files_at(spark, x)]
    by: dict[str, list[str]] = {}
    for p in paths:
        kind = detect_format(p)[1:]
        if kind in EXTENSIONS:
            by.setdefault("json" if kind == "json" else "csv" if kind in ("csv", "tsv") else "txt" if kind in ("txt", "md") else "office", []).append(p)
    none = F.lit(None).cast("string")
    made = []
    if "json" in by:
        made.append(json_records(spark, by["json"]).withColumn("file_error", none))
    if "csv" in by:
        made.append(csv_records(spark, by["csv"], delimiter, encoding, header).withColumn("file_error", none))
    if "txt" in by:
        made.append(text_records(spark, by["txt"]).withColumn("file_error", none))
    if "office" in by:
        made.append(office_records(spark, by["office"], header))
    df = reduce(DataFrame.unionByName, made) if made else spark.createDataFrame([], f"{RECORDS}, file_error string")
    return df.select(F.element_at(F.split("file", "/"), -1).alias("file_id"), *df.columns)


def save_records(df: DataFrame, path: str, suffix: str = "_PSEUDO", delimiter: str | None = None, names: list[str] | None = None) -> str:
    """The records of one file (rec_idx, record) beside it in its own format, as one file in their order; unknown formats become JSON."""
    out = output_path(path, suffix)
    kind = detect_format(out)[1:]
    if kind not in ("csv", "tsv", "txt", "md", "xlsx", "ods", "odt", "docx"):
        write_json(df, ["rec_idx"], out)
        return out
    if kind in ("txt", "md", "odt", "docx"):
        names = ["texte"]
    if names is None:
        first = df.orderBy("rec_idx").select(F.json_object_keys("record")).first()
        names = list(first[0]) if first and first[0] else []
    # By place, since names may differ in case alone.
    cells = F.from_json("record", "map<string,string>")
    table = df.select("rec_idx", cells.alias("m")).select("rec_idx", *[F.col("m")[n].alias(n) for n in names])
    if kind in ("csv", "tsv"):
        write_csv(table, ["rec_idx"], names, out, delimiter or ("\t" if kind == "tsv" else ","))
    elif kind in ("txt", "md"):
        write_text(table, ["rec_idx"], out, F.col("texte"))
    else:
        save_office(table.orderBy("rec_idx").select(*names), out, kind)
    return out


def output_path(path: str, suffix: str = "_PSEUDO") -> str:
    """<base><suffix><ext>; PDF becomes TXT."""
    ext = detect_format(path)
    base = path[: len(path) - len(ext)] if ext else path
    return f"{base}{suffix}{'.txt' if ext == '.pdf' else ext}"


def save(df: DataFrame, path: str, delimiter: str = ",", suffix: str = "_PSEUDO", single_file: bool = False) -> str:
    """Write beside the input: a folder of part files (with single_file one part), or an office file of bounded size.

    Unknown formats become JSON.
    """
    out = output_path(path, suffix)
    kind = detect_format(out)[1:]
    if kind in ("xlsx", "ods", "odt", "docx"):
        save_office(df, out, kind)
        return out
    parts = df.coalesce(1) if single_file else df
    if kind in ("csv", "tsv"):
        parts.write.mode("overwrite").csv(out, header=True, sep="\t" if kind == "tsv" else delimiter, escape='"')
    elif kind in ("txt", "md"):
        parts.select("texte").write.mode("overwrite").text(out)
    else:
        parts.write.mode("overwrite").json(out, ignoreNullFields=False)
    return out


def dictionary_list(words: DataFrame) -> DataFrame:
    """type, jeton, valeur, sorted by type and token as text ([X_10] before [X_2])."""
    return words.select(F.col("grp").alias("type"), F.col("token").alias("jeton"), F.col("original").alias("valeur")).orderBy("type", "jeton")


def save_dictionary(words: DataFrame, path: str) -> None:
    """type;jeton;valeur_originale as one file, in the order of dictionary_list."""
    table = words.select(F.col("grp").alias("type"), F.col("token").alias("jeton"), F.col("original").alias("valeur_originale"))
    write_csv(table, ["type", "jeton"], table.columns, path, ";")


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """grp, num, token, original: rows without a token or value are skipped, of several rows of a token the last counts."""
    df = spark.read.csv(path, sep=";", header=True, escape='"').withColumn("num", F.monotonically_increasing_id())
    df = df.filter((F.length("jeton") > 0) & (F.length("valeur_originale") > 0))
    last = F.max_by(F.struct("type", "num", "valeur_originale"), "num").alias("x")
    return df.groupBy("jeton").agg(last).select(F.col("x.type").alias("grp"), F.col("x.num").alias("num"), F.col("jeton").alias("token"), F.col("x.valeur_originale").alias("original"))


def load_words(spark: SparkSession, path: str, upper: bool = False) -> DataFrame:
    """word: a JSON array of strings, each once, in capitals if upper."""
    words = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("word"))
    return words.select(F.upper(F.trim("word")).alias("word") if upper else F.col("word")).distinct()


def restore_file(spark: SparkSession, path: str, dictionary: str) -> str:
    """A text file with its tokens turned back, written beside it: _PSEUDO becomes _RESTAURE (or is put before the extension)."""
    from veilmark.operators.tokens import restore

    read = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    done = restore(read, load_dictionary(spark, dictionary), "value")
    out = path.replace("_PSEUDO", "_RESTAURE") if "_PSEUDO" in path else output_path(path, "_RESTAURE")
    write_lines(done, ["block", "at"], F.col("restored"), out, trail="\n" if ends_line(spark, path) else "")
    return out


__all__ = ["EXTENSIONS", "detect_format", "dictionary_list", "first_rows", "load", "load_dictionary", "load_records", "load_words", "output_path", "restore_file", "save", "save_dictionary", "save_records", "with_order"]
