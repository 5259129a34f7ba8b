"""Command line: one file, or a folder with a dictionary for each file."""

from __future__ import annotations

import argparse
import json
import sys
from importlib import import_module

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from veilmark.functions.schema_tools import generate
from veilmark.operators import report as R
from veilmark.operators.model import Model
from veilmark.operators.structure import Mapping, process
from veilmark.scratch import keep, with_tables
from veilmark.sources import files

DRY_RUN = 100


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilmark", description="Find, mask, score and restore personal data")
    p.add_argument("input", nargs="?", help="file to process")
    p.add_argument("--mapping", help="mapping file")
    p.add_argument("--input-dir", help="process a folder")
    one = p.add_mutually_exclusive_group()
    for flag, text in (("pseudo", "reversible (default)"), ("anon", "irreversible"), ("dry-run", f"first {DRY_RUN} records, nothing written"), ("score-only", "scores, nothing written"), ("mapping-generate", "print a draft of a mapping")):
        one.add_argument(f"--{flag}", action="store_true", help=text)
    p.add_argument("--mode", default="hybrid", choices=["regex", "ner", "hybrid"])
    p.add_argument("--fort", action="store_true", help="more detectors")
    p.add_argument("--tech", action="store_true", help="technical identifiers")
    p.add_argument("--first-names", metavar="FILE", help="JSON list of first names, for doubtful persons of a model")
    p.add_argument("--family-names", metavar="FILE", help="JSON list of family names")
    p.add_argument("--model", metavar="MODULE:FUNCTION", help="what makes the named-entity model")
    p.add_argument("--restore", metavar="DICTIONARY", help="turn the input's tokens back")
    return p


def detection(spark: SparkSession, args) -> dict:
    """Options of functions.detectors.detect: word lists go to every task, a model is made in each by its name."""
    words = lambda path: frozenset(r.word for r in files.load_words(spark, path, upper=True).collect()) if path else frozenset()
    out = {"mode": args.mode, "fort": args.fort, "tech": args.tech, "names": words(args.first_names), "family": words(args.family_names)}
    if args.model:
        module, _, name = args.model.partition(":")
        out["ner"] = Model(lambda: getattr(import_module(module), name or "model")())
    return out


def run_files(spark: SparkSession, paths: list[str], args) -> list[dict]:
    """One report a file, or its error: all files in one job, each with a dictionary of its own.

    Outputs and dictionaries lie beside the inputs, each as one file."""
    mapping = Mapping.load(spark, args.mapping) if args.mapping else Mapping()
    o = mapping.options
    rows = keep(files.load_records(spark, paths, o.get("delimiter"), o.get("encoding", "utf-8"), o.get("header", True)), "input")
    wrong = {r.file: r.file_error for r in rows.filter("file_error is not null").select("file", "file_error").collect()}
    rows = rows.filter("file_error is null").drop("file_error")
    if args.dry_run:
        first = Window.partitionBy("file").orderBy("rec_idx")
        rows = rows.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= DRY_RUN).drop("__n")
    done = process(rows, "rec_idx", mapping.within("record"), "anon" if args.anon else "pseudo", per="file", deal=False, **detection(spark, args))
    table = keep(done.rows, "output")
    reports = {r.file: r.asDict(recursive=True) for r in R.by_file(done, table).collect()}  # a row a file
    out = []
    for path in paths:
        file = files.files_at(spark, path)[0]
        if file in wrong:
            out.append({"file": path, "error": wrong[file]})
            continue
        made = {"file": path, "report": {k: v for k, v in reports.get(file, {}).items() if k != "file"}}
        own = table.filter(F.col("file") == file)
        if not (args.dry_run or args.score_only):
            made["output"] = files.save_records(own, path, delimiter=o.get("delimiter"))
            if done.tokens is not None:
                made["dictionary"] = files.output_path(path, "_correspondances").rsplit(".", 1)[0] + ".csv"
                files.save_dictionary(done.tokens.filter(F.col("file") == file), made["dictionary"])
        if args.score_only:
            made["levels"] = {r.level: r.n for r in R.level_distribution(own).collect()}
        out.append(made)
    return out


def listed(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(str(f.getPath()) for f in found if f.isFile() and files.detect_format(str(f.getPath()))[1:] in files.EXTENSIONS)


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if not (args.input or args.input_dir):
        p.print_help()
        return 0
    if args.mapping_generate and not args.input:
        p.error("--mapping-generate needs a file")
    spark = SparkSession.builder.appName("veilmark").getOrCreate()
    with with_tables(spark):
        return run(spark, args)


def run(spark: SparkSession, args) -> int:
    if args.restore:
        print(files.restore_file(spark, args.input, args.restore))
    elif args.mapping_generate:
        print(json.dumps(generate(files.load(spark, args.input), args.input.rsplit("/", 1)[-1], "cli"), ensure_ascii=False, indent=2))
    else:
        found = run_files(spark, listed(spark, args.input_dir) if args.input_dir else [args.input], args)
        for made in found:
            print(json.dumps(made, ensure_ascii=False, default=str) if "error" not in made else f"{made['file']}: {made['error']}", file=sys.stderr if "error" in made else sys.stdout)
        return int(any("error" in made for made in found))
    return 0


if __name__ == "__main__":
    sys.exit(main())
