"""How work lies: records dealt to all cores, constants that travel nowhere, replacements that travel once, batches of bounded size."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilmark.functions.detectors import places
from veilmark.operators.structure import Mapping, process
from veilmark.operators.text import detect_spans
from veilmark.scratch import BATCH, FEW, spread


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()


def plan_of(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def people(spark, n: int):
    return spark.range(0, n, 1, 1).select("id", F.concat(F.lit("Nom"), "id").alias("name"), F.concat(F.lit("u"), "id", F.lit("@x.fr, U"), "id", F.lit("@x.fr")).alias("note"))


MAPPING = {"champs_sensibles": {"name": {"type": "nom", "jeton": "NOM"}}, "texte_libre": ["note"]}


def test_rows_of_one_task_are_dealt_to_all(spark):
    rows = spark.range(0, 3 * FEW, 1, 1).withColumn("__row", F.monotonically_increasing_id())
    dealt = spread(rows, "__row")
    each = [r.n for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(each) > 2 and max(each) < FEW and sum(each) == 3 * FEW and dealt.agg(F.sum("id")).first()[0] == sum(range(3 * FEW))
    assert spread(rows.limit(10), "__row").count() == 10 and spread(spark.range(0, 3 * FEW, 1, 4), "id").rdd.getNumPartitions() == 4
    done = process(people(spark, 3 * FEW).limit(3 * FEW), "id", Mapping.from_dict(MAPPING), only=frozenset({"EMAIL"})).rows
    assert done.filter("name = concat('[NOM_', id + 1, ']') and note = concat('[EMAIL_', id + 1, '], [EMAIL_', id + 1, ']') and score = 9").count() == 3 * FEW


def test_constants_travel_nowhere(spark, capsys):
    done = process(people(spark, 4), "id", Mapping.from_dict(MAPPING), "anon", only=frozenset({"EMAIL"}))
    assert "Exchange" not in plan_of(done.rows, capsys)
    assert {tuple(r) for r in done.rows.select("name", "note", "score", "level").collect()} == {("***", "***, ***", 9, "FAIBLE")}
    assert done.occurrences.count() == 12
    # Running numbers and random ones are given once.
    ids = process(people(spark, 4), "id", Mapping.from_dict({"champs_sensibles": {"name": {"type": "uuid", "jeton": "U"}}}), "anon")
    assert {r.name for r in ids.rows.collect()} == {r.token for r in ids.occurrences.collect()}


def test_replacements_travel_once(spark, capsys):
    """They are dealt by record; a second deal by record and place is not needed."""
    done = process(people(spark, 4), "id", Mapping.from_dict(MAPPING), only=frozenset({"EMAIL"}))
    plan = plan_of(done.rows, capsys)
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(__row" in line]
    assert dealt and not any(", kind" in line for line in dealt) and len(dealt) <= 2
    assert {(r.id, r.name, r.note, r.score) for r in done.rows.collect()} == {(i, f"[NOM_{i + 1}]", f"[EMAIL_{i + 1}], [EMAIL_{i + 1}]", 9) for i in range(4)}


def test_names_of_a_record_are_found_as_by_a_pattern():
    rnd = random.Random(5)
    for _ in range(20_000):
        word = "".join(rnd.choices("aAkKs.ſİéÉ", k=rnd.randint(1, 3)))
        text = "".join(rnd.choices("aAkKs.ſİéÉK " if rnd.random() < 0.5 else "aAkKs. ", k=12))
        assert list(places(word, text)) == [m.start() for m in re.finditer(re.escape(word), text, re.I)], (word, text)


def test_python_gets_batches_of_bounded_size(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")

    @F.arrow_udf("int")
    def size(ids: pa.Array) -> pa.Array:
        return pa.array([len(ids)] * len(ids), pa.int32())

    largest = lambda: spark.range(0, 5000, 1, 1).select(size("id").alias("n")).agg(F.max("n")).first()[0]
    assert largest() == 5000
    detect_spans(spark.createDataFrame([("a@b.fr",)], "text string"))
    assert largest() <= BATCH
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    process(people(spark, 3), "id", Mapping.from_dict(MAPPING), "anon")
    assert largest() == 100
