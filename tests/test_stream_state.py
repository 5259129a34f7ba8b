"""Numbers of a stream from its state store."""

import os
import time

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilmark.scratch import scratch_root
from veilmark.streaming.state import pseudonymise_stream


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()


SCHEMA = "k int, text string, at timestamp, tags map<string,double>"


def add(spark, to, rows):
    spark.createDataFrame(rows, "k int, text string").select("k", "text", F.timestamp_micros(F.lit(1_700_000_000_123_456)).alias("at"), F.create_map(F.lit("a"), F.lit(1.5)).alias("tags")).coalesce(1).write.mode("append").parquet(to)


def run(spark, tmp_path, **more):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    pseudonymise_stream(stream, "text", *(str(tmp_path / x) for x in ("out", "words", "ck")), only=frozenset({"EMAIL", "URL"}), **more).awaitTermination()
    words = {r.original: r.token for r in spark.read.parquet(str(tmp_path / "words")).collect()}
    return words, {r.k: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_numbers_go_on_over_batches_and_restarts(spark, tmp_path):
    at, scratch = str(tmp_path / "in"), scratch_root(spark).removeprefix("file://")
    left = lambda: [d for d in os.listdir(scratch) if d.startswith("stream-")] if os.path.isdir(scratch) else []
    had = left()
    add(spark, at, [(1, "a@x.fr b@x.fr a@x.fr"), (2, None)])
    add(spark, at, [(3, "B@x.fr c@x.fr http://z"), (4, "rien")])
    words, rows = run(spark, tmp_path)
    assert sorted(words.values()) == ["[EMAIL_1]", "[EMAIL_2]", "[EMAIL_3]", "[URL_1]"] and set(words) == {"a@x.fr", "b@x.fr", "c@x.fr", "http://z"}
    first = dict(words)
    add(spark, at, [(5, "c@x.fr d@x.fr")])
    words, rows = run(spark, tmp_path)  # a new query from the checkpoint
    assert {k: words[k] for k in first} == first and words["d@x.fr"] == "[EMAIL_4]" and len(words) == 5
    t = {k: v for k, v in words.items()}
    assert rows[1].result == f"{t['a@x.fr']} {t['b@x.fr']} {t['a@x.fr']}" and rows[3].result == f"{t['b@x.fr']} {t['c@x.fr']} [URL_1]" and rows[5].result == f"{t['c@x.fr']} [EMAIL_4]"
    assert rows[2].result is None and rows[4].result == "rien" and rows[1].at.microsecond == 123456 and rows[1].tags == {"a": 1.5}
    assert left() == had


def test_lanes_give_unique_numbers(spark, tmp_path):
    for n in range(2):
        add(spark, str(tmp_path / "in"), [(n, " ".join(f"u{i}@x.fr" for i in range(20 * n, 20 * n + 40)))])
    words, rows = run(spark, tmp_path, lanes=4)
    assert len(words) == 60 and len(set(words.values())) == 60
    assert all(rows[n].result == " ".join(words[f"u{i}@x.fr"] for i in range(20 * n, 20 * n + 40)) for n in range(2))


def test_a_batch_takes_no_longer_as_the_dictionary_grows(spark, tmp_path):
    for n in range(8):
        add(spark, str(tmp_path / "in"), [(n, " ".join(f"u{i}@x.fr" for i in range(300 * n, 300 * n + 300)))])
    began = time.time()
    words, _ = run(spark, tmp_path)
    assert len(words) == 2400 and sorted(int(t[7:-1]) for t in words.values()) == list(range(1, 2401)) and time.time() - began < 240
