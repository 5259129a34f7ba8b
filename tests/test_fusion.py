"""Spans of two tables against the fold in memory."""

import random

import pytest
from pyspark.sql import SparkSession

from veilmark.functions.detectors import Span, fuse
from veilmark.operators import fusion
from veilmark.operators import text as T


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()


COLUMNS = "k long, start int, end int, entity_type string, value string, score double, source string, risk_type string, extra string"


def test_fused_tables_equal_the_fold(spark):
    rng = random.Random(6)
    sides: tuple = ({}, {})
    for k in [None, *range(60)]:
        for side, own in enumerate(sides):
            found = set()
            for _ in range(rng.randrange(12)):
                a = rng.randrange(60)
                b = a + rng.randrange(1, 15)
                found.add(Span(a, b, rng.choice(["iban_txt", "email_txt", "personne"]), "v" * (b - a), 1.0, "ner" if side else rng.choice(["regex", "regex", "ner"]), "direct"))
            own[k] = sorted(found, key=lambda s: (s.start, -s.end, *s[2:]))
    tables = [spark.createDataFrame([(k, *s, "x") for k, own in side.items() for s in own], COLUMNS).repartition(3) for side in sides]
    want = sorted((repr(k), *s) for k in sides[0] for s in fuse(sides[0][k], sides[1][k]))
    for width in (7, 25, 1 << 20):
        got = fusion.fuse_tables(*tables, "k", width)
        assert sorted((repr(r.k), *tuple(r)[1:]) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert fusion.fuse_tables(tables[0].limit(0), tables[1].limit(0), "k").collect() == []
    assert fusion.fuse_tables(spark.createDataFrame([(1, None, 3, "x", "v", 1.0, "ner", "d", "")], COLUMNS), tables[1].limit(0), "k").collect() == []


def test_spans_of_a_table_go_on_as_detected_ones(spark):
    df = spark.createDataFrame([(1, "Al: a@b.fr"), (2, "x"), (3, None)], "k long, text string")
    rules = T.explode_spans(T.detect_spans(df), "k")
    model = spark.createDataFrame([(1, 0, 2, "personne", "Al", 0.9, "ner", "direct", "")], COLUMNS)
    found = fusion.with_spans(df, fusion.fuse_tables(rules, model, "k"), "k")
    out, words = T.pseudonymise(found, "k")
    assert {r.k: r.result for r in out.collect()} == {1: "[PERSONNE_1]: [EMAIL_1]", 2: "x", 3: None} and words.count() == 2
