"""Phrase collocations against counting every n-gram, in plain Python and in SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession

from veilmark.llm import phrases, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()


def plain(rows, least, longest, percent, top):
    f, total = Counter(), Counter()
    lower = {i: i + 32 for i in range(65, 91)}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    out = []
    for (lang, *p), a in f.items():
        if a >= least and len(p) > 1:
            s, _, l, r = min((10**6 * a * a // (f[(lang, *p[:k])] * f[(lang, *p[k:])]), k, f[(lang, *p[:k])], f[(lang, *p[k:])]) for k in range(1, len(p)))
            out.append((lang, p, a, l, r, s))
    longer: dict = {}
    for lang, p, a, *_ in out:
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                key = (lang, *p[i : i + m])
                longer[key] = max(longer.get(key, 0), a)
    left = [x for x in out if 100 * longer.get((x[0], *x[1]), 0) < percent * x[2] or (x[0], *x[1]) not in longer]
    left.sort(key=lambda x: (x[0], -x[5], -x[2], " ".join(x[1]).encode()))
    seen, ranked = Counter(), []
    for lang, p, a, l, r, s in left:
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], " ".join(p), a, l, r, total[lang], s))
    return ranked


def some_rows(n=400):
    rng = random.Random(7)
    words = ["The", "the", "of", "a", "x", "new", "york", "city", "É", "é", "日本", "\x00", "\x1cb", "*", "x"]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", ";", "\xa0"]
    rows = [(rng.choice(["en", "fr", None, ""]), "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 60)))) for _ in range(n)]
    return [*rows, ("en", None), ("en", ""), (None, None), ("xx", "one two"), ("en", "new york city " * 300), ("en", "new york city " * 300), ("en", "x " * 3000)]


def test_equal_to_counting_everything(spark, monkeypatch):
    rows = some_rows()
    df = spark.createDataFrame([(i, *r, "c", 1) for i, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int")
    monkeypatch.setattr(phrases, "PART", 500)
    for hot, head, longest, top in ((1 << 20, 1 << 16, 3, 2000), (40, 3, 3, 2000), (40, 5, 4, 20)):
        monkeypatch.setattr(phrases, "HEAD", head)
        got = sorted(map(tuple, phrases.collocations(df, 10, longest, 50, top, hot).collect()))
        assert got == sorted(plain(rows, 10, longest, 50, top)) and len(got) > 30
    assert phrases.collocations(df.limit(0)).collect() == []
    assert phrases.collocations(df.filter("lang = 'xx'")).collect() == []


def test_blocks_hold_all_pieces_once():
    rows = some_rows()
    batches = [pa.RecordBatch.from_arrays([pa.array(["und" if a is None else a for a, _ in rows[i : i + 50]]), pa.array([None if t is None else t.encode() for _, t in rows[i : i + 50]], pa.binary())], names=["lang", "text"]) for i in range(0, len(rows), 50)]
    for size in (10, 1000, 1 << 20):
        got: Counter = Counter()
        for lang, data in phrases.blocks(iter(batches), size):
            got.update((lang, tuple(p.split())) for p in data.split(phrases.CUT) if p.split())
        want = Counter(("und" if a is None else a, tuple(p.split())) for a, t in rows for p in (t or "").encode().translate(phrases.PLAIN).split(phrases.CUT) if p.split())
        assert got == want


def test_each_phrase_has_one_owner():
    rng = np.random.default_rng(1)
    for longest in (2, 3, 4):
        x = rng.integers(0, 6, 500)
        rare = np.array([0, 5, 5, 9, 2, 7], np.uint64)
        cols, n = phrases.grouped(c := phrases.windows(x, rare[x], longest), np.ones(len(c[0]), np.int64))
        for size in range(2, longest + 1):
            want = Counter(tuple(x[i : i + size].tolist()) for i in range(len(x) - size + 1) if (x[i : i + size] > 0).all())
            got: Counter = Counter()
            for s in range(longest - size, longest):
                for p, k in zip(zip(*(c.tolist() for c in cols[s : s + size]), strict=True), n.tolist(), strict=True):
                    if p[0] and p[-1]:
                        got[p] += k
            assert got == want


def test_rows_of_many_wide_columns_are_grouped_exactly():
    rng = np.random.default_rng(2)
    cols = [rng.integers(0, 3, 1000) * (1 << 40) for _ in range(5)]
    out, n = phrases.grouped(cols, np.ones(1000, np.int64))
    assert Counter(zip(*(c.tolist() for c in cols))) == dict(zip(zip(*(c.tolist() for c in out)), n.tolist()))


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(map(tuple, queries.op13_phrases(spark, SF).collect())) == sorted(con.sql(queries.ORACLE_SQL["op13_phrases"]).fetchall())
