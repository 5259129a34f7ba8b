"""Nulls, empty tables, repeated rows, long texts and clashing columns for every operator; the stages and the whole pipeline."""

import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from veilmark.llm import bpe, decontaminate, language, minhash, neighbours, private, quality, queries, secrets, sharding, stages, training_order
from veilmark.llm.common import crc_mod

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()


CLASH = "ids string, decoded string, n_tokens string, spans string, matches string, lang_pred string, score string, number string, comp string, slot string, shard string, size string, row string, gram string"


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, nulls in every column, a long text, columns named like outputs and like helpers."""
    rnd = random.Random(5)
    long_text = " ".join(rnd.choice(("alpha", "beta", "gamma.", "x1", "Ça", "token=abcdef123", "1.2.3.4")) for _ in range(60_000))
    rows = [(1, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (1, "other words are here", "fr", None), (None, "a b c d e f", None, "s"), (2, None, "en", "s"), (3, "", None, None), (4, long_text, "en", "t"), (None, None, None, None), (5, "12 34", "en", "s")]
    width = len(CLASH.split(", "))
    return spark.createDataFrame([(*r, len(r[1] or ""), *(["c"] * width)) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


def test_odd_rows_pass_every_operator(spark, odd):
    none, n = odd.limit(0), odd.count()
    source = queries.tokenizer_source()
    t = bpe.tokenizer(source)
    out = bpe.decode(bpe.encode(odd, source), source).collect()
    assert len(out) == n and all(list(r.ids) == t.encode(r.text or "", add_special_tokens=False).ids and r.decoded == t.decode(list(r.ids), skip_special_tokens=False) and r.n_tokens == "c" for r in out)
    assert bpe.encode(none, source).columns == [c for c in odd.columns if c != "ids"] + ["ids"] and bpe.encode(none, source).count() == 0
    assert "text" not in bpe.encode(odd, source, drop_text=True).columns
    for found in (secrets.find_secrets(odd, ["doc_id", "spans"]), private.find_private(odd, ["doc_id", "spans"])):
        rows = found.collect()
        assert len(rows) == n and found.columns == ["doc_id", "spans"] and not any(r.spans for r in rows if r.doc_id in (1, 2, 3))
    assert secrets.redact_secrets(odd).columns == odd.columns and secrets.redact_secrets(odd).filter("text like '%abcdef123%'").count() == 0
    assert secrets.find_secrets(none, ["doc_id"]).count() == private.find_private(none, ["doc_id"]).count() == 0
    near = minhash.near_duplicates(odd).collect()
    assert len(near) == n and Counter((r.doc_id, r.component_id) for r in near) == Counter({(1, 1): 3, (None, 1): 1, (2, 2): 1, (3, 3): 1, (4, 4): 1, (None, None): 1, (5, 5): 1})
    assert minhash.near_duplicates(none).count() == 0
    placed = sharding.assign(odd, 4).collect()
    assert len(placed) == n and sorted(Counter(r.shard for r in placed).values()) == [2, 2, 2, 3] and sharding.assign(none, 4).count() == 0
    assert all(sorted(r.slot for r in placed if r.shard == s) == list(range(sum(r.shard == s for r in placed))) for s in range(4))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (4, None, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    scores = quality.score(odd, quality.train(odd, labels), ["doc_id", "score"]).collect()
    assert len(scores) == n and all(0 <= r.score <= 1 for r in scores)
    assert {r.score for r in quality.score(odd, quality.train(odd, labels.limit(0)), ["doc_id"]).collect()} == {0.5} and quality.score(none, quality.train(none, labels), ["doc_id"]).count() == 0
    found = language.identify(odd, language.train(odd), ["doc_id", "score"]).collect()
    assert len(found) == n and Counter(r.lang_pred for r in found)["und"] == 4
    assert language.identify(none, language.train(none), ["doc_id"]).count() == 0
    bench = spark.createDataFrame([(1, "other words are here"), (None, None)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find(odd, bench, ["doc_id"]).collect()] == [(1, 1)]
    got = training_order.written(odd).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))


def test_stages_keep_columns_and_rows(spark, odd, tmp_path):
    spark.createDataFrame([(1, "other words are here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd.withColumn("k", F.lit(1))
    ends = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name != "bpe":
            assert out.columns == docs.columns
        assert set(docs.columns) <= set(out.columns)
        ends[name] = Counter((r.doc_id, r.text) for r in out.collect())
    a, other = "a b c d e f", "other words are here"
    whole = Counter((r.doc_id, r.text) for r in odd.collect())
    assert ends["language_id"] == Counter({k: v for k, v in whole.items() if k[1] and k[1] != "12 34"})
    assert ends["minhash_dedup"] == Counter([k for k in whole if k not in ((None, a),)]) and ends["decontaminate"] == whole - Counter([(1, other)])
    assert sum(ends["secret_scan"].values()) == sum(ends["bpe"].values()) == len(odd.collect())


def test_pipeline_equals_its_parts(spark, tmp_path):
    """Every stage's rows against a plain version of it on documents with planted copies, items, secrets and foreign scripts."""
    rnd = random.Random(6)
    word = lambda: rnd.choice(("the", "house", "is", "of", "green", "and", "walk", "under", "tree")) + str(rnd.randrange(400))
    texts = [" ".join(word() for _ in range(60)) for _ in range(60)]
    item = " ".join(word() for _ in range(30))
    texts += [texts[0], texts[1] + " end", " ".join(texts[2].split()[:-1] + ["x"]), f"{texts[3]} {item}", "see " + item.replace("the", "a"), "password=hunter22 " + " ".join(word() for _ in range(40)), "Все люди рождаются свободными и равными в своем достоинстве", None, "", "1 2 3"]
    docs = spark.createDataFrame([(i, t, "en" if i < 60 else None, "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = {i: t for i, t in enumerate(texts) if i not in (66, 67, 68, 69)}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in left.items() for w in [t.lower().split()]}
    left = {i: t for i, t in left.items() if not any(j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in left)}
    own = [w.lower() for w in re.findall(r"\w+", item)]
    left = {i: t for i, t in left.items() if decontaminate.align(np.array([hash(w) for w in own]), np.array([hash(w) for w in re.findall(r"\w+", t.lower())]))[0] < len(own)}
    t = bpe.tokenizer(queries.tokenizer_source())
    want = {}
    for i, x in left.items():
        x = x.replace("password=hunter22", "[SECRET]")
        want[i] = (x, len(x), t.encode(x, add_special_tokens=False).ids)
    assert 60 not in want and 61 not in want and 63 not in want and 65 in want
    got = {r.doc_id: (r.text, r.n_chars, list(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1200, 10))
    v[100] = v[0]
    v[7] *= 1e200
    rows = [(i, v[i].tolist(), "x") for i in range(1200)] + [(1, v[1].tolist(), "again"), (5000, [1.0], "short"), (5001, None, ""), (5050, [float("inf")] + [1.0] * 9, ""), (None, v[2].tolist(), "")]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")).collect()
    ids = np.array([r[0] for r in rows[:1201]])
    x = np.array([r[1] for r in rows[:1201]])
    x = x / np.abs(x).max(1, keepdims=True)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 1200, 50):
        s = u @ u[q]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[1] for m in mine] == ids[order].tolist() and np.allclose([m[2] for m in mine], s[order], atol=1e-12)
    assert {r.query_id for r in got} == set(range(0, 1200, 50)) and neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in neighbours.search(few).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, -1.0)]


def test_neighbours_recall_on_the_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in neighbours.search(e).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = e.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = u @ u[i]
        s[i] = -2
        hit, total = hit + len(got[ids[i]] & set(ids[np.lexsort((ids, -s))[:5]].tolist())), total + 5
    assert hit >= 0.95 * total


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.op8_quality(spark, SF).join(labels, "doc_id").collect()
    assert queries.op8_quality(spark, SF).count() == docs.count() and all(r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum((r.score >= 0.5) == (r.quality == 1) for r in held) / len(held)
    assert right >= 0.9 and right > max(np.mean([r.quality for r in held]), 1 - np.mean([r.quality for r in held]))


def test_language_on_held_out_rows_and_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = queries.op9_language(spark, SF).filter("held_out").join(docs.filter("lang is not null"), "doc_id").filter("lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    known = ["the children went to school and the weather was fine today with them", "le chien est dans la maison avec les enfants et nous mangeons du pain"]
    train = spark.createDataFrame([(i, known[i % 2], ["en", "fr"][i % 2]) for i in range(200)], "doc_id long, text string, lang string")
    found = language.identify(train.limit(1).withColumn("text", F.lit(known[0] + ". " + known[1])), language.train(train), ["doc_id"]).first()
    assert [s.lang for s in found.lang_spans] == ["en", "fr"] and abs(found.lang_spans[1].start - len(known[0])) < 12


def test_hilbert_runs_prune_files(spark):
    """A filter on two dimensions touches fewer shards than rows dealt by hash would."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    placed = sharding.assign(docs, 40).join(docs.select("doc_id", "lang", "source"), "doc_id").collect()
    combos = Counter((r.lang, r.source) for r in placed)
    pair, n = min(((k, v) for k, v in combos.items() if v >= 20), key=lambda x: x[1])
    touched = {r.shard for r in placed if (r.lang, r.source) == pair}
    by_hash = {zlib.crc32(str(r.doc_id).encode()) % 40 for r in placed if (r.lang, r.source) == pair}
    assert len(touched) < 0.7 * len(by_hash)


def test_private_spans_of_long_texts_and_base_patterns():
    rnd = random.Random(7)
    shapes = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    parts = ["a", "@", ".", "-", "+", "1", "22", "255", "256", "0", " ", "(", "4532015112830366", "b.fr", "é"]

    def fine(kind, v):
        d = re.sub(r"[^0-9]", "", v)
        return kind == "email" or kind == "ip" and all(int(x) <= 255 for x in v.split(".")) or kind == "card" and 14 <= len(d) <= 19 and private.luhn(d) or kind == "phone" and 10 <= len(d) <= 15

    for _ in range(4000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randrange(30)))
        want = sorted((m.start(), n, m.end()) for n, (k, s) in enumerate(shapes) for m in re.finditer(s, t) if fine(k, m.group()))
        assert private.base_spans(t) == [(a, e, shapes[n][0]) for a, n, e in want]
    weights = private.fitted()
    for t in ("1" * 1_000_000, "1" + " " * 1_000_000, "@" + " " * 500_000, "a" * 1_000_000 + "@", "+1" + "(" * 500_000, "1 " * 3000):
        assert private.added_spans(t, private.base_spans(t), weights) == []


def brute_segments(w, weights, base):
    """All paths by recursion: the best value of any segmentation."""
    score = {k: s for k, (s, _) in private.segments(w, weights).items()}
    n = len(w.words)
    best = [0.0] + [-np.inf] * n
    for j in range(1, n + 1):
        for i in range(j):
            for k in ("", *private.KINDS):
                s = score.get((i, j, k))
                if s is not None and not (k and any(a < w.end[j - 1] and w.first[i] < b for a, b, _ in base)):
                    best[j] = max(best[j], best[i] + s)
    return best[n], score


def test_the_field_takes_the_best_segmentation():
    weights, made = private.fitted(), private.sentences(np.random.default_rng(3))
    for _ in range(150):
        text = " ".join(next(made)[0] for _ in range(2))
        base = private.base_spans(text)
        w = private.Window(text)
        value, score = brute_segments(w, weights, base)
        assert abs(sum(score[x] for x in private.best(w, weights, base)) - value) < 1e-9


def test_folds_and_contract_columns(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", crc_mod("doc_id", 4).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.doc_id).encode()) % 4 for r in rows)
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES) == list(range(1, 14))
