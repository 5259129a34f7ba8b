"""SentencePiece encoding and decoding against the library."""

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import SparkSession

from veilmark.llm import pieces, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()


@pytest.fixture(scope="module")
def source():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def sp(source):
    return sentencepiece.SentencePieceProcessor(model_proto=source)


def ids_of(data):
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


def odd_texts(sp):
    rng = random.Random(1)
    parts = ["a", "b", "ab", "the", " ", "  ", "▁", "\n", "\t", "\x00", "é", "日", "😀", "in", "ing", "s", "er", "1", "(", "-", "=", "aa", "́", "ß", "THE", "\xa0", "ı", "<s>", "<0x0A>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["".join(sp.id_to_piece(rng.randrange(259, 32000)) for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    return [*texts, "", " ", "a" * 5000, " " * 3000, "ab" * 4000, "the" * 5000, "-" * 7777, "=-" * 3000, "▁" * 999, "".join(rng.choice("abcdeinst") for _ in range(20_000))]


def test_ids_equal_the_library(source, sp):
    texts = odd_texts(sp)
    assert [ids_of(x) for x in pieces.encoder(source)(texts)] == sp.encode(texts)


def test_memo_is_bounded_and_changes_nothing(source, sp, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 20)
    monkeypatch.setattr(pieces, "LONG", 5)
    work, texts = pieces.encoder(source), odd_texts(sp)[:400]
    assert [ids_of(x) for i in range(0, 400, 20) for x in work(texts[i : i + 20])] == sp.encode(texts)


def test_rounds_and_heap_make_the_same_merges(source, sp):
    m = pieces.model(source)
    for t in odd_texts(sp)[:300]:
        if t:
            start = m.symbol[[ord(c) for c in t]]
            one = [0] * len(t)
            whole = pieces.rounds(m, start.copy(), pieces.np.array(one, "i4"))[0].tolist()
            assert whole == pieces.by_heap(m, start.tolist()) == pieces.rounds(m, start.copy(), pieces.np.array(one, "i4"), most=2)[0].tolist()


def test_any_ids_decode_as_the_library_does(source, sp):
    m, rng = pieces.model(source), random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000), 28705, 259]) for _ in range(rng.randint(0, 12))]
        assert pieces.text_of(m, ids) == sp.decode(ids), ids


def test_rows_with_nulls_repeats_and_clashing_columns(spark, source, sp):
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (2, "", "x", "y"), (None, "a  b\nc " * 5000, None, "y"), (4, "Ça va?", "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    out = pieces.decode(pieces.encode(df, source), source)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = sorted(map(repr, ((r.doc_id, r.text, list(r.ids), r.decoded) for r in out.collect())))
    assert got == sorted(map(repr, ((i, t, sp.encode(t or ""), t or "") for i, t, *_ in rows)))
    assert pieces.decode(pieces.encode(df.limit(0), source, drop_text=True), source).collect() == []
    assert [r.decoded for r in pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), source).collect()] == [""]


def test_query_equals_the_library(spark, sp):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = sp.encode(r.text or "")
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    assert {r.doc_id: tuple(r)[1:] for r in queries.op12_sentencepiece(spark, SF).collect()} == want
