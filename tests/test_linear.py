"""Time in proportion to the text: rewriting, deny lists, restoring, every detector."""

import random
import re
import time

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilmark.functions import detectors as D
from veilmark.operators import rewrite
from veilmark.operators import text as T
from veilmark.operators.structure import Mapping, process
from veilmark.operators.tokens import restore


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()


def took(work):
    began = time.time()
    work()
    return time.time() - began


@pytest.fixture(scope="module")
def many(spark):
    """A text of 4 MB with 200,000 spans."""
    text = " ".join(f"u{i:06d}@example.fr" for i in range(200_000))
    rows = spark.createDataFrame([(1, text), (2, "rien"), (3, None)], "k int, text string")
    rows.cache().count()
    return rows, text


def test_rewriting_of_200000_spans(spark, many):
    rows, text = many
    found = T.detect_spans(rows, only=frozenset({"EMAIL"})).cache()
    assert found.select(F.sum(F.size("spans"))).first()[0] == 200_000
    kernel = took(lambda: rewrite.put(text, [(20 * i, 20 * i + 18, "***") for i in range(200_000)]))
    assert kernel < 5
    for make, want in ((T.anonymise, " ".join(["***"] * 200_000)), (T.redact, " ".join(["█" * 18] * 200_000))):
        out: dict = {}
        seconds = min(took(lambda: out.update({r.k: r.result for r in make(found).collect()})) for _ in range(2))
        assert out == {1: want, 2: "rien", 3: None} and seconds < 30, seconds
    out, words = T.pseudonymise(found, "k", numbering="exact")
    got = {r.k: r.result for r in out.collect()}
    assert got[1] == " ".join(f"[EMAIL_{i + 1}]" for i in range(200_000)) and got[2] == "rien" and got[3] is None
    back = restore(out, words)
    assert {r.k: (r.restored, r.n_restored) for r in back.collect()} == {1: (text, 200_000), 2: ("rien", 0), 3: (None, 0)}


def test_records_of_200000_spans(spark, many):
    rows, _ = many
    out = process(rows, "k", Mapping(texts=("text",)), "anon", only=frozenset({"EMAIL"})).rows
    assert {r.k: (r.text, r.score) for r in out.collect()} == {1: (" ".join(["***"] * 200_000), 600_000), 2: ("rien", 0), 3: (None, 0)}


def rule(text, spans, entries):
    """Deny entries one by one, each hit against all spans."""
    spans = list(spans)
    for entry in sorted({w for w in entries if w}, key=lambda w: (-len(w), w)):
        for m in re.finditer(re.escape(entry), text, re.I):
            if not any(s.start < m.end() and m.start() < s.end for s in spans):
                spans.append(D.Span(m.start(), m.end(), "personne", m.group(), 1.0, "blacklist", "direct"))
    return sorted(spans, key=lambda s: (s.start, -s.end))


def test_deny_lists_equal_the_rule():
    rng, letters = random.Random(1), "abAB ſsSkKKßẞiİIıµμΜﬅﬆéÉ"
    for _ in range(2000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        entries = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 4))) for _ in range(rng.choice([1, 3, 20]))]
        spans = [D.Span(a, a + 3, "x", t[a : a + 3], 1.0, "regex", "direct") for a in [rng.randrange(len(t) - 3)]] if len(t) > 5 and rng.random() < 0.5 else []
        own = entries[:2] if rng.random() < 0.5 else []
        assert D.apply_lists(t, spans, (), entries[len(own) :], own) == rule(t, spans, entries)


def test_deny_lists_of_any_size():
    rng = random.Random(2)
    entries = frozenset(f"name{i:05d}" for i in range(10_000))
    text = " ".join(f"NAME{rng.randrange(20_000):05d}" for _ in range(200_000))
    found = []
    D.apply_lists("", [], (), entries)
    assert took(lambda: found.extend(D.apply_lists(text, [], (), entries))) < 20 and len(found) > 90_000


UNITS = ("a ", "1 ", "A ", "a.", "1.", "a@", "@", "a-eyJ", "eyJaaaaaaaaaa.", "né ", "né", " ", "rue ", "1 rue ", "A\n", "De: ", "De: A ", "12", "0 6", "FR76 ", "AB", "a:", "::", "ab-", "SA ", "Ab SA ", "SUR-", "AAA-SUR-", "tel: 1", "cvv ", "www.", "é", "-", "(at)", "a(at)b ", "+33 ", "1,2", "12.5, ", "sk_", "sk_a", "<a@b.c", "point ", "A' ")


@pytest.mark.parametrize("unit", UNITS)
def test_every_detector_takes_linear_time(unit):
    """300 kB of any unit, and of the unit after an opening word, in seconds: what grows with the square takes minutes."""
    for text in (unit * (300_000 // len(unit)), "né" + unit * (300_000 // len(unit)) + "x@y"):
        for d in D.DETECTORS:
            seconds = took(lambda: D.detect_regex(text, True, True, frozenset({d.name})))
            assert seconds < 10, (d.name, unit, seconds)
