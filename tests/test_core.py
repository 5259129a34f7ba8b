"""Facts about detectors, overlap folding, tokens, rewriting, risk and files."""

import pytest
from pyspark.sql import SparkSession

from veilmark.functions import detectors as D
from veilmark.operators import text as T
from veilmark.sources import files


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()


def kinds(text, **options):
    return [s.entity_type for s in D.detect(text, **options)]


def test_validators():
    assert D.luhn_check("4532015112830366") and not D.luhn_check("1234567890123456") and not D.luhn_check("12345")
    assert D.nir_check("1 85 01 75 123 456 78") and not D.nir_check("1 85 13 75 123 456 78")
    assert D.siret_check("732 829 320 00074")
    assert D.iban_check("FR7630006000011234567890189") and not D.iban_check("XX1234")
    assert D.negative_context("voir page 42 du rapport", 10, 2) and D.negative_context("total de 300 euros", 9, 3)
    assert not D.negative_context("code postal 94110 France", 13, 5)


def test_detectors():
    assert kinds("née le 12/04/1985") == [] and "date_naiss_txt" in kinds("née le 12/04/1985", fort=True)
    assert "ipv4_txt" in kinds("IP: 192.168.1.1", tech=True) and kinds("IP: 192.168.1.1") == []
    assert "cp_txt" not in kinds("94110 Montreuil") and "cp_txt" in kinds("94110 France")
    text = "Ecrire à bob@example.com ou 06 12 34 56 78, www.example.com"
    spans = D.detect(text, fort=True, tech=True)
    assert all(text[s.start : s.end] == s.value for s in spans)
    assert all(a.end <= b.start for a, b in zip(spans, spans[1:]))
    assert {"email_txt", "tel_txt", "url_txt"} <= {s.entity_type for s in spans}


def test_lists_and_model():
    assert kinds("bob@example.com", whitelist=["BOB@example.com"]) == []
    assert kinds("voir dupont et Dupont", blacklist=["Dupont", ""]) == ["personne", "personne"]
    ner = lambda t: [D.Span(0, 4, "personne", t[:4], 0.5, "ner", "direct")]
    assert kinds("Jean dort", mode="hybrid", ner=ner) == []
    assert kinds("Jean dort", mode="hybrid", ner=ner, names=frozenset({"JEAN"})) == ["personne"]


def test_round_trip(spark):
    df = spark.createDataFrame([(1, "a bob@x.fr b al@y.fr"), (2, "bob@x.fr"), (3, None), (4, "rien")], "id long, text string")
    found = T.detect_spans(df)
    out, words = T.pseudonymise(found, "id", numbering="prefix")
    assert {r.token: r.original for r in words.collect()} == {"[EMAIL_1]": "bob@x.fr", "[EMAIL_2]": "al@y.fr"}
    assert {r.id: r.result for r in out.collect()}[2] == "[EMAIL_1]"
    back = {r.id: r.restored for r in T.restore(out, words, "id").collect()}
    assert back[1] == "a bob@x.fr b al@y.fr" and back[2] == "bob@x.fr" and back[4] == "rien"
    assert {r.id: r.score for r in T.with_risk(found).collect()} == {1: 6, 2: 3, 3: 0, 4: 0}


def test_levels(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (0, 9, 10, 49, 50, 99, 100)], "s int").select(T.risk_level(T.F.col("s"))).collect()]
    assert got == ["NUL", "FAIBLE", "MODÉRÉ", "MODÉRÉ", "ÉLEVÉ", "ÉLEVÉ", "CRITIQUE"]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("nom,email\nX,x@y.fr\nZ,z@y.fr\n")
    (tmp_path / "b.txt").write_text("bonjour")
    assert files.load(spark, str(tmp_path / "a.csv")).count() == 2
    assert files.load(spark, str(tmp_path / "b.txt")).first()._source == "b.txt"
    with pytest.raises(ValueError):
        files.load(spark, "a.exe")


@pytest.mark.parametrize(
    "name, text, value",
    [
        ("NUM_FISCAL", "fiscal 1234567890123 fin", "1234567890123"),
        ("NIR", "x 1 - 85 . 01 -- 2A 123  456 78 y", "1 - 85 . 01 -- 2A 123  456 78"),
        ("IBAN", "iban pl61-1090-1014-0000-0712-1981-2874.", "pl61-1090-1014-0000-0712-1981-2874"),
        ("CB", "cb 4532\n0151  1283--0366 fin", "4532\n0151  1283--0366"),
        ("CVV", "cryptogramme: 123", "cryptogramme: 123"),
        ("SIRET", "siret 732.829.320 00074", "732.829.320 00074"),
        ("MAILTO", "MAILTO:bob@x.fr", "MAILTO:bob@x.fr"),
        ("EMAIL_OBFUSCATED", "voir bob @ mail . co.uk fin", "bob @ mail . co.uk"),
        ("EMAIL_OBFUSCATED", "a" * 100 + " [at] mail [dot] fr.eu", "a" * 100 + " [at] mail [dot] fr.eu"),
        ("EMAIL_OBFUSCATED", "-.bob[arobase]mail point fr", "bob[arobase]mail point fr"),
        ("EMAIL_AVEC", "De : Jean Marie " + "Dupont " * 40 + "<j@x.fr>", "De : Jean Marie " + "Dupont " * 40 + "<j@x.fr>"),
        ("EMAIL_ESPACE", "bob@mail . co.uk", "bob@mail . co.uk"),
        ("EMAIL_ESPACE", "bob@mail fr", "bob@mail fr"),
        ("EMAIL", "bob@x.fr", "bob@x.fr"),
        ("TEL_FUZZY", "tel 06 123 456 78 fin", "06 123 456 78"),
        ("TEL_PREFIXE", "Tel : " + "12 " * 20 + "fin", "Tel : " + "12 " * 20),
        ("TEL", "au +336--12.34 56 78", "+336--12.34 56 78"),
        ("URL", "sur https://x.fr/a?b", "https://x.fr/a?b"),
        ("ORGA", "la Un Deux Trois Quatre Cinq Six Sept SARL", "Un Deux Trois Quatre Cinq Six Sept SARL"),
        ("ORGA", "Les Amis ASSOCIATION et", "Les Amis ASSOCIATION"),
        ("VOIE_NUM", "12345 rue de la paix, Paris", "12345 rue de la paix"),
        ("VOIE_SANS", "vers route Nationale.", "route Nationale"),
        ("CP", "code 94110 France", "94110"),
        ("DATE_NAISS", "naissance du : 1.2.85", "naissance du : 1.2.85"),
        ("GPS", "ici 48.85, 2.35 fin", "48.85, 2.35"),
        ("PLAQUE", "auto AB 123 CD", "AB 123 CD"),
        ("VILLE_COMPOSEE", "VILLENEUVE SUR LOT", "VILLENEUVE SUR LOT"),
        ("IPV4", "ip 010.0.0.1", "010.0.0.1"),
        ("IPV6", "ip ::ffff:abcd", "::ffff:abcd"),
        ("IPV6", "ip fe80:1:: fin", "fe80:1::"),
        ("MAC", "00:1A-2b:3c:4d:5e", "00:1A-2b:3c:4d:5e"),
        ("JWT", "eyJabcdefghij.eyJabcdefghij.abcdefghij", "eyJabcdefghij.eyJabcdefghij.abcdefghij"),
        ("API_KEY", "api_abcdefghij0123456789", "api_abcdefghij0123456789"),
    ],
)
def test_each_detector(name, text, value):
    assert [s.value for s in D.detect_regex(text, fort=True, tech=True, only=frozenset({name}))] == [value]


def test_number_contexts_and_long_runs():
    assert all(D.negative_context(f"{w} 12345", len(w) + 1, 5) for w in ("décret", "dossier", "lot", "ref.", "fig.", "p.", "kg", "degrés"))
    assert D.detect_regex("ABC " * 20000 + "a.b-" * 20000) == []


def test_persons_share_a_token_whatever_the_order(spark):
    df = spark.createDataFrame([(1, "Jean Dupont"), (2, "dupont jean"), (3, "Marie Dupont")], "id long, text string")
    found = T.detect_spans(df, blacklist=("Jean Dupont", "Dupont Jean", "Marie Dupont"))
    out, words = T.pseudonymise(found, "id")
    assert {r.id: r.result for r in out.collect()} == {1: "[PERSONNE_1]", 2: "[PERSONNE_1]", 3: "[PERSONNE_2]"}
