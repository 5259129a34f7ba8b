"""Records, paths, JSON in strings, names, the model operator, files, the command line, streams."""

import json
import zipfile

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilmark import cli
from veilmark.functions import schema_tools
from veilmark.functions.detectors import Span, detect, known_name
from veilmark.operators import diagnose, model, report
from veilmark.operators import text as T
from veilmark.operators.structure import Mapping, process
from veilmark.operators.tokens import NUMBERING, token_dictionary
from veilmark.sources import files, office
from veilmark.streaming.tokens import dictionary_at, pseudonymise_batch


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()


REPORT = {"Report": {"Firstname": "Marie", "Lastname": "Durand", "Age": 41, "None": 0, "Question": "Marie Durand, marie@test.fr", "Details": [{"Value": "voir MARIE"}, {"Other": 1}, {"Value": ""}], "Tags": ["a@b.fr", 3]}, "z": "é"}
MAPPING = {
    "structure": {"unwrap": {"field": "body"}},
    "champs_sensibles": {"Report.Firstname": {"type": "prenom", "jeton": "PRENOM"}, "Report.Age": {"type": "id", "jeton": "AGE"}, "Report.None": {"type": "id", "jeton": "AGE"}, "ref": {"type": "nom", "jeton": "REF"}},
    "texte_libre": ["Report.Question", "Report.Details[].Value", "Report.Tags[]", "note"],
    "lookup_noms": {"prenom": "Report.Firstname", "nom": "Report.Lastname"},
}


def rows_of(spark):
    rows = [("b", json.dumps(REPORT, ensure_ascii=False), "X1", "x@y.fr", True), ("a", "{broken", "x1 ", None, False), (None, None, "", "", None), ("b", "[1]", None, "x@y.fr", True)]
    return spark.createDataFrame(rows, "k string, body string, ref string, note string, flag boolean")


def test_json_in_strings(spark):
    done = process(rows_of(spark), "k", Mapping.from_dict(MAPPING))
    out = {(r.k, r.body): r for r in done.rows.collect()}
    assert len(out) == 4 and done.rows.columns == ["k", "body", "ref", "note", "flag", "score", "level", "error"]
    (full,) = [r for r in out.values() if r.body and r.body.startswith('{"R')]
    body = json.loads(full.body)["Report"]
    assert body["Firstname"] == "[PRENOM_1]" and body["Age"] == "[AGE_1]" and body["None"] is None and body["Lastname"] == "Durand"
    # Both names are denied in free text; each has its own token, in order of first appearance.
    assert body["Question"] == "[PERSONNE_1] [PERSONNE_2], [EMAIL_1]" and body["Details"] == [{"Value": "voir [PERSONNE_1]"}, {"Other": 1}, {"Value": ""}] and body["Tags"] == ["a@b.fr", 3]
    assert list(json.loads(full.body)) == ["Report", "z"] and '"z": "é"' in full.body
    assert {(r.k, r.ref, r.note) for r in out.values()} == {("b", "[REF_1]", "[EMAIL_3]"), ("a", "[REF_1]", None), (None, "", ""), ("b", None, "[EMAIL_3]")}
    assert out["a", "{broken"].body == "{broken" and out["b", "[1]"].body == "[1]"
    # Fields: direct 3, two ids 1 each, ref 3; texts: two names, address, name, address in a plain list, address.
    assert full.score == 3 + 1 + 1 + 3 + 6 * 3 and {r.original for r in done.tokens.filter("prefix = 'REF'").collect()} == {"x1"}


def test_leaks_of_plain_lists_can_be_mended_and_constants(spark):
    m = Mapping.from_dict(MAPPING)
    full = process(rows_of(spark), "k", m, fix_leaks=True).rows.filter("body like '{\"R%'").first()
    assert json.loads(full.body)["Report"]["Tags"][0] == "a@b.fr"
    df = spark.createDataFrame([(1, ["a@b.fr", "x"], "n", "t", "u"), (2, None, "n", "t", "u")], "k int, tags array<string>, g string, i string, u string")
    m = Mapping.from_dict({"champs_sensibles": {"g": {"type": "genre", "jeton": "G"}, "i": {"type": "id", "jeton": "I"}, "u": {"type": "uuid", "jeton": "U"}}, "texte_libre": ["tags[]", "gone", "g.x"]})
    out = {r.k: r for r in process(df, "k", m, "anon", fix_leaks=True).rows.collect()}
    assert out[1].tags == ["***", "x"] and out[2].tags is None and out[1].g == "Non renseigné" and [out[1].i, out[2].i] == ["1", "2"] and len(out[1].u) == 36
    assert process(df, "k", m, "anon").rows.filter("k = 1").first().tags == ["a@b.fr", "x"]


def test_empty_records_and_failing_ones(spark):
    m = Mapping.from_dict({"texte_libre": ["t"]})
    none = process(spark.createDataFrame([], "k int, t string"), "k", m)
    assert none.rows.count() == 0 and none.tokens.count() == 0
    df = spark.createDataFrame([(1, "a@b.fr"), (2, "c@d.fr")], "k int, t string")
    bad = process(df, "k", m, only=5)
    assert {(r.k, r.t, r.error) for r in bad.rows.collect()} == {(1, "a@b.fr", "TypeError"), (2, "c@d.fr", "TypeError")}
    assert report.file_score(bad.rows).first().errors == 2 and report.file_score(none.rows).first().level == "NUL"


def test_numbers_follow_any_key(spark):
    for kind, keys in (("string", ["k2", "k1", None]), ("double", [2.5, 1.5, None])):
        df = spark.createDataFrame([(k, f"u{i}@x.fr et u{i}@x.fr") for i, k in enumerate(keys)], f"k {kind}, text string").repartition(3)
        out, words = T.pseudonymise(T.detect_spans(df, only=frozenset({"EMAIL"})), "k")
        assert {r.original: r.num for r in words.collect()} == {"u2@x.fr": 1, "u1@x.fr": 2, "u0@x.fr": 3}
        assert {r.result for r in out.collect()} == {f"[EMAIL_{i}] et [EMAIL_{i}]" for i in (1, 2, 3)}
    occ = spark.createDataFrame([(0, 0, "email", "A@b.fr"), (1, 0, "email_txt", "a@B.fr"), (2, 0, "x", " ")], "k int, span_ord int, entity_type string, value string")
    tokens = {n: sorted((r.token, r.original) for r in token_dictionary(occ, "k", numbering=n).collect()) for n in NUMBERING}
    assert tokens == {"type": [("[EMAIL_1]", "A@b.fr"), ("[EMAIL_1]", "a@B.fr")], "prefix": [("[EMAIL_1]", "A@b.fr")], "exact": [("[EMAIL_1]", "A@b.fr"), ("[EMAIL_2]", "a@B.fr"), ("[X_1]", " ")]}


def test_restore_keeps_rows_and_case(spark):
    df = spark.createDataFrame([(1, "A@X.fr, a@x.fr"), (1, None), (None, "rien [EMAIL_9]"), (2, "")], "k int, text string")
    out, words = T.pseudonymise(T.detect_spans(df, only=frozenset({"EMAIL"})), "k", numbering="exact")
    back = T.restore(out, words)
    assert back.count() == 4 and {(r.text, r.restored) for r in back.collect()} == {(t, t) for _, t in [(1, "A@X.fr, a@x.fr"), (1, None), (None, "rien [EMAIL_9]"), (2, "")]}


def test_model_parts_and_names(spark):
    text = ("Phrase une. " * 1500 + "Jean. ") + "x" * 12_000 + ". Jean dort. Jean."
    found = list(model.parts(text, 10_000))
    assert all(text[o : o + len(p)] == p for o, p in found) and sum(p.count("Jean") for _, p in found) == 3 and all(len(p) <= 10_000 or " " not in p for _, p in found)
    ask = model.Model(lambda: lambda t, labels: [("person", i, i + 4, "Jean", 0.91239) for i in range(len(t)) if t.startswith("Jean", i)] + [("date", 0, 1, t[:1], 0.1)])
    spans = ask(text)
    assert [s.start for s in spans] == [text.index("Jean"), text.index("Jean dort")] and spans[0][2:] == ("personne", "Jean", 0.9124, "ner", "direct")
    assert known_name("Zoé", frozenset({"ZOE"})) and not known_name("Zoé", frozenset(), frozenset({"ZOE"})) and not known_name("A", frozenset({"A"}))

    def broken(_):
        raise RuntimeError

    assert [s.value for s in detect("a@b.fr", mode="ner", ner=broken)] == ["a@b.fr"]
    names = spark.createDataFrame([("first", "zoe")], "kind string, word string")
    df = spark.createDataFrame([(1, "Zoé rit"), (2, "Bob rit"), (3, None)], "k int, text string")
    weak = lambda t: [Span(0, 3, "personne", t[:3], 0.5, "ner", "direct")]
    got = {r.k: [s.value for s in r.spans] for r in T.detect_spans(df, mode="ner", ner=weak, names=names, blacklist=("rit",)).collect()}
    assert got == {1: ["Zoé", "rit"], 2: ["rit"], 3: []}


def test_office_files(spark, tmp_path):
    df = spark.createDataFrame([("Zoé <&>", "a@b.fr"), (None, "2")], "nom string, note string")
    for kind in ("xlsx", "ods"):
        path = str(tmp_path / f"a.{kind}")
        office.save_office(df, path, kind)
        assert [tuple(r) for r in files.load(spark, path).collect()] == [("Zoé <&>", "a@b.fr"), ("", "2")]
        assert files.load(spark, path, header=False).columns == ["col_0", "col_1"] and files.load(spark, path, header=False).count() == 3
    with pytest.raises(ValueError):
        office.save_office(df, str(tmp_path / "b.xlsx"), "xlsx", most=1)
    for kind in ("docx", "odt"):
        path = str(tmp_path / f"a.{kind}")
        office.save_office(spark.createDataFrame([("un\n\ndeux & trois",)], "texte string"), path, kind)
        assert files.load(spark, path).first().asDict() == {"texte": "un\ndeux & trois", "_source": f"a.{kind}"}
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><r><t>ab</t></r><r><t>c</t></r></si></sst>')
    assert list(office.xlsx_rows((tmp_path / "s.xlsx").read_bytes())) == [["abc", "", "5"]]


def test_files_and_dictionaries(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1\t2\n")
    (tmp_path / "a.json").write_text('{"a": 1}')
    assert files.load(spark, str(tmp_path / "a.tsv"), header=False).columns == ["col_0", "col_1"] and files.load(spark, str(tmp_path / "a.json")).count() == 1
    assert [files.detect_format(p) for p in ("/x.y/A.CSV", "a", ".x")] == [".csv", "", ""] and files.output_path("/d/a.pdf") == "/d/a_PSEUDO.txt"
    words = spark.createDataFrame([("x", f"[X_{n}]", v) for n, v in ((2, "b"), (10, "c;\"d"))], "grp string, token string, original string")
    files.save_dictionary(words, str(tmp_path / "d.csv"))
    assert [r.jeton for r in files.dictionary_list(words).collect()] == ["[X_10]", "[X_2]"]
    assert {(r.token, r.original) for r in files.load_dictionary(spark, str(tmp_path / "d.csv")).collect()} == {("[X_2]", "b"), ("[X_10]", 'c;"d')}
    (tmp_path / "e.csv").write_text("type;jeton;valeur_originale\na;[A_1];old\na;;x\na;[A_2];\nb;[A_1];new\n")
    assert [(r.grp, r.token, r.original) for r in files.load_dictionary(spark, str(tmp_path / "e.csv")).collect()] == [("b", "[A_1]", "new")]
    (tmp_path / "t_PSEUDO.txt").write_text("un [A_1]\n\nfin")
    out = files.restore_file(spark, str(tmp_path / "t_PSEUDO.txt"), str(tmp_path / "e.csv"))
    assert out.endswith("t_RESTAURE.txt") and [r[0] for r in spark.read.text(out).collect()] == ["un new", "", "fin"]
    (tmp_path / "w.json").write_text('["Zoe", "zoe ", "Al"]')
    assert {r.word for r in files.load_words(spark, str(tmp_path / "w.json"), upper=True).collect()} == {"ZOE", "AL"}


def test_schema_tools_and_diagnostics(spark):
    df = spark.createDataFrame([("a", "x@y.fr", 1, True, ["l"], "t" * 51, None)], "Firstname string, mail string, code_postal int, ok boolean, l array<string>, texte string, v string")
    draft = schema_tools.generate(df, "f.csv")
    # "firstname" holds "name", which is tried first.
    assert {k: v["type"] for k, v in draft["champs_sensibles"].items()} == {"Firstname": "nom", "mail": "email", "code_postal": "cp"} and draft["texte_libre"] == ["texte"]
    assert schema_tools.generate(df.select(F.lit(1).alias("numero_x")), variant="cli")["champs_sensibles"] == {"numero_x": {"type": "id", "jeton": "ID"}}
    assert schema_tools.validate_mapping({})["valide"] is False and schema_tools.validate_mapping(draft, df) == {"valide": True, "erreurs": [], "avertissements": []}
    assert {r.field: r.type for r in schema_tools.analyze(df).collect()} == {"Firstname": "string", "mail": "string", "code_postal": "number", "ok": "number", "l": "array", "texte": "string", "v": "NoneType"}
    assert diagnose.health({"a": df.select("mail"), "b": df.limit(0)}, spark).collect() == [("a", 1), ("b", 0)]
    assert T.clean(spark.createDataFrame([(1, "[EMAIL_1] ok"), (2, "a@b.fr")], "k int, result string"), "k").collect() == [(1, True, 0), (2, False, 1)]
    red = T.redact(T.detect_spans(df.select(F.lit("mél a@b.fr!").alias("text"))))
    assert red.first().result == "mél ██████!"


def test_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("nom,note\nZ,z@y.fr\nZ,w@y.fr\n")
    (folder / "b.txt").write_text("voir z@y.fr")
    (folder / "c.doc").write_text("x")
    (folder / "d.xls").write_text("x")
    assert cli.main(["--input-dir", str(folder), "--mode", "regex"]) == 1
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [o["report"]["replacements"] for o in out] == [2, 1] and all(o["report"]["tokens"] == o["report"]["replacements"] for o in out)
    assert {r.note for r in spark.read.csv(out[0]["output"], header=True).collect()} == {"[EMAIL_1]", "[EMAIL_2]"} and len({o["dictionary"] for o in out}) == 2
    assert cli.main([str(folder / "a.csv"), "--score-only"]) == 0
    assert json.loads(capsys.readouterr().out)["levels"] == {"NUL": 0, "FAIBLE": 2, "MODÉRÉ": 0, "ÉLEVÉ": 0, "CRITIQUE": 0}
    assert cli.main([str(folder / "a.csv"), "--mapping-generate"]) == 0 and json.loads(capsys.readouterr().out)["champs_sensibles"] == {"nom": {"type": "nom", "jeton": "NOM"}}


def test_tokens_of_a_stream(spark, tmp_path):
    for n, texts in enumerate((["a@x.fr b@x.fr"], ["b@x.fr c@x.fr", "d@x.fr"])):
        spark.createDataFrame([(n * 10 + i, t) for i, t in enumerate(texts)], "k int, text string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema("k int, text string").json(str(tmp_path / "in"))
        run = pseudonymise_batch("k", "text", str(tmp_path / "words"), str(tmp_path / "out"), only=frozenset({"EMAIL"}))
        stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    want = {"a@x.fr": "[EMAIL_1]", "b@x.fr": "[EMAIL_2]", "c@x.fr": "[EMAIL_3]", "d@x.fr": "[EMAIL_4]"}
    assert {r.original: r.token for r in dictionary_at(spark, str(tmp_path / "words")).collect()} == want
    run(spark.createDataFrame([(10, "b@x.fr c@x.fr"), (11, "d@x.fr")], "k int, text string"), 1)
    assert {r.original: r.token for r in dictionary_at(spark, str(tmp_path / "words")).collect()} == want
    assert {r.result for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"[EMAIL_1] [EMAIL_2]", "[EMAIL_2] [EMAIL_3]", "[EMAIL_4]"}


def test_new_values_of_sliced_and_null_lists():
    """Cells as flat columns: slices, null lists and records without replacements keep their places."""
    import pyarrow as pa

    from veilmark.operators.structure import ARROW_CELL, FIELD, TEXT, flat, listed, new_values

    piece = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("repl", pa.string())])
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("ord", pa.int32()), ("elem", pa.int32()), ("written", pa.bool_()), ("pieces", pa.list_(piece))]))
    cells = listed([[(FIELD, 9, -1, "gone", False, True)], [(FIELD, 0, -1, "x", False, True), (TEXT, 1, 0, "abcdef", False, True)], [], [(TEXT, 0, -1, "zz", False, True)]], pa.list_(ARROW_CELL))
    part = lambda a, b, r: {"start": a, "end": b, "repl": r}
    new = pa.array([
        [{"kind": FIELD, "ord": 9, "elem": -1, "written": True, "pieces": [part(None, None, "[X_1]")]}],
        [{"kind": TEXT, "ord": 1, "elem": 0, "written": True, "pieces": [part(1, 2, "[B]"), part(4, 6, "[EF]")]}, {"kind": FIELD, "ord": 0, "elem": -1, "written": True, "pieces": [part(None, None, None)]}],
        None,
        [{"kind": TEXT, "ord": 0, "elem": -1, "written": False, "pieces": [part(0, 2, "[Z]")]}],
    ], kind)
    got = [[(FIELD, 9, -1, "[X_1]")], [(TEXT, 1, 0, "a[B]cd[EF]"), (FIELD, 0, -1, None)], [], []]
    assert new_values(cells, new) == got
    assert new_values(cells.slice(1), new.slice(1)) == got[1:]
    assert flat(pa.array([], pa.list_(ARROW_CELL)))[0] == [0] and listed([], pa.list_(ARROW_CELL)).to_pylist() == []
