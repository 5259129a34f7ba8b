"""Files of any shape in, one ordered file out, a folder in one job."""

import csv
import json
import random

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilmark import cli, scratch
from veilmark.operators import text as T
from veilmark.operators.structure import Mapping, process
from veilmark.operators.tokens import restore
from veilmark.sources import files, jsonfiles, office, single


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()


def some_value(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 6)
    if kind < 4:
        return "".join(rng.choice(["a", "{", "}", "[", "]", '"', "\\", "é", "\n", ",", ":", "😀"]) for _ in range(rng.randrange(12)))
    if kind < 6:
        return rng.choice([1, 1.0, -2.5e10, None, True, 12345678901234567890, ""])
    return [some_value(rng, depth + 1) for _ in range(rng.randrange(4))] if kind == 6 else {str(rng.randrange(30)): some_value(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_json_of_any_shape_is_cut_into_its_records(spark, tmp_path):
    """Arrays, lines, objects one after the other, in splits of 2,000 bytes: every record as it stands, in order."""
    rng = random.Random(3)
    records = [{f"k{rng.randrange(9)}": some_value(rng) for _ in range(rng.randrange(6))} for _ in range(200)]
    dump = lambda x, **o: json.dumps(x, ensure_ascii=False, **o)
    shapes = {
        "array": (dump(records), records), "pretty": ("﻿" + dump(records, indent=2) + "\n", records), "lines": ("\n".join(map(json.dumps, records)), records),
        "objects": ("\n".join(dump(r, indent=1) for r in records), records), "one": (dump(records[0], indent=2), records[:1]), "short": (dump(records[1]), records[1:2]), "none": ("[]", []), "blank": (" \n", []),
    }
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for name, (text, want) in shapes.items():
            (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
            got = jsonfiles.json_records(spark, str(tmp_path / f"{name}.json")).orderBy("rec_idx").collect()
            assert [json.loads(r.record) for r in got] == want, name
        whole = jsonfiles.json_records(spark, str(tmp_path)).groupBy("file").count().collect()
        assert sorted(r["count"] for r in whole) == sorted(len(w) for _, w in shapes.values() if w)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "bad.json").write_text('[1, {"a": 1}]')
    with pytest.raises(Exception, match="not a record"):
        jsonfiles.json_records(spark, str(tmp_path / "bad.json")).collect()


def test_saved_rows_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "a int, b string")
    out = files.save(df, str(tmp_path / "x.json"))
    assert sorted(map(tuple, files.load(spark, out + "/*.json").collect())) == [(i, f"t{i}") for i in range(10)]
    (tmp_path / "l.json").write_text('{"a": 1}\n{"a": 2, "b": "x"}\n{"a": 3}\n')
    assert [tuple(r) for r in files.load(spark, str(tmp_path / "l.json")).collect()] == [(1, None), (2, "x"), (3, None)]


def test_single_files_have_the_bytes_expected(spark, tmp_path):
    rows = [(3, 'a,"b"', None), (1, "é\nz", "x"), (2, " s ", "")]
    df = spark.createDataFrame(rows, "n int, a string, b string").repartition(3)
    single.write_csv(df, ["n"], ["a", "b"], str(tmp_path / "o.csv"))
    want = tmp_path / "w.csv"
    with open(want, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerows([["a", "b"], *[[a, b] for _, a, b in sorted(rows)]])
    assert (tmp_path / "o.csv").read_bytes() == want.read_bytes()
    records = [{"z": 1.0, "a": ["é", {"k": None}], "e": []}, {}, {"t": "x\ny"}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, record string").repartition(2)
    single.write_json(df, ["i"], str(tmp_path / "o.json"))
    assert (tmp_path / "o.json").read_text(encoding="utf-8") == json.dumps(records, ensure_ascii=False, indent=2)
    single.write_json(df.limit(0), ["i"], str(tmp_path / "e.json"))
    assert (tmp_path / "e.json").read_text() == "[]"
    single.write_text(df, ["i"], str(tmp_path / "o.txt"), F.col("i").cast("string"))
    assert (tmp_path / "o.txt").read_text() == "0\n1\n2\n" and not list(tmp_path.glob("*._writing"))


def test_a_folder_in_one_job_with_a_dictionary_for_each_file(spark, tmp_path, capsys):
    at = tmp_path / "in put"
    at.mkdir()
    (at / "a.csv").write_text("nom,note\nZoé,z@y.fr\nAl,w@y.fr\n", encoding="utf-8")
    (at / "b.csv").write_text('note,nom\n"x, z@y.fr",Zoé\n', encoding="utf-8")
    ragged = [{"note": "z@y.fr", "n": 1, "nom": "B"}, {"n": "1", "note": None}, {"x": {"y": 1.0}, "note": "v@y.fr, z@y.fr"}]
    (at / "c.json").write_text(json.dumps(ragged), encoding="utf-8")
    (at / "d.json").write_text('{"note": "q@y.fr"}\n{"note": "z@y.fr"}\n')
    (at / "e.md").write_text("voir z@y.fr\nfin")
    office.save_office(spark.createDataFrame([("k@y.fr", "1"), ("z@y.fr", "2")], "note string, n string"), str(at / "f.xlsx"), "xlsx")
    (at / "g.ods").write_text("no sheet")
    (at / "h.doc").write_text("x")
    assert cli.main(["--input-dir", str(at), "--mode", "regex"]) == 1
    said = capsys.readouterr()
    out = {json.loads(x)["file"].rsplit("/", 1)[-1]: json.loads(x) for x in said.out.splitlines()}
    assert sorted(out) == ["a.csv", "b.csv", "c.json", "d.json", "e.md", "f.xlsx"] and "g.ods: " in said.err and "h.doc" not in said.err
    read = lambda name: (at / name).read_text(encoding="utf-8")
    assert (at / "a_PSEUDO.csv").read_bytes().decode() == "nom,note\r\nZoé,[EMAIL_1]\r\nAl,[EMAIL_2]\r\n"
    assert (at / "b_PSEUDO.csv").read_bytes().decode() == 'note,nom\r\n"x, [EMAIL_1]",Zoé\r\n'
    want = [{"note": "[EMAIL_1]", "n": 1, "nom": "B"}, {"n": "1", "note": None}, {"x": {"y": 1.0}, "note": "[EMAIL_2], [EMAIL_1]"}]
    assert read("c_PSEUDO.json") == json.dumps(want, ensure_ascii=False, indent=2)
    assert json.loads(read("d_PSEUDO.json")) == [{"note": "[EMAIL_1]"}, {"note": "[EMAIL_2]"}]
    assert read("e_PSEUDO.md") == "voir [EMAIL_1]\nfin\n"
    assert [tuple(r) for r in files.load(spark, str(at / "f_PSEUDO.xlsx")).collect()] == [("[EMAIL_1]", "1"), ("[EMAIL_2]", "2")]
    assert (at / "c_correspondances.csv").read_bytes().decode() == "type;jeton;valeur_originale\r\nemail_txt;[EMAIL_1];z@y.fr\r\nemail_txt;[EMAIL_2];v@y.fr\r\n"
    assert [out[n]["report"]["replacements"] for n in sorted(out)] == [2, 1, 3, 2, 1, 2] and out["c.json"]["report"]["by_type"] == {"email_txt": 3}
    # And back: bytes of the text, values of the records.
    assert read(files.restore_file(spark, str(at / "e_PSEUDO.md"), str(at / "e_correspondances.csv")).rsplit("/", 1)[-1]) == "voir z@y.fr\nfin\n"
    assert json.loads(read(files.restore_file(spark, str(at / "c_PSEUDO.json"), str(at / "c_correspondances.csv")).rsplit("/", 1)[-1])) == ragged


def test_records_in_json_files_with_a_text_within(spark, tmp_path, capsys):
    inner = {"Report": {"Firstname": "Marie", "Email": "marie@test.fr", "Question": "Bonjour, a@b.fr"}}
    (tmp_path / "r.json").write_text(json.dumps([{"ID": 123, "S": json.dumps(inner), "nom": "D"}, {"ID": 7, "S": "{broken", "nom": ""}]))
    m = {"structure": {"unwrap": {"field": "S"}}, "champs_sensibles": {"Report.Firstname": {"type": "prenom", "jeton": "PRENOM"}, "Report.Email": {"type": "email", "jeton": "EMAIL"}, "nom": {"type": "nom", "jeton": "NOM"}}, "texte_libre": ["Report.Question"], "lookup_noms": {"prenom": "Report.Firstname"}}
    (tmp_path / "m.txt").write_text(json.dumps(m))
    assert cli.main([str(tmp_path / "r.json"), "--mapping", str(tmp_path / "m.txt"), "--mode", "regex"]) == 0
    full, broken = json.loads((tmp_path / "r_PSEUDO.json").read_text())
    assert json.loads(full["S"]) == {"Report": {"Firstname": "[PRENOM_1]", "Email": "[EMAIL_1]", "Question": "Bonjour, [EMAIL_1]"}} and full["nom"] == "[NOM_1]"
    assert list(full) == ["ID", "S", "nom"] and broken == {"ID": 7, "S": "{broken", "nom": ""}
    capsys.readouterr()
    assert cli.main([str(tmp_path / "r.json"), "--dry-run"]) == 0 and not list(tmp_path.glob("*._*"))
    assert json.loads(capsys.readouterr().out)["report"]["records"] == 2


def test_unwrapped_records_whose_paths_are_all_inside(spark):
    inner = json.dumps({"Report": {"Firstname": "Marie", "Question": "écrire à a@b.fr"}}, ensure_ascii=False)
    df = spark.createDataFrame([(1, inner, "x"), (2, None, "y"), (3, "{", "z")], "k int, S string, o string")
    m = Mapping.from_dict({"structure": {"unwrap": {"field": "S"}}, "champs_sensibles": {"Report.Firstname": {"type": "prenom", "jeton": "P"}}, "texte_libre": ["Report.Question"]})
    rows = process(df, "k", m).rows
    want = '{"Report": {"Firstname": "[P_1]", "Question": "écrire à [EMAIL_1]"}}'
    assert {r.k: r.S for r in rows.collect()} == {1: want, 2: None, 3: "{"}
    assert rows.select("k").filter("k > 1").count() == 2 and rows.limit(1).count() == 1 and rows.filter("S like '%[P_1]%' and o = 'x' and score > 0").count() == 1 and rows.groupBy("S").count().count() == 3


def test_maps_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, {"a": "A", "b": "a@b.fr"}, {"n": 5, "m": 6}, ([("t", "c@d.fr")],), "e", 1.5, "x")], "k int, m map<string,string>, n map<string,int>, s struct<l:array<struct<u:string,v:string>>>, error string, score double, result string")
    m = Mapping.from_dict({"champs_sensibles": {"m.a": {"type": "nom", "jeton": "N"}, "n.n": {"type": "id", "jeton": "I"}, "m.gone": {"type": "nom", "jeton": "N"}}, "texte_libre": ["m.b", "s.l[].v", "error"]})
    done = process(df, "k", m)
    r = done.rows.first()
    assert r.m == {"a": "[N_1]", "b": "[EMAIL_1]"} and r.n == {"n": "[I_1]", "m": "6"} and r.s.l[0].v == "[EMAIL_2]" and (r.error, r.score, r.risk_score, r.level) == ("e", 1.5, 10, "MODÉRÉ")
    assert done.scored.columns == ["score", "level", "error"] and done.scored.first().score == 10
    text = T.detect_spans(df.select("k", F.lit("a@b.fr").alias("text"), "result"), only=frozenset({"EMAIL"}))
    out, words = T.pseudonymise(text, "k")
    back = restore(out.withColumn("restored", F.lit(0)), words)
    assert out.columns == ["k", "text", "spans", "result"] and out.first().result == "[EMAIL_1]"
    assert back.columns == ["k", "text", "spans", "result", "restored", "n_restored"] and back.first().restored == "a@b.fr"


def test_tokens_of_any_form_come_back(spark):
    rng = random.Random(4)
    for prefix in ("PRÉNOM client", "numéro client", "a[b]c", "x\ny", "É_1"):
        words = spark.createDataFrame([("t", i, f"[{prefix}_{i}]", f"v{i} [x]") for i in range(1, 120)], "grp string, num long, token string, original string")
        rows = []
        for k in range(30):
            ids = [rng.randrange(1, 140) for _ in range(rng.randrange(6))]
            rows.append((k, "".join(rng.choice(["[", " ", "]", "[[", "_1]"]) + f"[{prefix}_{i}]" for i in ids), "".join("" for _ in ids), ids))
        df = spark.createDataFrame([(k, t) for k, t, *_ in rows], "k int, result string")
        for r in restore(df, words).collect():
            want, known = r.result, set()
            for i in range(140, 0, -1):
                if i < 120 and f"[{prefix}_{i}]" in want:
                    known.add(i)
            for i in known:
                want = want.replace(f"[{prefix}_{i}]", f"\x00{i}\x00")
            for i in known:
                want = want.replace(f"\x00{i}\x00", f"v{i} [x]")
            assert (r.restored, r.n_restored) == (want, len(known))
    plain = spark.createDataFrame([("t", 1, "PERSON-1", "Al"), ("t", 2, "PERSON-12", "Bo"), ("u", 1, "<<PERSON-1>>", "see PERSON-12")], "grp string, num long, token string, original string")
    df = spark.createDataFrame([(1, "PERSON-12, PERSON-1. <<PERSON-1>>")], "k int, result string")
    assert restore(df, plain).first().restored == "Bo, Al. see PERSON-12" and restore(df, plain, nested=True).first().restored == "Bo, Al. see Bo"
    assert restore(df, plain.limit(0)).first().restored == "PERSON-12, PERSON-1. <<PERSON-1>>" and restore(df.limit(0), plain).count() == 0


def test_tables_kept_inside_are_dropped(spark, tmp_path):
    before = scratch.keep(spark.range(3), "outside")
    with scratch.with_tables(spark):
        inside = scratch.keep(spark.range(5), "inside")
        (at,) = {f.rsplit("/", 1)[0] for f in inside.inputFiles()}
        assert inside.count() == 5
        inside.write.parquet(str(tmp_path / "result"))
    assert jsonfiles.files_at(spark, at) == [] and before.count() == 3 and spark.read.parquet(str(tmp_path / "result")).count() == 5
