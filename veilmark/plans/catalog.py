"""Queries over the driver's tables and over literal texts, with their SQL where SQL can express them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from veilmark.functions import detectors as D
from veilmark.functions.schema_tools import analyze, generate, validate_mapping
from veilmark.operators import diagnose, report
from veilmark.operators import text as T
from veilmark.operators.fusion import fuse_tables
from veilmark.operators.model import Model
from veilmark.operators.structure import Mapping, process
from veilmark.operators.tokens import person_key, restore
from veilmark.plans import literals as L
from veilmark.scratch import folder
from veilmark.sources.files import dictionary_list, first_rows
from veilmark.sources.jsonfiles import json_records
from veilmark.sources.single import write_json

#: Fixed values, in the dialect of the oracle.
EMAIL = r"[a-zA-Z0-9_.+\-]+@[a-zA-Z0-9\-]+\.[a-zA-Z0-9\-.]+"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
URL = r"\bhttps?://\S+|\bwww\.\S+"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def some(spark, sf_dir, *names, **more):
    return T.detect_spans(docs(spark, sf_dir).select("doc_id", "lang", "text"), only=frozenset(names), **more)


def flagship(spark, sf_dir):
    found = T.detect_spans(docs(spark, sf_dir).select("doc_id", "text"), fort=True, tech=True)
    out, _ = T.pseudonymise(T.with_risk(found), "doc_id")
    return out.select("doc_id", "result", "score", "level")


def email_spans(spark, sf_dir):
    return T.explode_spans(some(spark, sf_dir, "EMAIL"), "doc_id").select("doc_id", "span_ord", "value")


def email_jvm(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(EMAIL), 0)).alias("value"))


def ipv4_counts(spark, sf_dir):
    return some(spark, sf_dir, "IPV4", tech=True).select("doc_id", F.size("spans").cast("bigint").alias("n")).filter("n > 0")


def url_pages(spark, sf_dir):
    """Addresses in raw pages."""
    found = diagnose.extract(table(spark, sf_dir, "pages"), "page_id", "html", only=frozenset({"URL"}))
    return found.select("page_id", "text", "type", "risk_type")


def anon_email(spark, sf_dir):
    return T.anonymise(some(spark, sf_dir, "EMAIL")).select("doc_id", "result")


def redact_email(spark, sf_dir):
    return T.redact(some(spark, sf_dir, "EMAIL")).select("doc_id", "result")


def risk_score(spark, sf_dir):
    return T.with_risk(some(spark, sf_dir, "EMAIL")).select("doc_id", "score", "level", "n_direct")


def risk_levels(spark, sf_dir):
    return report.level_distribution(T.with_risk(some(spark, sf_dir, "EMAIL")))


def file_score(spark, sf_dir):
    return report.file_score(T.with_risk(some(spark, sf_dir, "EMAIL", "IPV4", tech=True))).select("records", "errors", "score", F.round("mean", 6).alias("mean"), "level")


def risk_details(spark, sf_dir):
    return report.details(T.explode_spans(some(spark, sf_dir, "EMAIL", "IPV4", tech=True), "doc_id"))


def type_counts(spark, sf_dir):
    return report.type_counts(T.explode_spans(some(spark, sf_dir, "EMAIL", "IPV4", tech=True), "doc_id"))


def distinct_values(spark, sf_dir):
    return report.distinct_values(T.explode_spans(some(spark, sf_dir, "EMAIL"), "doc_id"))


def email_dictionary(spark, sf_dir):
    return T.token_dictionary(T.explode_spans(some(spark, sf_dir, "EMAIL"), "doc_id"), "doc_id").select("norm", "original", "num", "token")


def pseudo_email(spark, sf_dir):
    return T.pseudonymise(some(spark, sf_dir, "EMAIL"), "doc_id")[0].select("doc_id", "result")


def dictionary_export(spark, sf_dir):
    return dictionary_list(T.token_dictionary(T.explode_spans(some(spark, sf_dir, "EMAIL", "IPV4", tech=True), "doc_id"), "doc_id"))


def restore_roundtrip(spark, sf_dir):
    out, words = T.pseudonymise(some(spark, sf_dir, "EMAIL", "IPV4", tech=True), "doc_id", numbering="exact")
    return T.restore(out, words).select("doc_id", "restored", "n_restored")


def restore_shared(spark, sf_dir):
    """Of several rows of one token the last counts; unknown tokens and null stay."""
    words = spark.createDataFrame([("email", 1, "[EMAIL_1]", "a@x.fr"), ("email_txt", 1, "[EMAIL_1]", "b@x.fr"), ("personne", 1, "[PERSONNE_1]", "A"), ("personne", 10, "[PERSONNE_10]", "B")], "grp string, num long, token string, original string")
    rows = spark.createDataFrame([(1, "x [EMAIL_1] y"), (2, "[PERSONNE_1] et [PERSONNE_10], [PERSONNE_1]"), (3, None), (4, "[AUTRE_1] [x]"), (5, "")], "id long, result string")
    return restore(rows, words).select("id", "restored", "n_restored")


def whitelist(spark, sf_dir):
    return T.explode_spans(some(spark, sf_dir, "IPV4", tech=True, whitelist=("10.0.0.1", "THWHHE.68@mail2.example.com")).unionByName(some(spark, sf_dir, "EMAIL", whitelist=("THWHHE.68@mail2.example.com",))), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


def blacklist(spark, sf_dir):
    return some(spark, sf_dir, "NONE", blacklist=("licensed",)).select("doc_id", F.size("spans").cast("bigint").alias("n")).filter("n > 0")


def samples(spark, sf_dir):
    return report.samples(T.explode_spans(some(spark, sf_dir, "EMAIL"), "doc_id"), "doc_id", "start")


def leaks(spark, sf_dir):
    return T.validate(T.anonymise(T.detect_spans(docs(spark, sf_dir).select("doc_id", "text"), fort=True, tech=True)), "doc_id").groupBy("entity_type").agg(F.count("*").alias("n"))


def score_by_quality(spark, sf_dir):
    scored = T.with_risk(some(spark, sf_dir, "EMAIL")).select("doc_id", "score")
    return scored.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality").agg(F.sum("score").cast("bigint").alias("score"))


def fused_spans(spark, sf_dir):
    """Rules' spans and those of a model that ran elsewhere (here: what stands before each @): the model wins where both lie."""
    rules = T.explode_spans(some(spark, sf_dir, "EMAIL", "IPV4", tech=True), "doc_id")
    name = F.substring_index("value", "@", 1)
    model = rules.filter("entity_type = 'email_txt'").select("doc_id", "start", (F.col("start") + F.length(name)).alias("end"), F.lit("personne").alias("entity_type"), name.alias("value"), F.lit(0.9).alias("score"), F.lit("ner").alias("source"), F.lit("direct").alias("risk_type"))
    return fuse_tables(rules, model, "doc_id").select("doc_id", "entity_type", "value", "source")


# --- records


def structured_tokens(spark, sf_dir):
    """Names and segments of customers; a repeated value keeps its token."""
    m = Mapping.from_dict({"champs_sensibles": {"c_name": {"type": "nom", "jeton": "NOM"}, "c_mktsegment": {"type": "genre", "jeton": "SEGMENT"}}})
    return process(table(spark, sf_dir, "customer"), "c_custkey", m).rows.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", "score", "level")


def structured_dictionary(spark, sf_dir):
    m = Mapping.from_dict({"champs_sensibles": {"c_name": {"type": "nom", "jeton": "NOM"}, "c_mktsegment": {"type": "genre", "jeton": "SEGMENT"}}})
    return process(table(spark, sf_dir, "customer"), "c_custkey", m).tokens.select("grp", "norm", "original", "num", "token")


def structured_anon(spark, sf_dir):
    m = Mapping.from_dict({"champs_sensibles": {"s_name": {"type": "nom", "jeton": "NOM"}, "s_nationkey": {"type": "id", "jeton": "ID"}, "s_acctbal": {"type": "tel", "jeton": "TEL"}}})
    return process(table(spark, sf_dir, "supplier"), "s_suppkey", m, "anon").rows.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal", "score")


def reports(spark, sf_dir):
    """Events with a JSON text that holds a person's number and a message."""
    inner = F.to_json(F.struct(F.struct(F.col("user_id").alias("Id"), F.concat(F.lit("mail u"), "user_id", F.lit("@example.com")).alias("Note"), F.lit("é").alias("Rest")).alias("Report")))
    return table(spark, sf_dir, "events").select("event_id", "event_type", inner.alias("body"))


UNWRAP = {"structure": {"unwrap": {"field": "body"}}, "champs_sensibles": {"Report.Id": {"type": "id", "jeton": "ID"}}, "texte_libre": ["Report.Note", "event_type"]}


def unwrap_props(spark, sf_dir):
    return process(reports(spark, sf_dir), "event_id", Mapping.from_dict(UNWRAP), only=frozenset({"EMAIL"})).rows.select("event_id", "body", "event_type", "score")


def nested_arrays(spark, sf_dir):
    """Structs and an array of them: the names looked up are hidden in the free text of their own record."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.concat(F.lit("Prenom"), "c_custkey").alias("First"), F.array(F.struct(F.concat(F.lit("voir prenom"), "c_custkey", F.lit(" a@b.fr")).alias("Value")), F.struct(F.lit(None).cast("string").alias("Value"))).alias("Details")).alias("Report"))
    m = Mapping.from_dict({"texte_libre": ["Report.Details[].Value"], "lookup_noms": {"prenom": "Report.First"}})
    out = process(df, "c_custkey", m, "anon", only=frozenset({"EMAIL"})).rows
    return out.select("c_custkey", F.col("Report.First").alias("first"), F.get("Report.Details", F.lit(0))["Value"].alias("v0"), F.get("Report.Details", F.lit(1))["Value"].alias("v1"), "score")


def scan_strings(spark, sf_dir):
    """No mapping: all string columns of pages."""
    df = table(spark, sf_dir, "pages")
    return process(df, "page_id", Mapping.all_strings(df), "anon", only=frozenset({"EMAIL"})).rows.select("page_id", "url", "html", "score")


def run_report(spark, sf_dir):
    df = table(spark, sf_dir, "pages")
    done = process(df, "page_id", Mapping.all_strings(df), only=frozenset({"EMAIL"}))
    return report.report(done.rows, done.occurrences, done.tokens).select("records", "errors", "score", "replacements", "tokens", F.to_json("by_type").alias("by_type"))


def limit_dry_run(spark, sf_dir):
    df = first_rows(table(spark, sf_dir, "customer"), 100, "c_custkey")
    return process(df, "c_custkey", Mapping.from_dict({"champs_sensibles": {"c_name": {"type": "nom", "jeton": "NOM"}}})).rows.select("c_custkey", "c_name", "score")


def mapping_draft(spark, sf_dir):
    draft = generate(table(spark, sf_dir, "customer"), "customer")
    return spark.createDataFrame([(k, v["type"], v["jeton"]) for k, v in draft["champs_sensibles"].items()], "field string, type string, jeton string")


def mapping_check(spark, sf_dir):
    checked = validate_mapping({"champs_sensibles": {"c_name": {"type": "nom"}, "c_gone": {"type": "x", "jeton": "X"}}}, table(spark, sf_dir, "customer"))
    return spark.createDataFrame([(checked["valide"], len(checked["erreurs"]), len(checked["avertissements"]))], "valid boolean, errors long, warnings long")


def described(spark, sf_dir):
    return analyze(table(spark, sf_dir, "customer")).select("field", "type", "records")


def unwrap_inner(spark, sf_dir):
    """All paths of the mapping lie in the JSON text."""
    m = Mapping.from_dict({**UNWRAP, "texte_libre": ["Report.Note"]})
    out = process(reports(spark, sf_dir), "event_id", m, only=frozenset({"EMAIL"})).rows
    return out.filter("body like '%EMAIL%' and event_type <> ''").select("event_id", "body", "score")


def map_fields(spark, sf_dir):
    """Fields and texts below maps; a number beside them becomes text."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.create_map(F.lit("n"), F.col("c_nationkey"), F.lit("k"), F.lit(7)).alias("m"), F.create_map(F.lit("note"), F.concat(F.lit("à u"), "c_custkey", F.lit("@x.fr"))).alias("t"))
    m = Mapping.from_dict({"champs_sensibles": {"m.n": {"type": "nom", "jeton": "N"}}, "texte_libre": ["t.note", "t.gone"]})
    out = process(df, "c_custkey", m, "anon", only=frozenset({"EMAIL"})).rows
    return out.select("c_custkey", F.col("m.n").alias("n"), F.col("m.k").alias("k"), F.col("t.note").alias("note"), "score")


def clashing_columns(spark, sf_dir):
    """Records with columns named as the risk is keep them."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("error"), F.col("c_acctbal").alias("score"))
    out = process(df, "c_custkey", Mapping.from_dict({"champs_sensibles": {"error": {"type": "nom", "jeton": "E"}}})).rows
    return out.select("c_custkey", "error", "score", "risk_score", "level", F.col("risk_error").isNull().alias("good"))


def file_tokens(spark, sf_dir):
    """Each source as a file of its own: equal values have a number in each."""
    df = docs(spark, sf_dir).select("doc_id", "source", F.col("text").alias("t"))
    done = process(df, "doc_id", Mapping(texts=("t",)), per="source", only=frozenset({"EMAIL"}))
    return done.tokens.select(F.col(done.place).alias("source"), "norm", "original", "num", "token")


def file_reports(spark, sf_dir):
    df = docs(spark, sf_dir).select("doc_id", "source", F.col("text").alias("t"))
    done = process(df, "doc_id", Mapping(texts=("t",)), per="source", only=frozenset({"EMAIL"}))
    return report.by_file(done).select("source", "records", "errors", "score", "level", "replacements", "tokens")


def restore_any(spark, sf_dir):
    """Tokens whose prefix has an accent, a blank and small letters."""
    m = Mapping.from_dict({"champs_sensibles": {"c_name": {"type": "nom", "jeton": "PRÉNOM du client"}}})
    done = process(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", m)
    text = done.rows.select("c_custkey", F.concat(F.lit("voir ["), "c_name", F.lit("] ou "), "c_name").alias("result"))
    return restore(text, done.tokens).select("c_custkey", "restored", "n_restored")


def restore_nested(spark, sf_dir):
    """A token's original that holds a shorter token."""
    words = table(spark, sf_dir, "nation").select(F.lit("x").alias("grp"), F.col("n_nationkey").cast("long").alias("num"), F.concat(F.lit("[N_"), "n_nationkey", F.lit("]")).alias("token"), F.col("n_name").alias("original"))
    more = table(spark, sf_dir, "nation").select(F.lit("y"), F.col("n_nationkey").cast("long"), F.concat(F.lit("[LONG_"), "n_nationkey", F.lit("]")), F.concat(F.lit("<[N_"), "n_nationkey", F.lit("]>")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("[LONG_"), "c_nationkey", F.lit("]")).alias("result"))
    return restore(rows, words.union(more), nested=True).select("c_custkey", "restored", "n_restored")


DENIED = ("permission", "copyright", "Licensed", "warranty", "liability", "Software", "notice", "conditions", "distribution", "merchantability", "express", "implied")


def deny_list(spark, sf_dir):
    """More entries than are looked for one by one."""
    return some(spark, sf_dir, "NONE", blacklist=DENIED).select("doc_id", F.size("spans").cast("bigint").alias("n")).filter("n > 0")


#: Detectors without validators or looks behind, which the oracle's regular expressions can say.
PLAIN = ("CVV", "MAILTO", "EMAIL_AVEC", "EMAIL_ESPACE", "EMAIL", "TEL_PREFIXE", "URL", "VOIE_NUM", "VOIE_SANS", "GPS", "PLAQUE", "IPV4", "IPV6", "MAC", "JWT", "API_KEY")


def detector_counts(spark, sf_dir):
    """Each plain detector over all documents: one pass."""
    df = docs(spark, sf_dir).select("text")
    for name in PLAIN:
        df = T.detect_spans(df, out_col=name, only=frozenset({name}), fort=True, tech=True)
    sums = df.agg(*[F.coalesce(F.sum(F.size(n)), F.lit(0)).cast("bigint").alias(n) for n in PLAIN])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("detector"), F.col(n).alias("n")) for n in PLAIN])).alias("x")).select("x.*")


def json_array(spark, sf_dir):
    """Records written as one array and read again, cut at their braces by many tasks."""
    at = f"{folder(spark, 'json')}/customers.json"
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct("c_name", F.struct("c_acctbal", "c_nationkey").alias("in"), F.lit('}"{').alias("odd"))).alias("record"))
    write_json(rows, ["c_custkey"], at)
    read = json_records(spark, at).select(F.from_json("record", "c_name string, in struct<c_acctbal:double,c_nationkey:int>, odd string").alias("r"))
    return read.select("r.c_name", "r.in.c_acctbal", "r.in.c_nationkey", "r.odd")


def json_process(spark, sf_dir):
    """Records as JSON text: keys, order and types of each stay, and a text within a text is rewritten in its place."""
    body = F.to_json(F.struct(F.struct(F.col("user_id").alias("Id")).alias("Report")))
    rows = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", body.alias("body"), F.concat(F.lit("u"), "user_id", F.lit("@example.com")).alias("mail"))).alias("record"))
    m = Mapping.from_dict({"structure": {"unwrap": {"field": "body"}}, "champs_sensibles": {"Report.Id": {"type": "uid", "jeton": "ID"}}, "texte_libre": ["mail"]})
    return process(rows, "event_id", m.within("record"), "anon", only=frozenset({"EMAIL"})).rows.select("event_id", "record", "score")


# --- diagnostics


def stub():
    """A model that knows two names."""
    return lambda text, labels: [(label, i, i + len(w), w, c) for label, w, c in (("personne", "Jean", 0.9), ("lieu", "Paris", 0.8), ("personne", "Xyz", 0.5), ("date", "hier", 0.3)) for i in [text.find(w)] if i >= 0]


TALKS = [(1, "Jean vit à Paris, écrire à jean@x.fr"), (2, "Jean Xyz vit à Paris depuis hier"), (3, "tel 01 23 45 67 89"), (4, None), (5, "")]


def talks(spark):
    return spark.createDataFrame(TALKS, "id long, text string")


def compare_ways(spark, sf_dir):
    out = diagnose.compare(talks(spark), "id", ner=Model(stub), tech=True)
    return diagnose.recommended(out).select("id", "rendu_regex", "rendu_ner", "rendu_hybrid", F.array_join("ner_adds", "|").alias("ner_adds"), F.array_join("regex_adds", "|").alias("regex_adds"), "advice")


def model_names(spark, sf_dir):
    """Doubtful persons stay only if a list of names has a word of theirs."""
    names = spark.createDataFrame([("first", "Xyz"), ("family", "Durand")], "kind string, word string")
    found = T.detect_spans(talks(spark), mode="ner", ner=Model(stub), names=names)
    return found.select("id", F.array_join(F.transform("spans", lambda s: F.concat(s["entity_type"], F.lit(":"), s["value"])), "|").alias("found"))


def entity_types(spark, sf_dir):
    return diagnose.entity_types(spark)


def person_keys(spark, sf_dir):
    return spark.createDataFrame([(i, v) for i, (v, _) in enumerate(L.PERSONS)], "id long, value string").select("id", person_key(F.col("value")).alias("norm"))


def contexts(spark, sf_dir):
    f = F.udf(D.negative_context, "boolean")
    return spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(L.CONTEXTS)], "id long, text string, at int, n int").select("id", f("text", "at", "n").alias("negative"))


def luhn_literals(spark, sf_dir):
    """All validators."""
    f = F.udf(lambda name, v: getattr(D, name)(v), "boolean")
    return spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(L.VALIDATORS)], "id long, name string, s string").select("name", "s", f("name", "s").alias("good"))


def mixed_literals(spark, sf_dir):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(L.MIXED)], "id long, text string")
    return T.explode_spans(T.detect_spans(df, fort=True, tech=True), "id").select("id", "entity_type", F.col("start").cast("bigint").alias("start"), "value")


def detector_query(name):
    def run(spark, sf_dir):
        df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(L.CASES[name])], "id long, text string")
        found = T.detect_spans(df, fort=True, tech=True, only=frozenset({name}))
        return T.explode_spans(found, "id").select("id", F.col("span_ord").cast("bigint").alias("span_ord"), "entity_type", "value", "risk_type")

    return run


QUERIES = {
    f.__name__: f
    for f in (
        email_spans, email_jvm, ipv4_counts, url_pages, anon_email, redact_email, risk_score, risk_levels, file_score, risk_details, type_counts, distinct_values, email_dictionary, pseudo_email,
        dictionary_export, restore_roundtrip, restore_shared, whitelist, blacklist, samples, leaks, unwrap_props, structured_tokens, structured_dictionary, structured_anon, nested_arrays, scan_strings,
        run_report, limit_dry_run, mapping_draft, mapping_check, described, compare_ways, model_names, entity_types, person_keys, contexts, luhn_literals, mixed_literals, score_by_quality, flagship,
        fused_spans, unwrap_inner, map_fields, clashing_columns, file_tokens, file_reports, restore_any, restore_nested, deny_list, detector_counts, json_array, json_process,
    )
} | {f"detector_{name.lower()}": detector_query(name) for name in L.CASES}

_N = f"len(regexp_extract_all(text, '{EMAIL}'))"
_N4 = f"len(regexp_extract_all(text, '{IPV4}'))"
_ALL = f"select doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) as value, generate_subscripts(regexp_extract_all(text, '{EMAIL}'), 1) as k from documents"
_ALL4 = f"select doc_id, unnest(regexp_extract_all(text, '{IPV4}')) as value, generate_subscripts(regexp_extract_all(text, '{IPV4}'), 1) as k from documents"
_LEVEL = "case when score = 0 then 'NUL' when score < 10 then 'FAIBLE' when score < 50 then 'MODÉRÉ' when score < 100 then 'ÉLEVÉ' else 'CRITIQUE' end"
_SCORED = f"select doc_id, cast(3 * {_N} as bigint) as score from documents"
_NUMBERED = "select norm, original, row_number() over (order by p) as num from (select lower(trim(value)) as norm, min_by(value, doc_id * 100000 + k) as original, min(doc_id * 100000 + k) as p from ({}) group by 1)"
_ONE_PAGE = f"select page_id, regexp_replace(url, '{EMAIL}', '***', 'g') as url, regexp_replace(html, '{EMAIL}', '***', 'g') as html, cast(3 * (len(regexp_extract_all(url, '{EMAIL}')) + len(regexp_extract_all(html, '{EMAIL}'))) as bigint) as score from pages"
#: Texts cut at their addresses: the part before each, and the address, null after the last part.
_PARTS = f"select doc_id, i, list_extract(g, i) as gap, list_extract(v, i) as value from (select doc_id, g, v, unnest(range(1, len(g) + 1)) as i from (select doc_id, regexp_split_to_array(text, '{EMAIL}') as g, regexp_extract_all(text, '{EMAIL}') as v from documents))"
_SEGMENTS = "select c_mktsegment as s, row_number() over (order by min(c_custkey)) as n from customer group by 1"
_USERS = "select user_id, row_number() over (order by min(event_id)) as n from events where user_id <> 0 group by 1"
_NOTES = "select user_id, row_number() over (order by min(event_id)) as n from events group by 1"


def sql(v):
    """A literal of the oracle."""
    return "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def values(rows, columns, types):
    """A query of rows written out; types keep their kind when there are none."""
    body = " union all ".join("select " + ", ".join(f"cast({sql(v)} as {t}) as {c}" for v, c, t in zip(r, columns, types, strict=True)) for r in rows)
    return body or "select " + ", ".join(f"cast(null as {t}) as {c}" for c, t in zip(columns, types, strict=True)) + " where false"


def detector_oracle(name):
    d = next(d for d in D.DETECTORS if d.name == name)
    rows = [(i, k, d.entity_type, v, d.risk) for i, (_, found) in enumerate(L.CASES[name]) for k, v in enumerate(found)]
    return values(rows, ("id", "span_ord", "entity_type", "value", "risk_type"), ("bigint", "bigint", "varchar", "varchar", "varchar"))


def plain_pattern(d) -> str:
    """A detector's pattern in the oracle's dialect: no groups that pass over runs, no possessive repeats."""
    text = re.sub(r"\|[^|]*\(\?P<skip>.*$", "", d.pattern)
    text = re.sub(r"([+*?}])\+", r"\1", text).replace("\\'", "'").replace("'", "''")
    return ("(?i)" if d.flags else "") + text


ORACLE_SQL = {
    "email_spans": f"select doc_id, cast(k - 1 as int) as span_ord, value from ({_ALL})",
    "email_jvm": f"select doc_id, value from ({_ALL})",
    "ipv4_counts": f"select * from (select doc_id, cast({_N4} as bigint) as n from documents) where n > 0",
    "url_pages": f"select page_id, unnest(regexp_extract_all(html, '{URL}')) as text, 'url_txt' as type, 'indirect' as risk_type from pages",
    "anon_email": f"select doc_id, regexp_replace(text, '{EMAIL}', '***', 'g') as result from documents",
    "risk_score": f"select doc_id, score, {_LEVEL} as level, cast(score // 3 as bigint) as n_direct from ({_SCORED})",
    "risk_levels": f"select level, cast(count(score) as bigint) as n from (values ('NUL'), ('FAIBLE'), ('MODÉRÉ'), ('ÉLEVÉ'), ('CRITIQUE')) l(level) left join (select score, {_LEVEL} as level from ({_SCORED})) using (level) group by 1",
    "file_score": f"select records, cast(0 as bigint) as errors, score, round(score / records, 6) as mean, {_LEVEL} as level from (select count(*) as records, cast(sum(3 * {_N} + 2 * {_N4}) as bigint) as score from documents)",
    "risk_details": f"select cast(sum({_N}) as bigint) as direct, cast(0 as bigint) as finance, cast(sum({_N4}) as bigint) as tech, cast(0 as bigint) as indirect from documents",
    "type_counts": f"select entity_type, count(*) as n from (select 'email_txt' as entity_type from ({_ALL}) union all select 'ipv4_txt' from ({_ALL4})) group by rollup (entity_type)",
    "distinct_values": f"select distinct 'email_txt' as entity_type, value from ({_ALL})",
    "email_dictionary": f"select norm, original, num, '[EMAIL_' || num || ']' as token from ({_NUMBERED.format(_ALL)})",
    "dictionary_export": f"select 'email_txt' as type, '[EMAIL_' || num || ']' as jeton, original as valeur from ({_NUMBERED.format(_ALL)}) union all select 'ipv4_txt', '[IPV4_' || num || ']', original from ({_NUMBERED.format(_ALL4)})",
    "pseudo_email": f"select doc_id, string_agg(gap || coalesce('[EMAIL_' || num || ']', ''), '' order by i) as result from ({_PARTS}) left join ({_NUMBERED.format(_ALL)}) on norm = lower(trim(value)) group by 1",
    "redact_email": f"select doc_id, string_agg(gap || coalesce(repeat('█', length(value)), ''), '' order by i) as result from ({_PARTS}) group by 1",
    "restore_roundtrip": f"select doc_id, text as restored, cast(len(list_distinct(regexp_extract_all(text, '{EMAIL}'))) + len(list_distinct(regexp_extract_all(text, '{IPV4}'))) as bigint) as n_restored from documents",
    "restore_shared": values([(1, "x b@x.fr y", 1), (2, "A et B, A", 2), (3, None, 0), (4, "[AUTRE_1] [x]", 0), (5, "", 0)], ("id", "restored", "n_restored"), ("bigint", "varchar", "bigint")),
    "whitelist": f"select doc_id, count(*) as n from (select doc_id, value from ({_ALL}) where upper(value) <> 'THWHHE.68@MAIL2.EXAMPLE.COM' union all select doc_id, value from ({_ALL4}) where value <> '10.0.0.1') group by 1",
    "blacklist": "select * from (select doc_id, cast(len(regexp_extract_all(text, '(?i)licensed')) as bigint) as n from documents) where n > 0",
    "samples": f"select entity_type, rank, original from (select 'email_txt' as entity_type, cast(row_number() over (order by doc_id, k) as int) as rank, substr(value, 1, 60) as original from ({_ALL})) where rank <= 5",
    "score_by_quality": f"select quality, cast(sum(score) as bigint) as score from ({_SCORED}) join labels using (doc_id) group by 1",
    "structured_tokens": f"select c_custkey, '[NOM_' || row_number() over (order by c_custkey) || ']' as c_name, '[SEGMENT_' || n || ']' as c_mktsegment, c_nationkey, cast(4 as bigint) as score, 'FAIBLE' as level from customer join ({_SEGMENTS}) on s = c_mktsegment",
    "structured_dictionary": f"select 'nom' as grp, lower(c_name) as norm, c_name as original, row_number() over (order by c_custkey) as num, '[NOM_' || row_number() over (order by c_custkey) || ']' as token from customer union all select 'genre', lower(s), s, n, '[SEGMENT_' || n || ']' from ({_SEGMENTS})",
    "structured_anon": "select s_suppkey, '***' as s_name, cast(row_number() over (order by s_suppkey) as varchar) as s_nationkey, '00 00 00 00 00' as s_acctbal, cast(7 as bigint) as score from supplier",
    "unwrap_props": f"""select event_id, '{{"Report": {{"Id": ' || coalesce('"[ID_' || u.n || ']"', 'null') || ', "Note": "mail [EMAIL_' || w.n || ']", "Rest": "é"}}}}' as body, event_type, cast(4 as bigint) as score from events e left join ({_USERS}) u using (user_id) join ({_NOTES}) w using (user_id)""",
    "nested_arrays": "select c_custkey, 'Prenom' || c_custkey as first, 'voir *** ***' as v0, cast(null as varchar) as v1, cast(6 as bigint) as score from customer",
    "scan_strings": _ONE_PAGE,
    "run_report": f"""select count(*) as records, cast(0 as bigint) as errors, cast(sum(score) as bigint) as score, cast(sum(score) // 3 as bigint) as replacements, (select count(distinct lower(v)) from (select unnest(regexp_extract_all(html, '{EMAIL}')) as v from pages union all select unnest(regexp_extract_all(url, '{EMAIL}')) from pages)) as tokens, case when sum(score) = 0 then '{{}}' else '{{"email_txt":' || cast(sum(score) // 3 as bigint) || '}}' end as by_type from ({_ONE_PAGE})""",
    "fused_spans": f"select doc_id, 'personne' as entity_type, split_part(value, '@', 1) as value, 'ner' as source from ({_ALL}) union all select doc_id, 'ipv4_txt', value, 'regex' from ({_ALL4})",
    "unwrap_inner": f"""select event_id, '{{"Report": {{"Id": ' || coalesce('"[ID_' || u.n || ']"', 'null') || ', "Note": "mail [EMAIL_' || w.n || ']", "Rest": "é"}}}}' as body, cast(4 as bigint) as score from events e left join ({_USERS}) u using (user_id) join ({_NOTES}) w using (user_id) where event_type <> ''""",
    "map_fields": "select c_custkey, '***' as n, '7' as k, 'à ***' as note, cast(6 as bigint) as score from customer",
    "clashing_columns": "select c_custkey, '[E_' || row_number() over (order by c_custkey) || ']' as error, c_acctbal as score, cast(3 as bigint) as risk_score, 'FAIBLE' as level, true as good from customer",
    "file_tokens": f"select source, norm, original, num, '[EMAIL_' || num || ']' as token from (select source, norm, original, row_number() over (partition by source order by p) as num from (select source, lower(trim(value)) as norm, min_by(value, doc_id * 100000 + k) as original, min(doc_id * 100000 + k) as p from ({_ALL}) join documents using (doc_id) group by 1, 2))",
    "file_reports": f"select source, records, cast(0 as bigint) as errors, score, {_LEVEL} as level, replacements, coalesce(tokens, 0) as tokens from (select source, count(*) as records, cast(sum(3 * {_N}) as bigint) as score, cast(sum({_N}) as bigint) as replacements from documents group by 1) left join (select source, count(distinct lower(value)) as tokens from ({_ALL}) join documents using (doc_id) group by 1) using (source)",
    "restore_any": "select c_custkey, 'voir [' || c_name || '] ou ' || c_name as restored, cast(1 as bigint) as n_restored from customer",
    "restore_nested": "select c_custkey, '<' || n_name || '>' as restored, cast(1 as bigint) as n_restored from customer join nation on n_nationkey = c_nationkey",
    "deny_list": "select * from (select doc_id, cast(" + " + ".join(f"len(regexp_extract_all(text, '(?i){w}'))" for w in DENIED) + " as bigint) as n from documents) where n > 0",
    "detector_counts": " union all ".join(f"select '{d.name}' as detector, cast(coalesce(sum(len(regexp_extract_all(text, '{plain_pattern(d)}'))), 0) as bigint) as n from documents" for d in D.DETECTORS if d.name in PLAIN),
    "json_array": "select c_name, c_acctbal, c_nationkey, '}\"{' as odd from customer",
    "json_process": """select event_id, '{"event_id": ' || event_id || ', "body": "{\\"Report\\": {\\"Id\\": \\"***\\"}}", "mail": "***"}' as record, cast(4 as bigint) as score from events""",
    "limit_dry_run": "select c_custkey, '[NOM_' || row_number() over (order by c_custkey) || ']' as c_name, cast(3 as bigint) as score from (select c_custkey from customer order by 1 limit 100)",
    "mapping_draft": values([("c_name", "nom", "NOM")], ("field", "type", "jeton"), ("varchar",) * 3),
    "mapping_check": values([(False, 1, 2)], ("valid", "errors", "warnings"), ("boolean", "bigint", "bigint")),
    "described": "select field, type, records from (values ('c_custkey', 'number'), ('c_name', 'string'), ('c_nationkey', 'number'), ('c_acctbal', 'number'), ('c_mktsegment', 'string')) t(field, type), (select count(*) as records from customer)",
    "compare_ways": values(
        [
            (1, "Jean vit à Paris, écrire à [EMAIL_1]", "[PERSONNE_1] vit à [VILLE_1], écrire à jean@x.fr", "[PERSONNE_1] vit à [VILLE_1], écrire à [EMAIL_1]", "Jean|Paris", "jean@x.fr", "regex+fort"),
            (2, "Jean Xyz vit à Paris depuis hier", "[PERSONNE_1] [PERSONNE_2] vit à [VILLE_1] depuis hier", "[PERSONNE_1] Xyz vit à [VILLE_1] depuis hier", "Jean|Xyz|Paris", "", "hybrid+fort+tech"),
            (3, "tel [TEL_1]", "tel 01 23 45 67 89", "tel [TEL_1]", "", "01 23 45 67 89", "regex+fort"),
            (4, None, None, None, "", "", "regex+fort"), (5, "", "", "", "", "", "regex+fort"),
        ],
        ("id", "rendu_regex", "rendu_ner", "rendu_hybrid", "ner_adds", "regex_adds", "advice"), ("bigint",) + ("varchar",) * 6,
    ),
    "model_names": values([(1, "personne:Jean|ville_txt:Paris"), (2, "personne:Jean|personne:Xyz|ville_txt:Paris"), (3, ""), (4, ""), (5, "")], ("id", "found"), ("bigint", "varchar")),
    "entity_types": values(diagnose.ENTITY_TYPES, ("code", "label", "category"), ("varchar",) * 3),
    "person_keys": values([(i, k) for i, (_, k) in enumerate(L.PERSONS)], ("id", "norm"), ("bigint", "varchar")),
    "contexts": values([(i, c[3]) for i, c in enumerate(L.CONTEXTS)], ("id", "negative"), ("bigint", "boolean")),
    "luhn_literals": values(L.VALIDATORS, ("name", "s", "good"), ("varchar", "varchar", "boolean")),
    "mixed_literals": values([(i, *s) for i, (_, found) in enumerate(L.MIXED) for s in found], ("id", "entity_type", "start", "value"), ("bigint", "varchar", "bigint", "varchar")),
} | {f"detector_{name.lower()}": detector_oracle(name) for name in L.CASES}
