"""Diagnostics: spans as rows, six ways to detect side by side, what the model adds, the list of types, which mode to take."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions.detectors import detect, detect_regex
from veilmark.operators.text import SPANS, detect_spans
from veilmark.operators.tokens import PREFIXES

#: Code, label and category of the types that are listed to users.
ENTITY_TYPES = (
    ("personne", "Personnes", "direct"), ("email_txt", "Emails", "direct"), ("tel_txt", "Téléphones", "direct"), ("adresse_txt", "Adresses", "indirect"), ("iban_txt", "IBAN", "finance"),
    ("nir_txt", "N° Sécu. sociale", "finance"), ("cb_txt", "Carte bancaire", "finance"), ("ip_txt", "Adresse IP", "tech"), ("date_naiss_txt", "Date de naissance", "direct"), ("orga_txt", "Organisations", "indirect"),
    ("ville_txt", "Lieux", "indirect"), ("siret_txt", "SIRET/SIREN", "indirect"), ("url_txt", "URLs", "indirect"), ("voie_txt", "Adresses postales", "indirect"), ("cp_txt", "Codes postaux", "indirect"),
)
WAYS = ("regex", "regex_fort", "regex_fort_tech", "ner", "hybrid", "hybrid_fort_tech")


def entity_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTITY_TYPES, "code string, label string, category string")


def extract(df: DataFrame, key: str, text_col: str = "text", **options) -> DataFrame:
    """key, text, type, start, end, score, source, risk_type: one row a span."""
    found = detect_spans(df, text_col, **options).select(F.col(key), F.explode("spans").alias("s"))
    return found.select(key, F.col("s.value").alias("text"), F.col("s.entity_type").alias("type"), "s.start", "s.end", "s.score", "s.source", "s.risk_type")


def rendering(text: str, spans: list) -> str:
    """Text with tokens numbered within it alone."""
    numbers: dict[str, dict[str, int]] = {}
    out, at = [], 0
    for s in spans:
        own = numbers.setdefault(s.entity_type, {})
        n = own.setdefault(s.value.strip().lower(), len(own) + 1)
        out += [text[at : s.start], f"[{PREFIXES.get(s.entity_type, s.entity_type.upper())}_{n}]"]
        at = s.end
    return "".join([*out, text[at:]])


def compare(df: DataFrame, key: str, text_col: str = "text", ner=None, fort: bool = False, tech: bool = False, **lists) -> DataFrame:
    """key, spans_<way> and rendu_<way> for each of WAYS, ner_adds and regex_adds (values of one that the other lacks, in order).

    All ways run in one pass over the text.  "regex" and "ner" are raw; "hybrid" goes through names and lists.
    """

    def ways(t: str) -> dict:
        try:
            model = list(ner(t)) if ner and t else []
        except Exception:  # noqa: BLE001  as in detect: without the model, the rules alone
            model = []
        once = lambda _: model
        return {
            "regex": detect_regex(t, fort, tech), "regex_fort": detect_regex(t, True), "regex_fort_tech": detect_regex(t, True, True), "ner": model,
            "hybrid": detect(t, "hybrid", fort, tech, ner=once, **lists), "hybrid_fort_tech": detect(t, "hybrid", True, True, ner=once, **lists),
        }

    kind = "struct<" + ",".join(f"spans_{w}:{SPANS},rendu_{w}:string" for w in WAYS) + ">"

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            found = ways(t or "")
            out.append({f"spans_{w}": [s._asdict() for s in found[w]] for w in WAYS} | {f"rendu_{w}": None if t is None else rendering(t, found[w]) for w in WAYS})
        return pd.DataFrame(out, columns=[f"{x}_{w}" for w in WAYS for x in ("spans", "rendu")])

    found = df.select(key, run(F.col(text_col)).alias("r")).select(key, "r.*")
    values = lambda c: F.transform(c, lambda s: s["value"])
    less = lambda a, b: F.filter(values(a), lambda v: ~F.array_contains(values(b), v))
    return found.withColumns({"ner_adds": less("spans_ner", "spans_regex"), "regex_adds": less("spans_regex", "spans_ner")})


def recommended(compared: DataFrame) -> DataFrame:
    """compared plus advice: the model, where it adds more than two values and more than the rules do."""
    better = (F.size("ner_adds") > 2) & (F.size("ner_adds") > F.size("regex_adds"))
    return compared.withColumn("advice", F.when(better, "hybrid+fort+tech").otherwise("regex+fort"))


def health(lists: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """list, n: the size of each word list."""
    out = spark.createDataFrame([], "list string, n bigint")
    for name, words in lists.items():
        out = out.unionByName(words.agg(F.count("*").alias("n")).select(F.lit(name).alias("list"), "n"))
    return out
