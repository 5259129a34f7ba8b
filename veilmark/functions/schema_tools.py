"""Mappings for a table: a first draft from its columns, a check, and a description of its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of column names, tried in this order; the second table adds what the command line knows besides.
HINTS = {
    "nom": ("nom", "name", "lastname", "surname"), "prenom": ("prenom", "firstname", "given"), "email": ("email", "mail", "courriel"),
    "tel": ("tel", "phone", "telephone", "mobile"), "cp": ("cp", "postal", "zip", "code_postal"), "id": ("id", "ident", "identifiant"),
}
MORE_HINTS = {"nom": ("family",), "id": ("numero",)}
VALID_TYPES = ("cb", "cp", "cvv", "email", "genre", "iban", "id", "nir", "nom", "prenom", "siren", "siret", "tel", "uuid")
LONG = 50


def generate(df: DataFrame, name: str = "", variant: str = "api") -> dict:
    """A draft: columns whose name holds a hint are fields, other strings of over LONG characters in the first row free text."""
    first = df.limit(1).collect()
    out = {"description": f"Mapping {'automatique' if variant == 'api' else 'auto'} pour {name}", "champs_sensibles": {}, "texte_libre": [], "lookup_noms": {}, "whitelist": [], "blacklist": []}
    for c in df.columns if first else ():
        kind = next((k for k, hints in HINTS.items() if any(h in c.lower() for h in hints + (MORE_HINTS.get(k, ()) if variant == "cli" else ()))), None)
        if kind:
            out["champs_sensibles"][c] = {"type": kind, "jeton": kind.upper()}
        elif isinstance(first[0][c], str) and len(first[0][c]) > LONG:
            out["texte_libre"].append(c)
    return out


def validate_mapping(mapping: dict, df: DataFrame | None = None) -> dict:
    """valide, erreurs, avertissements; with a table, columns that it lacks are warned of."""
    errors, warnings = [], []
    fields, texts = mapping.get("champs_sensibles", {}), mapping.get("texte_libre", [])
    if "champs_sensibles" not in mapping and "texte_libre" not in mapping:
        errors.append("Le mapping doit contenir au moins 'champs_sensibles' ou 'texte_libre'")
    for c, config in fields.items():
        errors += [f"Champ '{c}' : '{k}' manquant" for k in ("type", "jeton") if k not in config]
        if config.get("type", VALID_TYPES[0]) not in VALID_TYPES:
            warnings.append(f"Champ '{c}' : type '{config['type']}' non standard (valides : {', '.join(VALID_TYPES)})")
    lost = [c for c in fields if c.split(".")[0] not in df.columns] + [c for c in texts if c.split(".")[0].split("[")[0] not in df.columns] if df is not None else []
    if lost:
        warnings.append(f"Champs absents du fichier : {', '.join(lost)}")
    return {"valide": not errors, "erreurs": errors, "avertissements": warnings}


def analyze(df: DataFrame) -> DataFrame:
    """field, type, length, example, keys of the first row's values; booleans count as numbers, as in the reference."""
    spark, first = df.sparkSession, df.limit(1).collect()
    rows = []
    for f in df.schema if first else ():
        v = first[0][f.name]
        if isinstance(v, str):
            rows.append((f.name, "string", len(v), v[:100], None))
        elif isinstance(v, (int, float)):
            rows.append((f.name, "number", None, str(v), None))
        elif isinstance(v, (list, tuple)) and not isinstance(f.dataType, T.StructType):
            rows.append((f.name, "array", len(v), None, None))
        elif v is not None and isinstance(f.dataType, (T.StructType, T.MapType)):
            rows.append((f.name, "object", None, None, list(v.asDict() if hasattr(v, "asDict") else v)[:10]))
        else:
            rows.append((f.name, "NoneType" if v is None else type(v).__name__, None, None, None))
    return spark.createDataFrame(rows, "field string, type string, length int, example string, keys array<string>").join(F.broadcast(df.agg(F.count("*").alias("records"))))
