"""Tokens: numbered by first appearance, listed in a dictionary, and turned back."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmark.operators.rewrite import candidates, splice, turned_back
from veilmark.scratch import keep

#: Printed prefixes of entity types; any other type prints its own name in capitals.
PREFIXES = {
    "id": "ID", "uuid": "UUID", "prenom": "PRENOM", "nom": "NOM", "email": "EMAIL", "tel": "TEL", "cp": "CP", "genre": "GENRE",
    "email_txt": "EMAIL", "tel_txt": "TEL", "iban_txt": "IBAN", "nir_txt": "NIR", "cb_txt": "CB", "cvv_txt": "CVV", "siret_txt": "SIRET",
    "siren_txt": "SIREN", "fiscal_txt": "ID_FISCAL", "url_txt": "URL", "voie_txt": "VOIE", "orga_txt": "ORGANISATION", "ville_txt": "VILLE",
    "date_naiss_txt": "DATE_NAISSANCE", "adresse_txt": "ADRESSE", "ip_txt": "IP", "ipv4_txt": "IPV4", "ipv6_txt": "IPV6", "mac_txt": "MAC",
    "jwt_txt": "JWT", "api_key_txt": "API_KEY", "plaque_txt": "PLAQUE", "gps_txt": "GPS", "date_txt": "DATE", "montant_txt": "MONTANT",
    "personne": "PERSONNE",
}
#: How numbers are given: by type (two types of one prefix may share a token), by prefix, or by prefix and exact value (lossless).
NUMBERING = ("type", "prefix", "exact")


def prefix_of(kind):
    pairs = [x for k, v in PREFIXES.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), kind), F.upper(kind))


def person_key(col):
    """Persons match whatever the order of two names: tokens and titles off, letters only, lower case, two words sorted."""
    plain = F.regexp_replace(F.trim(col), r"(?i)\[PERSONNE_\d+\]", "")
    plain = F.regexp_replace(plain, r"(?i)\b(?:m\.|mme\.?|mlle\.?|monsieur|madame)\b", "")
    plain = F.lower(F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^A-Za-zÀ-ÖØ-öø-ÿ\-' ]+", " "), r"\s+", " ")))
    words = F.split(plain, " ")
    return F.when((F.size(words) == 2) & ~plain.contains("'"), F.array_join(F.array_sort(words), " ")).otherwise(plain)


def norm_of(kind, value, numbering: str):
    """What values of one token have in common."""
    if numbering == "exact":
        return value
    return F.when(kind == "personne", person_key(value)).otherwise(F.lower(F.trim(value)))


def with_numbers(df: DataFrame, group: str | list[str], order: str) -> DataFrame:
    """df as a kept table plus num: 1, 2, ... in each group by order.

    Rows are range-partitioned and sorted, and a number is a row's place in its partition plus what earlier partitions
    hold of its group: one row for each partition and group in it, so no task gets a whole group.
    """
    by = [group] if isinstance(group, str) else list(group)
    laid = keep(df.repartitionByRange(*by, order).sortWithinPartitions(*by, order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    parts = laid.groupBy(*by, F.shiftright("__at", 33).alias("__p")).agg(F.count("*").alias("__n"), F.min("__at").alias("__lo"))
    earlier = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")
    parts = parts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(by)], "__p", "__lo", before)
    same = F.shiftright("__at", 33) == F.col("__p")
    for i, g in enumerate(by):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return laid.join(parts, same).withColumn("num", F.col("__at") - F.col("__lo") + F.col("__before") + 1).select(*df.columns, "num")


def occurrences(rows: DataFrame, *order: str) -> DataFrame:
    """One row a span of rows (a table with spans and __row): order columns, __row, span_ord, and the span's fields."""
    return rows.select(*order, "__row", F.posexplode("spans").alias("span_ord", "s")).select(*order, "__row", "span_ord", "s.*")


def token_dictionary(spans: DataFrame, *order: str, numbering: str = "type", per: str | None = None) -> DataFrame:
    """grp, prefix, norm, original, num, token: one row a token of occurrences entity_type, value (and prefix, if there is
    such a column), numbered by first appearance along the order columns.  Values without a norm have no number and no row.
    With per (a column's name) each of its values has a dictionary of its own, and it comes first."""
    if numbering not in NUMBERING:
        raise ValueError(f"numbering is one of {NUMBERING}")
    own = [per] if per else []
    prefix = F.col("prefix") if "prefix" in spans.columns else prefix_of(F.col("entity_type"))
    group = (F.col("entity_type") if numbering == "type" else prefix).alias("grp")
    norm = norm_of(F.col("entity_type"), F.col("value"), numbering).alias("norm")
    occ = spans.select(*own, group, prefix.alias("prefix"), norm, F.struct(*order, "span_ord").alias("pos"), "value").filter(F.length("norm") > 0)
    text = F.col("value") if numbering == "exact" else F.trim("value")
    first = occ.groupBy(*own, "grp", "norm").agg(F.min_by(text, "pos").alias("original"), F.min("pos").alias("pos"), F.collect_set("prefix").alias("prefixes"))
    done = with_numbers(first, [*own, "grp"], "pos").withColumn("prefix", F.explode("prefixes"))
    return done.select(*own, "grp", "prefix", "norm", "original", "num", F.concat(F.lit("["), "prefix", F.lit("_"), F.col("num").cast("string"), F.lit("]")).alias("token"))


def with_tokens(occ: DataFrame, words: DataFrame, numbering: str = "type", per: str | None = None) -> DataFrame:
    """occ plus token: [PREFIX] where a value has no norm."""
    prefix = F.col("prefix") if "prefix" in occ.columns else prefix_of(F.col("entity_type"))
    keyed = occ.withColumns({"__prefix": prefix, "__grp": F.col("entity_type") if numbering == "type" else prefix, "__norm": norm_of(F.col("entity_type"), F.col("value"), numbering)})
    own = [per] if per else []
    known = words.select(*own, F.col("grp").alias("__grp"), F.col("prefix").alias("__prefix"), F.col("norm").alias("__norm"), "token")
    found = keyed.join(known, [*own, "__grp", "__prefix", "__norm"], "left")
    return found.withColumn("token", F.coalesce("token", F.concat(F.lit("["), "__prefix", F.lit("]")))).select(*occ.columns, "token")


def last_tokens(words: DataFrame) -> DataFrame:
    """token, original: one row a token; of several the last by num and type stays, as a file of them would be read."""
    return words.groupBy("token").agg(F.max_by("original", F.struct("grp", "num")).alias("original"))


def token_shape(words: DataFrame) -> tuple[str, list[int], str]:
    """What tokens of a dictionary begin with, how long they are, and what they end with: one row, bounded by the alphabet."""
    of = lambda c: F.sort_array(F.collect_set(c))
    r = words.filter(F.length("token") > 0).agg(of(F.substring("token", 1, 1)), of(F.length("token")), of(F.substring("token", -1, 1))).first()
    return "".join(r[0]), sorted(r[1], reverse=True), "".join(r[2])


def restore(df: DataFrame, words: DataFrame, text_col: str = "result", nested: bool = False) -> DataFrame:
    """df plus restored and n_restored: tokens back to their originals, and how many different tokens were found.

    Tokens may have any prefix: they are found by what the dictionary's own begin and end with and how long they are.  Only
    what could be a token travels, once a text.  Restored values are not looked through again, but with nested: then
    tokens within originals that are shorter than the original's own token are turned back as well, as by one replacement after
    the other, the longest token first.  Null text stays null; a token that the dictionary lacks stays as it is; columns named
    like the outputs are replaced.
    """
    first, lengths, last = token_shape(words)
    rows = keep(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("id", F.monotonically_increasing_id()), "masked")
    known = last_tokens(words)
    if nested:
        known = _without_nested(known, first, lengths, last)
    found = _back(rows, known, first, lengths, last)
    return found.select(*[F.col("row")[c].alias(c) for c in df.columns if c not in ("restored", "n_restored")], "restored", "n_restored")


def _back(rows: DataFrame, known: DataFrame, first: str, lengths: list[int], last: str, limit: bool = False) -> DataFrame:
    """rows (id, text, most if limit, ...) plus restored and n_restored."""
    openers, closers = re.compile(f"[{re.escape(first)}]") if first else re.compile("(?!)"), frozenset(last)

    @F.arrow_udf("array<string>")
    def possible(texts: pa.Array) -> pa.Array:
        return pa.array([[] if t is None else candidates(t, openers, lengths, closers) for t in texts.to_pylist()], pa.list_(pa.string()))

    @F.arrow_udf("string")
    def back(texts: pa.Array, tokens: pa.Array, originals: pa.Array) -> pa.Array:
        all_rows = zip(texts.to_pylist(), tokens.to_pylist(), originals.to_pylist(), strict=True)
        return pa.array([None if t is None or not k else turned_back(t, dict(zip(k, v, strict=True)), openers, lengths) for t, k, v in all_rows], pa.string())

    asked = rows.select("id", *(["most"] if limit else []), F.explode(possible("text")).alias("token"))
    if limit:
        asked = asked.filter(F.length("token") < F.col("most"))
    pairs = asked.join(known, "token").groupBy("id").agg(F.collect_list(F.struct("token", "original")).alias("known"))
    joined = rows.join(pairs, "id", "left")
    of = lambda name: F.transform("known", lambda p: p[name])
    some = F.col("known").isNotNull()
    return joined.withColumns({"restored": F.coalesce(back(F.when(some, F.col("text")), of("token"), of("original")), F.col("text")), "n_restored": F.coalesce(F.size("known"), F.lit(0)).cast("bigint")})


def _without_nested(known: DataFrame, first: str, lengths: list[int], last: str) -> DataFrame:
    """The dictionary with tokens in its originals turned back, shorter ones in longer ones, until none is left."""
    now = keep(known, "originals")
    for _ in lengths[1:]:
        rows = now.select(F.col("token").alias("id"), F.col("original").alias("text"), F.length("token").alias("most"))
        now = keep(_back(rows, now, first, lengths, last, limit=True).select(F.col("id").alias("token"), F.col("restored").alias("original"), F.col("n_restored").alias("n")), "originals")
        left = now.filter("n > 0").limit(1).count()
        now = now.select("token", "original")
        if not left:
            break
    return now


__all__ = ["NUMBERING", "PREFIXES", "last_tokens", "norm_of", "occurrences", "person_key", "prefix_of", "restore", "splice", "token_dictionary", "token_shape", "with_numbers", "with_tokens"]
