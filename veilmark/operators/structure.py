"""Records: structured fields, free-text paths, arrays, JSON kept in a string, looked-up names, and scans without a mapping."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import partial
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.functions.detectors import detect
from veilmark.operators.rewrite import put as put_in
from veilmark.operators.text import POINTS, SPAN, points, risk_level, span_array
from veilmark.operators.tokens import prefix_of, token_dictionary, with_numbers, with_tokens
from veilmark.scratch import keep, small_batches, spread

#: What an irreversible run prints by type; any other type prints MARK, "id" a running number, "uuid" a random one.
CONSTANTS = {"prenom": "***", "nom": "***", "email": "anonyme@example.com", "tel": "00 00 00 00 00", "cp": "00000", "genre": "Non renseigné"}
MARK = "***"
DIRECT = ("nom", "prenom", "email", "tel")
FIELD, TEXT = 0, 1
ARROW_CELL = pa.struct([("kind", pa.int32()), ("ord", pa.int32()), ("elem", pa.int32()), ("value", pa.string()), ("falsy", pa.bool_()), ("written", pa.bool_())])
CELL = "struct<kind:int,ord:int,elem:int,value:string,falsy:boolean,written:boolean>"


@dataclass(frozen=True)
class Mapping:
    """fields: (path, type, printed prefix); texts: paths of free text, "A[].B" for each element of an array; unwrap: a
    column of JSON text; first_name and last_name: paths whose values are looked for in the free text of their record.
    With root the unwrapped column is the whole record, in which all paths lie (and inner is its field of JSON text); with scan
    every string at its top is free text."""

    fields: tuple[tuple[str, str, str], ...] = ()
    texts: tuple[str, ...] = ()
    unwrap: str | None = None
    first_name: str = ""
    last_name: str = ""
    whitelist: tuple[str, ...] = ()
    blacklist: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)
    root: bool = False
    inner: str | None = None
    scan: bool = False

    def within(self, column: str) -> Mapping:
        """This mapping for records that are JSON text in a column; without any path, all their strings are scanned."""
        return replace(self, unwrap=column, inner=self.unwrap, root=True, scan=not (self.fields or self.texts))

    @classmethod
    def from_dict(cls, d: dict) -> Mapping:
        names = d.get("lookup_noms") or {}
        return cls(
            tuple((p, c["type"], c["jeton"]) for p, c in d.get("champs_sensibles", {}).items()), tuple(d.get("texte_libre", ())), ((d.get("structure") or {}).get("unwrap") or {}).get("field"),
            names.get("prenom", ""), names.get("nom", ""), tuple(d.get("whitelist", ())), tuple(d.get("blacklist", ())), d.get("options") or {},
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Mapping:
        """A mapping file, read through Spark, so it may lie in any store."""
        return cls.from_dict(json.loads(spark.read.text(path, wholetext=True).first()[0]))

    @classmethod
    def all_strings(cls, df: DataFrame, *but: str) -> Mapping:
        """No mapping: every top-level string column is free text, in the order of the columns."""
        return cls(texts=tuple(f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in but))


# --- arrays of structs as plain lists, which Python walks several times faster than rows of dictionaries


def flat(lists: pa.Array) -> tuple[list[int], dict[str, list]]:
    """Where each list of structs begins and ends, and the structs' scalar fields; a null list is empty."""
    inner = lists.flatten()
    bounds = [0, *accumulate(pc.fill_null(pc.list_value_length(lists), 0).to_pylist())]
    return bounds, {f.name: c.to_pylist() for f, c in zip(inner.type, inner.flatten(), strict=True) if not pa.types.is_list(f.type)}


def listed(rows: list[list[tuple]], kind: pa.ListType) -> pa.Array:
    """Rows of tuples as an array of lists of structs."""
    whole = [t for r in rows for t in r]
    columns = list(zip(*whole, strict=True)) or [()] * kind.value_type.num_fields
    made = [pa.array(c, f.type) for c, f in zip(columns, kind.value_type, strict=True)]
    bounds = pa.array([0, *accumulate(map(len, rows))], pa.int32())
    return pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(made, fields=list(kind.value_type)), type=kind)


# --- paths into columns


def type_at(schema: T.DataType, path: str):
    """The type at a dotted path through structs and maps with string keys; none where it leads nowhere."""
    kind = schema
    for part in path.split("."):
        if isinstance(kind, T.StructType) and part in kind.names:
            kind = kind[part].dataType
        elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            kind = kind.valueType
        else:
            return None
    return kind


def dig(value: Column, path: str) -> Column:
    for part in path.split(".") if path else ():
        value = value[part]
    return value


def at(path: str) -> Column:
    """The value at a dotted path of struct and map columns."""
    first, _, rest = path.partition(".")
    return dig(F.col(f"`{first}`"), rest)


def with_value(old: Column, kind: T.DataType, parts: list[str], value: Column) -> Column:
    """old with value at a path below it; the structs and keys above it must be there.  Values beside it in a map of
    another type become strings, as the new one is."""
    if not parts:
        return value
    part, *rest = parts
    if isinstance(kind, T.MapType):
        other = (lambda v: v) if rest or isinstance(kind.valueType, T.StringType) else (lambda v: printed(kind.valueType, v))
        return F.transform_values(old, lambda k, v: F.when(k == part, with_value(v, kind.valueType, rest, value)).otherwise(other(v)))
    return old.withField(f"`{part}`", with_value(old[part], kind[part].dataType, rest, value))


def put(df: DataFrame, path: str, value: Column) -> DataFrame:
    """df with value at a dotted path."""
    first, *rest = path.split(".")
    return df.withColumn(first, with_value(F.col(f"`{first}`"), df.schema[first].dataType, rest, value))


def printed(kind, value: Column) -> Column:
    """A scalar as text, booleans with a capital."""
    return F.initcap(value.cast("string")) if isinstance(kind, T.BooleanType) else value.cast("string")


# --- paths into JSON text


def json_get(obj, path: str):
    for part in path.split("."):
        if not isinstance(obj, dict):
            return None
        obj = obj.get(part)
    return obj


def json_set(obj: dict, path: str, value) -> None:
    *above, last = path.split(".")
    for part in above:
        obj = obj.setdefault(part, {})
    obj[last] = value


def parsed(raw):
    """The JSON of a non-empty string; None if there is none."""
    try:
        return json.loads(raw) if raw else None
    except ValueError:
        return None


def opened(raw: str | None, mapping: Mapping) -> tuple:
    """(record, unwrapped object) of a JSON text: the record only if the text is the whole of it."""
    obj = parsed(raw)
    if not mapping.root:
        return None, obj
    text = obj.get(mapping.inner) if mapping.inner and isinstance(obj, dict) else None
    return obj, parsed(text) if isinstance(text, str) else None


def holder(path: str, record, unwrapped) -> dict | None:
    """Dotted paths whose first part the unwrapped object has lie in it, all others in the record."""
    if isinstance(unwrapped, dict) and "." in path and path.split(".")[0] in unwrapped:
        return unwrapped
    return record if isinstance(record, dict) else None


def text_values(obj: dict, path: str) -> list[tuple[int, str, bool]]:
    """(place in the array or -1, text, whether it can be written) at a path of free text."""
    before, arrow, after = path.partition("[]")
    if not arrow:
        v = json_get(obj, path)
        return [(-1, v, True)] if v and isinstance(v, str) else []
    items, after = json_get(obj, before), after.lstrip(".")
    found = [(i, json_get(x, after) if after else x) for i, x in enumerate(items if isinstance(items, list) else ())]
    return [(i, v, bool(after)) for i, v in found if v and isinstance(v, str)]


def json_cells(raw: str | None, mapping: Mapping) -> tuple[list[tuple], list[str], str | None, str | None]:
    """Cells of a record or unwrapped object, the paths (by kind and number) that belong to it, and its two names."""
    record, unwrapped = opened(raw, mapping)
    cells, own = [], []
    for n, (path, *_) in enumerate(mapping.fields):
        if (obj := holder(path, record, unwrapped)) is not None:
            own.append(f"{FIELD} {n}")
            v = json_get(obj, path)
            if v is not None and not (isinstance(v, str) and not v.strip()):
                cells.append((FIELD, n, -1, str(v), not v, True))
    for n, path in enumerate(mapping.texts):
        if (obj := holder(path, record, unwrapped)) is not None:
            own.append(f"{TEXT} {n}")
            cells += [(TEXT, n, i, v, False, w) for i, v, w in text_values(obj, path)]
    if mapping.scan and isinstance(record, dict):
        tops = ((n, v) for n, v in enumerate(record.values()) if isinstance(v, str) and v.strip())
        cells += [(TEXT, n, -1, v, False, True) for n, v in tops]

    def name(path: str) -> str | None:
        obj = holder(path, record, unwrapped) if path else None
        return None if obj is None else str(json_get(obj, path) or "")

    return cells, own, name(mapping.first_name), name(mapping.last_name)


def json_written(raw: str | None, new: list[tuple], mapping: Mapping) -> str | None:
    """The object with its new values (kind, ord, elem, value); numbers become text, null where a token is missing; separators as the json module prints them."""
    record, unwrapped = opened(raw, mapping)
    if unwrapped is None and (record is None or not new):
        return raw
    keys = list(record) if mapping.scan and isinstance(record, dict) else []
    for kind, n, elem, value in new:
        if keys:
            record[keys[n]] = value
            continue
        path = mapping.fields[n][0] if kind == FIELD else mapping.texts[n]
        obj = holder(path, record, unwrapped)
        if obj is None:
            continue
        if elem < 0:
            json_set(obj, path, value)
            continue
        before, after = path.split("[]", 1)
        items = json_get(obj, before)
        if after:
            json_set(items[elem], after.lstrip("."), value)
        else:
            items[elem] = value
    if mapping.root and unwrapped is not None:
        record[mapping.inner] = json.dumps(unwrapped, ensure_ascii=False)
    return json.dumps(record if mapping.root else unwrapped, ensure_ascii=False)


# --- the stages


def element(cell, n: int, after: str, fix_leaks: bool):
    """An array's element and its place as a cell."""
    return lambda x, i: cell(TEXT, n, i, dig(x, after).cast("string"), F.lit(False), bool(after) or fix_leaks)


def swapped(new, mine: Column, kind: T.DataType, after: str):
    """An array's element with its new value, if there is one for its place."""

    def swap(x, i):
        value = new(i)["value"]
        return F.when(mine & new(i).isNotNull(), with_value(x, kind, after.split(".") if after else [], value)).otherwise(x)

    return swap


def with_cells(df: DataFrame, mapping: Mapping, fix_leaks: bool = False) -> DataFrame:
    """df plus __cells (array of cells), __own (paths that the unwrapped object holds), __first and __last."""
    schema, none = df.schema, F.lit(None).cast("string")
    inner = F.struct(F.array().cast(f"array<{CELL}>").alias("cells"), F.array().cast("array<string>").alias("own"), none.alias("first"), none.alias("last"))
    if mapping.unwrap and mapping.unwrap in df.columns:

        @F.arrow_udf(f"struct<cells:array<{CELL}>,own:array<string>,first:string,last:string>")
        def unwrapped(raw: pa.Array) -> pa.Array:
            read = [json_cells(x, mapping) for x in raw.to_pylist()]
            cells, own, *both = zip(*read, strict=True) if read else ((),) * 4
            columns = [listed(cells, pa.list_(ARROW_CELL)), pa.array(own, pa.list_(pa.string())), *(pa.array(x, pa.string()) for x in both)]
            return pa.StructArray.from_arrays(columns, ["cells", "own", "first", "last"])

        inner = unwrapped(F.col(f"`{mapping.unwrap}`").cast("string"))
    df = df.withColumn("__in", inner)
    cell = lambda kind, n, elem, value, falsy, written: F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("ord"), elem.alias("elem"), value.alias("value"), falsy.alias("falsy"), F.lit(written).alias("written"))
    lists, empty = [F.col("__in.cells")], F.array().cast(f"array<{CELL}>")
    outer = lambda kind, n: ~F.array_contains("__in.own", f"{kind} {n}")
    for n, (path, *_) in enumerate(() if mapping.root else mapping.fields):
        kind = type_at(schema, path)
        if kind is not None:
            text = printed(kind, at(path))
            falsy = at(path) == F.lit(0) if isinstance(kind, T.NumericType) else ~at(path) if isinstance(kind, T.BooleanType) else F.lit(False)
            lists.append(F.when(outer(FIELD, n) & (F.trim(text) != ""), F.array(cell(FIELD, n, F.lit(-1), text, falsy, True))).otherwise(empty))
    for n, path in enumerate(() if mapping.root else mapping.texts):
        before, arrow, after = path.partition("[]")
        kind = type_at(schema, before)
        if arrow and isinstance(kind, T.ArrayType):
            after = after.lstrip(".")
            if not after or type_at(kind.elementType, after) is not None:
                made = F.transform(at(before), element(cell, n, after, fix_leaks))
                lists.append(F.when(outer(TEXT, n) & at(before).isNotNull(), F.filter(made, lambda c: F.length(c["value"]) > 0)).otherwise(empty))
        elif not arrow and isinstance(kind, T.StringType):
            lists.append(F.when(outer(TEXT, n) & (F.length(at(path)) > 0), F.array(cell(TEXT, n, F.lit(-1), at(path), F.lit(False), True))).otherwise(empty))
    outer_name = lambda path: at(path).cast("string") if path and not mapping.root and type_at(schema, path) is not None else none
    name = lambda inner, path: F.coalesce(F.col(f"__in.{inner}"), outer_name(path), F.lit(""))
    return df.withColumns({"__cells": F.array_sort(F.concat(*lists)), "__own": F.col("__in.own"), "__first": name("first", mapping.first_name), "__last": name("last", mapping.last_name)}).drop("__in")


def with_cell_spans(df: DataFrame, mapping: Mapping, **options) -> DataFrame:
    """df plus __spans (of each free-text cell, with its ord, elem and written) and __error, the message if a record could
    not be read.  Without free text there is nothing to detect, and nothing runs in Python."""
    kind = f"array<struct<ord:int,elem:int,written:boolean,spans:array<{SPAN}>>>"
    if not (mapping.texts or mapping.scan):
        return df.withColumns({"__spans": F.array().cast(kind), "__error": F.lit(None).cast("string")})
    lists = {"whitelist": frozenset(mapping.whitelist), "blacklist": frozenset(mapping.blacklist)}

    @F.arrow_udf(f"struct<spans:{kind},error:string>")
    def spans(cells: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
        texts, found, errors, sizes = [], [], [], [0]
        bounds, col = flat(cells)
        kinds, values = col["kind"], col["value"]
        for r, (a, b) in enumerate(zip(first.to_pylist(), last.to_pylist(), strict=True)):
            names = {x.strip() for x in (a, b) if x.strip()} if a else ()
            here = [i for i in range(bounds[r], bounds[r + 1]) if kinds[i] == TEXT]
            try:
                found += [detect(values[i], **{**options, **lists, "own": names}) for i in here]
                texts += here
                errors.append(None)
            except Exception as e:  # noqa: BLE001  one record's failure is counted, not the run's
                del found[len(texts) :]
                errors.append(type(e).__name__)
            sizes.append(len(texts))
        place = [*(pa.array([col[k][i] for i in texts], t) for k, t in (("ord", pa.int32()), ("elem", pa.int32()), ("written", pa.bool_()))), span_array(found)]
        rows = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(place, ["ord", "elem", "written", "spans"]))
        return pa.StructArray.from_arrays([rows, pa.array(errors, pa.string())], ["spans", "error"])

    return df.withColumn("__found", spans("__cells", "__first", "__last")).withColumns({"__spans": F.col("__found.spans"), "__error": F.col("__found.error")}).drop("__found")


def free_names(columns: list[str]) -> tuple[str, str, str]:
    """score, level and error, or where the records have such columns risk_score and so on."""
    out = []
    for name in ("score", "level", "error"):
        while name in columns:
            name = f"risk_{name}"
        out.append(name)
    return tuple(out)


@dataclass
class Processed:
    """rows: the records, rewritten, with score, level and error (see names); tokens: the dictionary (none if irreversible);
    occurrences: one row a replacement, with its place (key, __row, kind, ord, elem, span_ord), type, value and token.
    With per, tokens and occurrences have that column too, under the name place (of_<per> where they have one of its name)."""

    rows: DataFrame
    tokens: DataFrame | None
    occurrences: DataFrame
    #: What the columns score, level and error are called: risk_score and so on, where records have columns of these names.
    names: tuple[str, str, str] = ("score", "level", "error")
    per: str | None = None
    place: str | None = None

    @property
    def scored(self) -> DataFrame:
        """score, level and error of each record (and its per), for the reports."""
        own = [F.col(f"`{self.per}`")] if self.per else []
        return self.rows.select(*own, *[F.col(a).alias(b) for a, b in zip(self.names, ("score", "level", "error"), strict=True)])


def occurrences_of(rows: DataFrame, key: str, mapping: Mapping, per: str | None) -> DataFrame:
    """One row a field or span of records that could be read."""
    kinds = F.lit([t for _, t, _ in mapping.fields] or [""])
    jetons = F.lit([p for *_, p in mapping.fields] or [""])
    good = rows.filter(F.col("__error").isNull())
    pos = [*([F.col(f"`{per}`").alias("__per")] if per else []), F.col(f"`{key}`").alias("__key"), "__row"]
    none = F.lit(None).cast("int")
    cells = good.select(*pos, F.explode("__cells").alias("c")).filter(F.col("c.kind") == FIELD)
    kind = F.get(kinds, F.col("c.ord"))
    names = pos[:-2] and ["__per"]
    fields = cells.select(
        *names, "__key", "__row", "c.kind", "c.ord", "c.elem", F.lit(0).alias("span_ord"), kind.alias("entity_type"), F.get(jetons, F.col("c.ord")).alias("prefix"), "c.value", none.alias("start"), none.alias("end"),
        F.when(kind.isin(*DIRECT), "direct").otherwise("indirect").alias("risk_type"), F.lit("mapping").alias("source"), "c.falsy", F.lit(True).alias("written"),
    )
    spans = good.select(*pos, F.explode("__spans").alias("x")).select(*names, "__key", "__row", "x.ord", "x.elem", "x.written", F.posexplode("x.spans").alias("span_ord", "s"))
    texts = spans.select(
        *names, "__key", "__row", F.lit(TEXT).alias("kind"), "ord", "elem", "span_ord", "s.entity_type", prefix_of(F.col("s.entity_type")).alias("prefix"), "s.value", "s.start", "s.end",
        "s.risk_type", "s.source", F.lit(False).alias("falsy"), "written",
    )
    if not (mapping.texts or mapping.scan):
        return fields
    return fields.unionByName(texts) if mapping.fields else texts


def constants(occ: DataFrame, mapping: Mapping, order: list[str], per: str | None) -> DataFrame:
    """occ plus token: what an irreversible run prints."""
    constant = F.lit(MARK)
    for k, v in CONSTANTS.items():
        constant = F.when(F.col("entity_type") == k, v).otherwise(constant)
    fixed = F.when(F.col("kind") == TEXT, MARK).when(F.col("entity_type") == "uuid", F.uuid()).otherwise(constant)
    ids = (F.col("kind") == FIELD) & (F.col("entity_type") == "id")
    done = occ.filter(~ids).withColumn("token", fixed)
    if any(t == "id" for _, t, _ in mapping.fields):
        counted = with_numbers(occ.filter(ids).withColumn("__pos", F.struct(*order)), [*(["__per"] if per else []), "entity_type"], "__pos")
        done = done.unionByName(counted.select(*occ.columns, F.col("num").cast("string").alias("token")))
    return done


def process(df: DataFrame, key: str, mapping: Mapping, how: str = "pseudo", numbering: str = "type", fix_leaks: bool = False, per: str | None = None, deal: bool = True, **options) -> Processed:
    """Records by a mapping: how "pseudo" prints tokens, "anon" constants.

    Numbers follow key, then fields, then free text, element and place in the text; with per, a column's name, each of its
    values has a dictionary of its own (files of one folder).  A field that is 0 or false becomes null, elements of an array of
    plain strings are scored but stay (fix_leaks writes them), a failing record stays as it was.  Columns of numbers that are
    rewritten become strings.  Records and their spans are kept once; only replacements travel, and not even those where
    constants hold for each record alone (anon without running numbers or random ones).  Null or equal keys are told
    apart; an empty table gives empty tables; columns named score, level or error stay, see Processed.names.
    With deal, records that lie in a few tasks are dealt to all (their rows are counted for it; not for costly plans).
    """
    small_batches(df.sparkSession)
    given = df.withColumn("__row", F.monotonically_increasing_id())
    laid = with_cell_spans(with_cells(spread(given, "__row") if deal else given, mapping, fix_leaks), mapping, **options)
    rows = keep(laid, "records")
    occ = occurrences_of(rows, key, mapping, per)
    order, own = ["__key", "__row", "kind", "ord", "elem"], "__per" if per else None
    words = None
    if how == "pseudo":
        words = token_dictionary(occ.filter(~F.col("falsy")), *order, numbering=numbering, per=own)
        done = with_tokens(occ, words, numbering, own).withColumn("token", F.when((F.col("kind") == TEXT) | ~F.col("falsy"), F.col("token")))
    else:
        done = constants(occ, mapping, order, per)
    alone = how != "pseudo" and not any(t in ("id", "uuid") for _, t, _ in mapping.fields)
    done = done if alone else keep(done, "replacements")
    own = with_own_constants(rows, mapping) if alone else with_own(rows, done)
    names = free_names(df.columns)
    place = per
    while place and place in {*done.columns, *(words.columns if words is not None else ())}:
        place = f"of_{place}"
    named = lambda t: t if t is None or not per else t.withColumnRenamed("__per", place)
    return Processed(rewritten(own, df, mapping, fix_leaks, names), named(words), named(done), names, per, place)


FRESH = "array<struct<kind:int,ord:int,elem:int,value:string>>"


def with_fresh(out: DataFrame, mapping: Mapping) -> DataFrame:
    """out with __new as new values of cells instead of their pieces, and the unwrapped column with them put in.

    One pass for all; its columns cannot be moved by later filters, which Spark's planner would do to functions of a join."""
    raw = mapping.unwrap if mapping.unwrap in out.columns else None
    given = out.withColumn("__cells", F.when(F.size("__new") > 0, F.col("__cells"))).drop("__spans", "__first", "__last")
    if raw:
        given = given.withColumn(raw, F.col(f"`{raw}`").cast("string"))
    passed = [c for c in given.columns if c not in ("__cells", "__new", raw)]
    target = T.StructType([given.schema[c] for c in passed] + ([given.schema[raw]] if raw else []) + list(T.StructType.fromDDL(f"__new {FRESH}").fields))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(target)
        for b in batches:
            col = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            fresh = new_values(col["__cells"], col["__new"])
            made = [col[c] for c in passed]
            if raw:
                lines = zip(col[raw].to_pylist(), fresh, col["__error"].to_pylist(), strict=True)
                made.append(pa.array([r if e is not None else json_written(r, n, mapping) for r, n, e in lines], pa.string()))
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(made, schema)), listed(fresh, schema.field("__new").type)], schema=schema)

    return given.mapInArrow(run, target)


def new_values(cells: pa.Array, new: pa.Array) -> list[list[tuple]]:
    """(kind, ord, elem, value) of each record's cells that are written: a field's token, or a text with its parts put in."""
    at, cell = flat(cells)
    bounds, col = flat(new)
    inner = new.flatten()
    parts, piece = flat(inner.flatten()[inner.type.get_field_index("pieces")])
    pieces = list(zip(piece["start"], piece["end"], piece["repl"], strict=True))
    written, places = col["written"], list(zip(col["kind"], col["ord"], col["elem"], strict=True))
    out = []
    for r in range(len(new)):
        mine = [i for i in range(bounds[r], bounds[r + 1]) if written[i]]
        texts = {}
        if any(places[i][0] == TEXT for i in mine):
            texts = {(cell["ord"][c], cell["elem"][c]): cell["value"][c] for c in range(at[r], at[r + 1]) if cell["kind"][c] == TEXT}
        row = []
        for i in mine:
            kind, n, elem = places[i]
            own = pieces[parts[i] : parts[i + 1]]
            row.append((kind, n, elem, own[0][2] if kind == FIELD else put_in(texts[n, elem], own)))
        out.append(row)
    return out


#: What is put into a record: of each cell its pieces, by place.
NEW = "array<struct<kind:int,ord:int,elem:int,written:boolean,pieces:array<struct<start:int,end:int,repl:string>>>>"


def with_own(rows: DataFrame, done: DataFrame) -> DataFrame:
    """rows plus __new and __score, of their replacements, which travel once."""
    place = ["kind", "ord", "elem", "written"]
    piece = F.struct("start", "end", F.col("token").alias("repl"))
    own = done.repartition("__row").groupBy("__row", *place).agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.sum(points(F.col("risk_type"))).alias("points"))
    own = own.groupBy("__row").agg(F.collect_list(F.struct(*place, "pieces")).alias("__new"), F.sum("points").cast("bigint").alias("__score"))
    out = rows.join(own, "__row", "left")
    return out.withColumns({"__score": F.coalesce("__score", F.lit(0)).cast("bigint"), "__new": F.coalesce("__new", F.array().cast(own.schema["__new"].dataType))})


def with_own_constants(rows: DataFrame, mapping: Mapping) -> DataFrame:
    """rows plus __new and __score where what is printed depends on the record alone: nothing travels."""
    shown = F.lit([CONSTANTS.get(t, MARK) for _, t, _ in mapping.fields] or [""])
    weight = F.lit([POINTS["direct" if t in DIRECT else "indirect"] for _, t, _ in mapping.fields] or [0])
    none, empty = F.lit(None).cast("int"), F.array().cast(NEW)
    piece = lambda start, end, repl: F.struct(start.alias("start"), end.alias("end"), repl.alias("repl"))
    new = lambda kind, x, written, pieces: F.struct(kind.alias("kind"), x["ord"].alias("ord"), x["elem"].alias("elem"), written.alias("written"), pieces.alias("pieces"))
    fields = F.filter("__cells", lambda c: c["kind"] == FIELD)
    texts = F.filter("__spans", lambda x: F.size(x["spans"]) > 0)
    of_fields = F.transform(fields, lambda c: new(F.lit(FIELD), c, F.lit(True), F.array(piece(none, none, F.get(shown, c["ord"])))))
    of_texts = F.transform(texts, lambda x: new(F.lit(TEXT), x, x["written"], F.transform(x["spans"], lambda s: piece(s["start"], s["end"], F.lit(MARK)))))
    score = F.aggregate(fields, F.lit(0), lambda n, c: n + F.get(weight, c["ord"])) + F.aggregate(F.flatten(F.transform(texts, lambda x: x["spans"])), F.lit(0), lambda n, s: n + points(s["risk_type"]))
    good = F.col("__error").isNull()
    return rows.withColumns({"__new": F.when(good, F.concat(of_fields.cast(NEW), of_texts.cast(NEW))).otherwise(empty), "__score": F.when(good, score).otherwise(F.lit(0)).cast("bigint")})


def rewritten(own: DataFrame, df: DataFrame, mapping: Mapping, fix_leaks: bool, names: tuple[str, str, str]) -> DataFrame:
    """Records with what is put into them (own), written there."""
    out = own.drop("__row")
    if mapping.texts or mapping.scan or mapping.unwrap in df.columns:
        out = with_fresh(out, mapping)
    else:
        fresh = F.transform("__new", lambda c: F.struct(c["kind"].alias("kind"), c["ord"].alias("ord"), c["elem"].alias("elem"), F.get(c["pieces"], F.lit(0))["repl"].alias("value")))
        out = out.withColumn("__new", fresh)
    made = out
    of = lambda kind, n, elem: F.get(F.filter("__new", lambda c: (c["kind"] == kind) & (c["ord"] == n) & (c["elem"] == elem)), F.lit(0))
    mine = lambda kind, n: ~F.array_contains("__own", f"{kind} {n}")
    for n, (path, *_) in enumerate(() if mapping.root else mapping.fields):
        kind = type_at(df.schema, path)
        if kind is not None:
            new = of(FIELD, n, -1)
            made = put(made, path, F.when(mine(FIELD, n) & new.isNotNull(), new["value"]).otherwise(printed(kind, at(path))))
    for n, path in enumerate(() if mapping.root else mapping.texts):
        before, arrow, after = path.partition("[]")
        kind, after = type_at(df.schema, before), after.lstrip(".")
        if arrow and isinstance(kind, T.ArrayType) and (after or fix_leaks):
            made = put(made, before, F.transform(at(before), swapped(partial(of, TEXT, n), mine(TEXT, n), kind.elementType, after)))
        elif not arrow and isinstance(kind, T.StringType):
            new = of(TEXT, n, -1)
            made = put(made, path, F.when(mine(TEXT, n) & new.isNotNull(), new["value"]).otherwise(at(path)))
    score, level, error = names
    return made.select(*[F.col(f"`{c}`") for c in df.columns], F.col("__score").alias(score), risk_level(F.col("__score")).alias(level), F.col("__error").alias(error))
