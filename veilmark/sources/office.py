"""Office files by Spark: each file is read by one task into rows; written files are bounded, as the formats are.

XLSX, ODS, ODT and DOCX are zipped XML and need no library; PDF needs pdfplumber, XLS a library that reads the old format.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a sheet can hold.
SHEET_ROWS = 1_048_576
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_TABLE, _TEXT, _OFFICE = ("{urn:oasis:names:tc:opendocument:xmlns:" + x + ":1.0}" for x in ("table", "text", "office"))


def _part(data: bytes, name: str):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return ET.fromstring(z.read(name)) if name in z.namelist() else None


def xlsx_rows(data: bytes) -> Iterator[list[str]]:
    """Rows of the first sheet as text, empty cells as ''."""
    shared = _part(data, "xl/sharedStrings.xml")
    words = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in shared] if shared is not None else []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sheet = min((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    for row in _part(data, sheet).iter(f"{_MAIN}row"):
        out: list[str] = []
        for c in row.iter(f"{_MAIN}c"):
            letters = re.match(r"[A-Z]*", c.get("r", "")).group()
            at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else len(out)
            out += [""] * (at - len(out))
            v = c.find(f"{_MAIN}v")
            text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if c.get("t") == "inlineStr" else v.text or "" if v is not None else ""
            out.append(words[int(text)] if c.get("t") == "s" and text else text)
        yield out


def ods_rows(data: bytes) -> Iterator[list[str]]:
    """Rows of the first sheet; repeated cells count once, as the reference reads them."""
    table = next(_part(data, "content.xml").iter(f"{_TABLE}table"), None)
    for row in table.iter(f"{_TABLE}table-row") if table is not None else ():
        yield ["".join(p.text or "" for p in cell.iter(f"{_TEXT}p")) for cell in row.iter(f"{_TABLE}table-cell")]


def docx_text(data: bytes) -> str:
    body = _part(data, "word/document.xml").find(f"{_WORD}body")
    lines = ("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in body.findall(f"{_WORD}p"))
    return "\n".join(x for x in lines if x.strip())


def odt_text(data: bytes) -> str:
    lines = ("".join(p.itertext()) for p in _part(data, "content.xml").iter(f"{_TEXT}p"))
    return "\n".join(x for x in lines if x.strip())


def pdf_text(data: bytes) -> str:
    import pdfplumber  # optional

    with pdfplumber.open(io.BytesIO(data)) as pdf:
        return "\n\n".join(x for x in (p.extract_text() for p in pdf.pages) if x)


SHEETS = {"xlsx": xlsx_rows, "ods": ods_rows}
TEXTS = {"docx": docx_text, "odt": odt_text, "pdf": pdf_text}


def office_records(spark: SparkSession, paths: list[str], header: bool = True) -> DataFrame:
    """file, rec_idx and record: the rows of sheets under each file's own first row (or col_i), documents as one record of
    texte and _source, as JSON text.  A file that cannot be read gives one row with its error instead."""

    def read(batches):
        for b in batches:
            for path, data in zip(b["path"], b["content"], strict=True):
                kind = path.rsplit(".", 1)[-1].lower()
                out, error = [], None
                try:
                    if kind in TEXTS:
                        out = [{"texte": TEXTS[kind](bytes(data)), "_source": path.rsplit("/", 1)[-1]}]
                    elif kind in SHEETS:
                        rows = list(SHEETS[kind](bytes(data)))
                        names = rows[0] if rows and header else [f"col_{i}" for i in range(len(rows[0]) if rows else 0)]
                        out = [{n: r[i] if i < len(r) else "" for i, n in enumerate(names)} for r in rows[int(header) :]]
                    else:
                        raise ValueError(f"no reader for .{kind}")
                except Exception as e:  # noqa: BLE001  one file's failure leaves the others
                    error = f"{type(e).__name__}: {e}"
                records = [json.dumps(r, ensure_ascii=False) for r in out] if error is None else [None]
                yield pd.DataFrame({"file": path, "at": range(len(records)), "record": records, "file_error": error})

    found = spark.read.format("binaryFile").load(paths).select("path", "content")
    made = found.mapInPandas(read, "file string, at bigint, record string, file_error string")
    return made.select("file", F.struct(F.lit(0).cast("bigint").alias("block"), "at").alias("rec_idx"), "record", "file_error")


def load_office(spark: SparkSession, path: str, kind: str, header: bool = True) -> DataFrame:
    """Sheets: strings under the first row's names (or col_i); documents: texte and _source."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if kind in TEXTS:
        read = TEXTS[kind]

        def texts(batches):
            for b in batches:
                yield pd.DataFrame({"texte": [read(bytes(x)) for x in b["content"]], "_source": [p.rsplit("/", 1)[-1] for p in b["path"]]})

        return files.mapInPandas(texts, "texte string, _source string")
    rows_of = SHEETS[kind]

    def sheet(batches):
        for b in batches:
            for data in b["content"]:
                rows = list(rows_of(bytes(data)))
                yield pd.DataFrame({"rec_idx": range(len(rows)), "cells": rows})

    rows = files.mapInPandas(sheet, "rec_idx bigint, cells array<string>")
    first = rows.filter("rec_idx = 0").select("cells").first()
    names = list(first[0]) if first and header else [f"col_{i}" for i in range(len(first[0]) if first else 0)]
    return rows.filter(F.col("rec_idx") >= int(header)).orderBy("rec_idx").select(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text, zipfile.ZIP_STORED if name == "mimetype" else None)
    return out.getvalue()


def xlsx_file(rows: list[list[str]]) -> bytes:
    cells = lambda r: "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c>' for x in r)
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return _zip({
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>' + "".join(f"<row>{cells(r)}</row>" for r in rows) + "</sheetData></worksheet>",
    })


def _open_document(kind: str, body: str) -> bytes:
    spaces = f'xmlns:office="{_OFFICE[1:-1]}" xmlns:table="{_TABLE[1:-1]}" xmlns:text="{_TEXT[1:-1]}"'
    mime = f"application/vnd.oasis.opendocument.{kind}"
    return _zip({
        "mimetype": mime,
        "content.xml": f'<office:document-content {spaces} office:version="1.2"><office:body><office:{kind}>{body}</office:{kind}></office:body></office:document-content>',
        "META-INF/manifest.xml": f'<manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0" manifest:version="1.2"><manifest:file-entry manifest:full-path="/" manifest:media-type="{mime}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>',
    })


def ods_file(rows: list[list[str]]) -> bytes:
    line = lambda r: "<table:table-row>" + "".join(f"<table:table-cell><text:p>{escape(x)}</text:p></table:table-cell>" for x in r) + "</table:table-row>"
    return _open_document("spreadsheet", '<table:table table:name="Sheet1">' + "".join(map(line, rows)) + "</table:table>")


def odt_file(lines: list[str]) -> bytes:
    return _open_document("text", "".join(f"<text:p>{escape(x)}</text:p>" for x in lines))


def docx_file(lines: list[str]) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines)
    return _zip({
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{_WORD[1:-1]}"><w:body>{body}</w:body></w:document>',
    })


def save_office(df: DataFrame, path: str, kind: str, most: int = SHEET_ROWS - 1) -> None:
    """One file, so at most `most` rows: more raise, and belong into CSV or JSON folders."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows do not fit into one .{kind} file; save them as csv or json")
    if kind in ("xlsx", "ods"):
        lines = [df.columns, *([("" if v is None else str(v)) for v in r] for r in rows)]
        data = (xlsx_file if kind == "xlsx" else ods_file)(lines)
    else:
        lines = [x for r in rows for x in (r["texte"] or "").split("\n") if x.strip()]
        data = (docx_file if kind == "docx" else odt_file)(lines)
    spark = df.sparkSession
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to, True)
    out.write(bytearray(data))
    out.close()
