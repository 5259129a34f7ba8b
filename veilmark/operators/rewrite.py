"""Texts rewritten in one pass: parts put in at spans, tokens found and turned back.  All kernels take time in proportion to
the text and its spans, and only texts that have something to change are sent to Python."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def put(text: str, pieces) -> str:
    """text with pieces (start, end, new part; by start, without overlap) put in."""
    out, at = [], 0
    for start, end, new in pieces:
        out.append(text[at:start])
        out.append(new)
        at = end
    out.append(text[at:])
    return "".join(out)


@F.arrow_udf(StringType())
def _spliced(texts: pa.Array, starts: pa.Array, ends: pa.Array, parts: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist(), parts.to_pylist(), strict=True)
    return pa.array([None if t is None or not a else put(t, zip(a, b, c, strict=True)) for t, a, b, c in rows], pa.string())


def splice(text: Column, pieces: Column) -> Column:
    """Text with pieces (struct start, end, repl; by start, without overlap) put in; null stays null, as do texts without pieces."""
    some = F.size(pieces) > 0
    of = lambda name: F.when(some, F.transform(pieces, lambda p: p[name]))
    return F.coalesce(_spliced(F.when(some, text), of("start"), of("end"), of("repl")), text)


def candidates(text: str, openers: re.Pattern, lengths: list[int], closers: frozenset) -> list[str]:
    """Parts of text that could be tokens by their first and last characters and their length, each once."""
    found: dict[str, None] = {}
    for m in openers.finditer(text):
        at = m.start()
        for n in lengths:
            end = at + n
            if end <= len(text) and text[end - 1] in closers:
                found[text[at:end]] = None
    return list(found)


def turned_back(text: str, known: dict[str, str], openers: re.Pattern, lengths: list[int]) -> str:
    """Tokens replaced by their originals, from the left, the longest first; what is put in is not looked through."""
    out, at = [], 0
    for m in openers.finditer(text):
        start = m.start()
        if start < at:
            continue
        for n in lengths:
            original = known.get(text[start : start + n])
            if original is not None:
                out += [text[at:start], original]
                at = start + n
                break
    out.append(text[at:])
    return "".join(out)
