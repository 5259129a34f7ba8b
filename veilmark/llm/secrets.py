"""Secret scanning: every rule in one minimal byte automaton, one pass over a text.

The automaton of all rules (each free to begin at any byte) is walked once over the UTF-8 bytes.  A state's mask
names the rules whose shortest match ends at this byte; a rule's reversed automaton then finds the match's first byte,
and its anchored automaton the last.  Blocks in which no rule ends run in a tight loop on an absorbing copy of the
same automaton, so clean text costs one list access a byte.

Results by case: null and empty texts have no spans; equal rows give equal results; texts of any length are scanned
whole; an empty table gives no rows; columns beside the key and text are not read, and a key named spans is replaced by the
spans; spans of one rule never overlap,
spans of different rules may.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Pattern, compile_dfa, folded, mirrored, shortest
from .common import map_texts

BLOCK = 2048


@dataclass(frozen=True)
class Rule:
    """kind; pattern over bytes; the length a match (or, with value, its trailing value) must reach to be kept.

    either_case folds ASCII letters.  A match that is too short is dropped and the search goes on after it.
    """

    kind: str
    pattern: str
    least: int = 0
    value: str = ""
    either_case: bool = False


#: The base rules, in the order in which equal starts are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6, r"[A-Za-z0-9+/_.=-]+", True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
#: A private key: the header line, header fields of an encrypted key, and its base64 text up to the END line.  Where there
#: is none, pieces of 16 signs or more and the piece after them, so that words after a lone header stay.  Line ends may be
#: written as backslash and letter.
_GAP, _B64, _HEAD = r"([\x20\x09\x0d\x0a]|\\[nrt])", "[A-Za-z0-9+/=]", "[A-Z ]*PRIVATE KEY-----"
_FIELDS = rf"({_GAP}+[A-Za-z][A-Za-z0-9-]*:[\x20-\x7e]*)*"
PEM = rf"-----BEGIN {_HEAD}({_FIELDS}(({_GAP}|{_B64})*-----END {_HEAD}|{_GAP}*{_B64}{{16,}}({_GAP}+{_B64}{{16,}})*({_GAP}+{_B64}+)?))?"
#: Added rules: well-known credential formats with a fixed prefix.  Lengths are bounds on matches rather than counts in
#: the pattern where a prefix may recur inside its own tail: there, counting would multiply the automaton's states.
ADDED = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("payment", r"[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("maps", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 36),
    Rule("pem", PEM),
)
RULES = BASE + ADDED


class Scanner:
    """All rules as transition arrays; scan() gives a text's spans as (start, end, rule) in code points."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [folded(t) if r.either_case else t for r in rules for t in [Pattern(r.pattern).tree]]
        table, self.masks, self.start = compile_dfa([shortest(t) for t in trees], search=True)
        self.states = len(table)
        # Rows that point at rows: stepping needs no state number.  In the absorbing copy every accepting state is one sink.
        self.rows = [[] for _ in table]
        free = [[] for _ in table]
        sink: list = []
        sink.extend([sink] * 256)
        self.sink = sink
        for s, row in enumerate(table):
            self.rows[s].extend(row)
            free[s].extend(sink if self.masks[t] else free[t] for t in row)
        self.free = free
        self.number = {id(r): s for s, r in enumerate(free)}
        self.ahead = [compile_dfa([t], search=False) for t in trees]
        self.back = [compile_dfa([mirrored(shortest(t))], search=False) for t in trees]

    def scan(self, text: str | None) -> list[tuple[int, int, int]]:
        if not text:
            return []
        data = text.encode("utf-8", "surrogatepass")
        found: list[tuple[int, int, int]] = []
        resume = [0] * len(self.rules)
        state, sink = self.start, self.sink
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            row = self.free[state]
            if not self.masks[state]:
                for b in block:
                    row = row[b]
                if row is not sink:
                    state = self.number[id(row)]
                    continue
            rows, masks = self.rows, self.masks
            for i, b in enumerate(block, at + 1):
                state = rows[state][b]
                if masks[state]:
                    self._ends(data, i, masks[state], resume, found)
        if not found:
            return []
        if len(data) != len(text):
            marks = sorted({p for s, e, _ in found for p in (s, e)})
            points, last, n = {}, 0, 0
            for p in marks:
                n += len(data[last:p].decode("utf-8", "surrogatepass"))
                points[p], last = n, p
            found = [(points[s], points[e], k) for s, e, k in found]
        return sorted(found, key=lambda x: (x[0], x[2]))

    def _ends(self, data: bytes, end: int, mask: int, resume: list[int], found: list) -> None:
        for k, rule in enumerate(self.rules):
            if not mask >> k & 1 or end <= resume[k]:
                continue
            table, masks, s = self.back[k]
            first = -1
            for p in range(end - 1, resume[k] - 1, -1):
                s = table[s][data[p]]
                if masks[s]:
                    first = p
                elif self._dead(self.back, k, s):
                    break
            if first < 0:
                continue
            table, masks, s = self.ahead[k]
            last = end
            for p in range(first, len(data)):
                s = table[s][data[p]]
                if masks[s]:
                    last = p + 1
                elif self._dead(self.ahead, k, s):
                    break
            resume[k] = last
            length = last - first
            if rule.value:
                length = self._value(k, data[first:last])
            if length >= rule.least:
                found.append((first, last, k))

    def _value(self, k: int, match: bytes) -> int:
        """Length of the value: what is left of the match after its shortest accepted prefix without the last byte."""
        table, masks, s = self.ahead[k]
        for p, b in enumerate(match):
            s = table[s][b]
            if masks[s]:
                return len(match) - p
        return 0

    @staticmethod
    def _dead(automata, k: int, s: int) -> bool:
        table, masks, _ = automata[k]
        return not masks[s] and table[s].count(s) == 256


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


SPANS = "spans array<struct<kind:string,start:int,end:int>>"


def find_secrets(df: DataFrame, keys: list[str], text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """keys plus spans: every secret of the whole text, ordered by start and then by rule.  Narrow: no shuffle."""

    def setup():
        s = scanner(rules)
        kinds = [r.kind for r in rules]
        return lambda texts: {"spans": [[{"kind": kinds[k], "start": a, "end": b} for a, b, k in s.scan(t)] for t in texts]}

    return map_texts(df, keys, SPANS, setup, text_col)


def redact_secrets(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every secret replaced by mark (overlapping spans by one mark); null stays null."""
    columns = df.columns
    rest = [c for c in columns if c != text_col]

    def setup():
        s = scanner(rules)

        def clean(text):
            spans = s.scan(text)
            if not spans:
                return text
            parts, at = [], 0
            for a, b, _ in spans:
                if a >= at:
                    parts += [text[at:a], mark]
                at = max(at, b)
            return "".join(parts) + text[at:]

        return lambda texts: {"__clean": [clean(t) for t in texts]}

    out = map_texts(df, rest, "__clean string", setup, text_col)
    return out.select(*[F.col("__clean").alias(c) if c == text_col else F.col(c) for c in columns])


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from find_secrets' spans."""
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = [r.kind for r in BASE]
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select(
        "doc_id",
        *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(listed(of(base)).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """The base rules by the re module, for tests."""
    out = []
    text = text or ""
    shapes = {
        "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    }
    for n, (kind, (shape, good)) in enumerate(shapes.items()):
        out += [(m.start(), n, kind, m.end()) for m in shape.finditer(text) if good(m)]
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


__all__ = ["ADDED", "BASE", "RULES", "Rule", "Scanner", "brute_force", "digest", "find_secrets", "redact_secrets", "scanner"]
