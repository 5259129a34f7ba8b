"""Detector registry, validators and the per-text span kernel."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple


class Span(NamedTuple):
    start: int
    end: int
    entity_type: str
    value: str
    score: float
    source: str
    risk_type: str


def digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def luhn_raw(s: str) -> bool:
    """Luhn over 9 digits or more."""
    if len(s) < 9 or not s.isdigit():
        return False
    total = sum(int(c) for c in s[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in s[-2::-2])
    return total % 10 == 0


def luhn_check(s: str) -> bool:
    """Card numbers: 9 and 14 digits are left to company numbers."""
    d = digits(s)
    return len(d) not in (9, 14) and luhn_raw(d)


def siret_check(s: str) -> bool:
    d = digits(s)
    return len(d) in (9, 14) and luhn_raw(d)


def nir_check(s: str) -> bool:
    """Thirteen significant characters with a month from 01 to 12; the key is not verified."""
    d = re.sub(r"[\s.\-]", "", s)
    d = d[:13] if len(d) == 15 else d
    return len(d) == 13 and d[3:5].isdigit() and 1 <= int(d[3:5]) <= 12


def iban_check(s: str) -> bool:
    d = re.sub(r"[\s\-]", "", s).upper()
    if len(d) < 15 or not (d.isascii() and d.isalnum()):
        return False
    return int("".join(str(int(c, 36)) for c in d[4:] + d[:4])) % 97 == 1


# Words that make a number near them something else than personal data.
_BEFORE = re.compile(r"\b(?:n°|n\.|numéro|décret|article|art\.|référence|ref\.|dossier|commande|lot|page|p\.|chapitre|volume|tome|fig\.|figure|tableau|tab\.|kg|g|m|cm|mm|km|€|eur|euros|%|degrés?)\s*$", re.I)
_AFTER = re.compile(r"\s*(?:kg|g|m|cm|mm|km|€|eur|euros|%|degrés?|°|exemplaires?|pages?)", re.I)


def negative_context(text: str, at: int, length: int) -> bool:
    """A unit or numbering word within 20 characters before, or right after (no word boundary is asked for there)."""
    return bool(_BEFORE.search(text[max(0, at - 20) : at]) or _AFTER.match(text[at + length : at + length + 20]))


@dataclass(frozen=True)
class Detector:
    name: str
    entity_type: str
    risk: str
    pattern: str
    check: str = ""
    flags: int = 0
    #: Without one of these in the text there is no match.
    need: str | tuple[str, ...] = ""
    group: str = ""
    #: Characters that a match begins with a run of, up to an @.
    run: frozenset = frozenset()
    #: Without one of these, in lower case, in a text in lower case there is no match.
    words: tuple[str, ...] = ()
    #: Signs of which a match holds so many.
    signs: tuple[str, int] = ("", 0)

    def possible(self, text: str, plain: str | None) -> bool:
        """Whether a text can hold a match; plain: it in lower case, or none where that may hide a match without regard to case."""
        return (
            any(x in text for x in ((self.need,) if isinstance(self.need, str) else self.need))
            and (not self.words or plain is None or any(w in plain for w in self.words))
            and sum(map(text.count, self.signs[0])) >= self.signs[1]
        )

    def compiled(self):
        return re.compile(self.pattern, self.flags)

    def matches(self, shape, text: str):
        """As finditer; where a run leads to an @, only the run's first character is tried, so long runs take linear time."""
        if not self.run:
            yield from shape.finditer(text)
            return
        done, at = 0, text.find("@")
        while at >= 0:
            first = at
            while first > done and text[first - 1] in self.run:
                first -= 1
            m = shape.match(text, first) if first < at else None
            if m:
                yield m
                done = m.end()
            at = text.find("@", max(at + 1, done))


I = re.I  # noqa: E741
ROADS = ("rue", "avenue", "boulevard", "chemin", "impasse", "allée", "route", "bis", "ter")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.+-")
#: The patterns, types and risks, in order of emission, which breaks ties.  A match of the group skip is none: it
#: passes over a run in which no later start can match either, so long runs are not tried again from each word; possessive
#: repeats are the same values without a second try.
DETECTORS = (
    Detector("NUM_FISCAL", "fiscal_txt", "finance", r"\b[0-3]\d{12}\b", "context"),
    Detector("NIR", "nir_txt", "finance", r"(?<!\d)([12])[\s.\-]*(\d{2})[\s.\-]*(\d{2})[\s.\-]*(\d{2}|2[AB])[\s.\-]*(\d{3})[\s.\-]*(\d{3})(?:[\s.\-]*(\d{2}))?(?!\d)", "nir", I),
    Detector("IBAN", "iban_txt", "finance", r"\b[A-Z]{2}\d{2}[\s\-]?[0-9A-Z]{4}[\s\-]?[0-9A-Z]{4}[\s\-]?[0-9A-Z]{4}[\s\-]?[0-9A-Z]{4}[\s\-]?[0-9A-Z]{4}[\s\-]?[0-9A-Z]{4}[\s\-]?[0-9A-Z]{0,4}[\s\-]?[0-9A-Z]{0,3}\b", "iban", I),
    Detector("CB", "cb_txt", "finance", r"\b(?:\d[\s\-]*?){13,19}\b", "luhn"),
    Detector("CVV", "cvv_txt", "finance", r"\b(cvv|cvc|cryptogramme|cv2)\W+(\d{3,4})\b", "", I, words=("cv", "cryptogramme")),
    Detector("SIRET", "siret_txt", "indirect", r"\b\d{3}[\s.]?\d{3}[\s.]?\d{3}(?:[\s.]?\d{5})?\b", "siret"),
    Detector("MAILTO", "email_txt", "direct", r"\b(mailto):([a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)", "", I, "@"),
    Detector("EMAIL_OBFUSCATED", "email_txt", "direct", r"\b[a-zA-Z0-9_.+-]++\s*+(?:@|\[at\]|\(at\)|\[arobase\])\s*[a-zA-Z0-9-]+\s*(?:\.|\[dot\]|\(dot\)|point)\s*[a-zA-Z0-9-.]+\b|\b(?P<skip>[a-zA-Z0-9_.+-]++)", "", I, ("@", "[", "(")),
    Detector("EMAIL_AVEC", "email_txt", "direct", r"\b(De|From|À|A|To|Cc|Bcc)\s*:\s*([A-ZÀ-ÖØ-Ý][A-Za-zÀ-ÖØ-öø-ÿ\'\-]+(?:\s+[A-ZÀ-ÖØ-Ý][A-Za-zÀ-ÖØ-öø-ÿ\'\-]+)*)\s*<[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+>", "", I, "@"),
    Detector("EMAIL_ESPACE", "email_txt", "direct", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+(?:\s*\.\s*|\s+|\.)[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-.]+)*", "", 0, "@", "", LOCAL),
    Detector("EMAIL", "email_txt", "direct", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", "", 0, "@", "", LOCAL),
    Detector("TEL_FUZZY", "tel_txt", "direct", r"(?<!\d)(?:(?:\+|00)33|0)\s*[1-9](?:[\s._\-]*\d){8}(?!\d)"),
    Detector("TEL_PREFIXE", "tel_txt", "direct", r"TEL\s*:\s*[\d\s.\-]+", "", I, ":"),
    Detector("TEL", "tel_txt", "direct", r"(?<!\d)(?:\+33|0)[1-9](?:[\s.\-]*\d{2}){4}(?!\d)"),
    Detector("URL", "url_txt", "indirect", r"\bhttps?://\S+|\bwww\.\S+", "", 0, ("http", "www.")),
    Detector("ORGA", "orga_txt", "indirect", r"\b([A-ZÀ-ÖØ-Ý][A-Za-zÀ-ÖØ-öø-ÿ&\'\-]+(?:\s+[A-ZÀ-ÖØ-Ý][A-Za-zÀ-ÖØ-öø-ÿ&\'\-]+)*)\s+(SA|SAS|SARL|SNC|EURL|SASU|SCI|SCM|SCOP|SEM|GIE|ASSOCIATION|FONDATION)\b|\b(?P<skip>[A-ZÀ-ÖØ-Ý][A-Za-zÀ-ÖØ-öø-ÿ&\'\-]+(?:\s+[A-ZÀ-ÖØ-Ý][A-Za-zÀ-ÖØ-öø-ÿ&\'\-]+)*)", "", 0, ("SA", "SNC", "EURL", "SC", "SEM", "GIE", "ASSOCIATION", "FONDATION")),
    Detector("VOIE_NUM", "voie_txt", "indirect", r"\b\d+\s+(?:rue|avenue|boulevard|chemin|impasse|allée|route|bis|ter)\s+[A-Za-zÀ-ÖØ-öø-ÿ'\-\s]{3,}", "", I, words=ROADS),
    Detector("VOIE_SANS", "voie_txt", "indirect", r"\b(?:rue|avenue|boulevard|chemin|impasse|allée|route)\s+[A-Za-zÀ-ÖØ-öø-ÿ'\-\s]{3,}", "", I, words=ROADS[:-2]),
    Detector("CP", "cp_txt", "indirect", r"\b\d{5}\b", "context"),
    Detector("DATE_NAISS", "date_naiss_txt", "direct", r"\b(né|née|naissance)(?:e|s)?\s++(?:(?:le|du|au)\s*+)?(?::\s*+)?(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})\b", "", I, "", "fort", words=("né", "naissance")),
    Detector("GPS", "gps_txt", "indirect", r"\b-?(?:[1-8]?\d\.\d+|90\.0+)[,\s]+-?(?:1(?:[0-7]\d)|[1-9]?\d)\.\d+\b", "", 0, ".", "fort"),
    Detector("PLAQUE", "plaque_txt", "indirect", r"\b(?:[A-Z]{2}[-\s]?\d{3}[-\s]?[A-Z]{2}|\d{1,4}[-\s]?[A-Z]{2,3}[-\s]?\d{2})\b", "", 0, "", "fort"),
    Detector("VILLE_COMPOSEE", "ville_txt", "indirect", r"\b[A-ZÀ-ÖØ-Ý]{3,}(?:[\s-](?:SUR|SOUS|LES|AUX|LEZ|LÈZ|DE|DU|D')[\s-][A-ZÀ-ÖØ-Ý]{3,})+\b", "", 0, ("SUR", "SOUS", "LES", "AUX", "LEZ", "LÈZ", "DE", "DU", "D'"), "fort"),
    Detector("IPV4", "ipv4_txt", "tech", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", "", 0, ".", "tech"),
    Detector("IPV6", "ipv6_txt", "tech", r"(?:[a-fA-F0-9]{1,4}:){7}[a-fA-F0-9]{1,4}|(?:[a-fA-F0-9]{1,4}:){1,7}:|::(?:[a-fA-F0-9]{1,4}:){0,5}[a-fA-F0-9]{1,4}", "", 0, ":", "tech"),
    Detector("MAC", "mac_txt", "tech", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", "", 0, "", "tech", signs=(":-", 5)),
    Detector("JWT", "jwt_txt", "tech", r"\beyJ[a-zA-Z0-9_-]{10,}+\.eyJ[a-zA-Z0-9_-]{10,}+\.[a-zA-Z0-9_-]{10,}\b|\b(?P<skip>eyJ[a-zA-Z0-9_-]*+)", "", 0, "eyJ", "tech"),
    Detector("API_KEY", "api_key_txt", "tech", r"\b(?:sk|pk|api)_[a-zA-Z0-9]{20,}\b", "", 0, "_", "tech"),
)
_CHECKS = {"luhn": luhn_check, "siret": siret_check, "nir": nir_check, "iban": iban_check}
_READY = [(d, d.compiled()) for d in DETECTORS]
#: Detectors none of whose matches lacks a digit.
NUMERIC = frozenset({"NUM_FISCAL", "NIR", "IBAN", "CB", "CVV", "SIRET", "TEL_FUZZY", "TEL", "VOIE_NUM", "CP", "DATE_NAISS", "GPS", "PLAQUE", "IPV4"})
FINANCE = frozenset({"fiscal_txt", "nir_txt", "iban_txt", "cb_txt", "cvv_txt", "siret_txt"})


DIGIT, ODD = re.compile(r"\d"), re.compile("[\u017f\u0131\u0130\u212a]")


def detect_regex(text: str | None, fort: bool = False, tech: bool = False, only: frozenset | None = None) -> list[Span]:
    """All detectors on the original text, overlaps folded: a later span replaces the last only if strictly longer."""
    found = []
    digit = bool(text) and bool(DIGIT.search(text))
    # Long s, dotless and dotted i and the Kelvin sign match letters that lower() does not make of them.
    plain = None if not text or ODD.search(text) else text.lower()
    for n, (d, shape) in enumerate(_READY if text else ()):
        if d.name in NUMERIC and not digit or (d.group == "fort" and not fort) or (d.group == "tech" and not tech) or (only and d.name not in only) or not d.possible(text, plain):
            continue
        for m in d.matches(shape, text):
            v = m.group()
            if m.lastgroup == "skip" or d.check in _CHECKS and not _CHECKS[d.check](v) or d.check == "context" and negative_context(text, m.start(), len(v)):
                continue
            found.append((m.start(), -m.end(), n, Span(m.start(), m.end(), d.entity_type, v, 1.0, "regex", d.risk)))
    kept: list[Span] = []
    for *_, s in sorted(found, key=lambda x: x[:3]):
        if kept and s.start < kept[-1].end:
            if s.end - s.start > kept[-1].end - kept[-1].start:
                kept[-1] = s
        else:
            kept.append(s)
    return kept


def winner(a: Span, b: Span) -> Span:
    """Of two overlapping spans: validated finance first, then the model over rules, then length, then the first."""
    for s in (a, b):
        if s.source == "regex" and s.entity_type in FINANCE:
            return s
    if a.source != b.source and "ner" in (a.source, b.source):
        return a if a.source == "ner" else b
    return b if b.end - b.start > a.end - a.start else a


def fuse(rules: list[Span], model: list[Span]) -> list[Span]:
    kept: list[Span] = []
    for s in sorted([*rules, *model], key=lambda s: (s.start, -s.end)):
        if kept and s.start < kept[-1].end and kept[-1].start < s.end:
            kept[-1] = winner(kept[-1], s)
        else:
            kept.append(s)
    return kept


def unaccented(word: str) -> str:
    return unicodedata.normalize("NFD", word).encode("ascii", "ignore").decode("ascii")


def known_name(word: str, first: frozenset, family: frozenset = frozenset()) -> bool:
    """A listed first name, with or without its accents, or a listed family name; lists are in capitals."""
    key = word.upper().strip()
    return len(word) >= 2 and (key in first or unaccented(key) in first or key in family)


class Folded(dict):
    """For str.translate: characters that match each other without regard to case get one character."""

    def __missing__(self, point: int) -> int:
        c = chr(point)
        key = c.lower()[0].upper()
        self[point] = out = ord(key) if len(key) == 1 else min(map(ord, self.same.setdefault(key, [c])))
        return out

    def __init__(self):
        super().__init__()
        # A character whose capital is several, by that capital.
        self.same: dict[str, list[str]] = {}


FOLD = Folded()
#: So many entries are looked for one by one; more of them by an automaton.
FEW = 8


def places(word: str, text: str):
    """Where word stands without regard to case, from the left, without overlap.  A pattern is made only if a character beyond
    ASCII may match otherwise: names that each record brings along would cost one a record."""
    if not (word.isascii() and text.isascii()):
        for m in re.finditer(re.escape(word), text, re.I):
            yield m.start()
        return
    word, text = word.lower(), text.lower()
    at = text.find(word)
    while at >= 0:
        yield at
        at = text.find(word, at + len(word))


class Denied:
    """Entries looked for without regard to case: (rank, start, end) of each entry's matches, the longest entry first."""

    def __init__(self, entries: frozenset[str]):
        self.entries = sorted((w for w in entries if w), key=lambda w: (-len(w), w))
        self.automaton = None
        if len(self.entries) > FEW:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for k, w in enumerate(self.entries):
                f = w.translate(FOLD)
                self.automaton.add_word(f, [*self.automaton.get(f, ()), k])
            self.automaton.make_automaton()
            self.shapes = [re.compile(re.escape(w), re.I) for w in self.entries]

    def matches(self, text: str):
        if not self.automaton:
            for w in self.entries:
                for start in places(w, text):
                    yield (-len(w), w), start, start + len(w)
            return
        last: dict[int, int] = {}
        for end, ranks in self.automaton.iter(text.translate(FOLD)):
            for k in ranks:
                w = self.entries[k]
                start = end + 1 - len(w)
                # As one search for the entry alone finds them: from the left, without overlap.
                if start >= last.get(k, 0) and (text[start : end + 1] == w or self.shapes[k].match(text, start)):
                    last[k] = end + 1
                    yield (-len(w), w), start, end + 1


@lru_cache(maxsize=8)
def denied(entries: frozenset[str]) -> Denied:
    return Denied(entries)


@lru_cache(maxsize=8)
def capitals(words: frozenset[str]) -> frozenset[str]:
    return frozenset(w.upper() for w in words)


def apply_lists(text: str, spans: list[Span], whitelist=(), blacklist=(), own=()) -> list[Span]:
    """Drops spans whose whole value is allowed, then adds denied entries (of a list that many texts share, and of this text's
    own), the longest first, where no span lies yet."""
    if whitelist:
        allowed = capitals(frozenset(whitelist))
        spans = [s for s in spans if s.value.upper() not in allowed]
    if blacklist or own:
        covered = bytearray(len(text))
        for s in spans:
            covered[s.start : s.end] = b"\1" * (min(s.end, len(text)) - s.start)
        found = set(denied(frozenset(blacklist)).matches(text)) if blacklist else set()
        if own:
            found.update(Denied(frozenset(own)).matches(text))
        spans = list(spans)
        for _, start, end in sorted(found):
            if covered.find(1, start, end) < 0:
                covered[start:end] = b"\1" * (end - start)
                spans.append(Span(start, end, "personne", text[start:end], 1.0, "blacklist", "direct"))
    return sorted(spans, key=lambda s: (s.start, -s.end))


def detect(text, mode="regex", fort=False, tech=False, whitelist=(), blacklist=(), ner=None, names=frozenset(), family=frozenset(), only=None, own=()) -> list[Span]:
    """Detect, fuse, check model persons against names (not if None), then allow and deny lists.

    Without a model, or if it fails on a text, the rules alone decide.  Deny entries (blacklist, and own for this text alone) never overlap kept spans.
    """
    text = text or ""
    model = None
    if ner and mode in ("ner", "hybrid") and text:
        try:
            model = list(ner(text))
        except Exception:  # noqa: BLE001  a model's failure on a text leaves the rules
            model = None
    spans = model if mode == "ner" and model is not None else fuse(detect_regex(text, fort, tech, only), model or [])
    if names is not None:
        spans = [s for s in spans if not (s.source == "ner" and s.entity_type == "personne" and s.score < 0.7) or any(known_name(w, names, family) for w in s.value.split())]
    return apply_lists(text, spans, whitelist, blacklist, own)
