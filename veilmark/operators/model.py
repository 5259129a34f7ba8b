"""The model operator: entities of a named-entity model as spans, long texts in parts with true offsets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from veilmark.functions.detectors import Span

#: Labels asked for by default, the types they become, and the risk of each type.
LABELS = ("personne", "email", "téléphone", "adresse", "IBAN", "numéro de sécurité sociale", "carte bancaire", "adresse IP", "date de naissance", "organisation", "lieu", "date")
TYPES = {
    "personne": "personne", "person": "personne", "email": "email_txt", "téléphone": "tel_txt", "phone number": "tel_txt", "adresse": "adresse_txt",
    "address": "adresse_txt", "IBAN": "iban_txt", "numéro de sécurité sociale": "nir_txt", "carte bancaire": "cb_txt", "adresse IP": "ip_txt",
    "date de naissance": "date_naiss_txt", "organisation": "orga_txt", "organization": "orga_txt", "lieu": "ville_txt", "location": "ville_txt", "date": "date_txt",
}
RISKS = {
    "personne": "direct", "email_txt": "direct", "tel_txt": "direct", "adresse_txt": "indirect", "iban_txt": "finance", "nir_txt": "finance",
    "cb_txt": "finance", "ip_txt": "tech", "date_naiss_txt": "direct", "orga_txt": "indirect", "ville_txt": "indirect", "date_txt": "indirect",
}
PART, NEAR = 10_000, 50
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def parts(text: str, most: int = PART) -> Iterable[tuple[int, str]]:
    """(offset, part): whole sentences, as many as fit into most characters, one at least."""
    if len(text) <= most:
        yield 0, text
        return
    first = last = 0
    for m in [*SENTENCE_END.finditer(text), None]:
        end = m.start() if m else len(text)
        if end - first > most and last > first:
            yield first, text[first:last]
            first = begin
        last, begin = end, m.end() if m else end
    if last > first:
        yield first, text[first:last]


def apart(spans: list[Span], distance: int = NEAR) -> list[Span]:
    """Without spans of one type and value (in lower case) less than distance from the start of one kept before; by start."""
    seen: dict[tuple, int] = {}
    kept = []
    for s in spans:
        key = (s.entity_type, s.value.lower())
        if key not in seen or s.start - seen[key] >= distance:
            seen[key] = s.start
            kept.append(s)
    return kept


class Model:
    """text -> spans, for the option ner of detect_spans.

    load() makes, once in each worker, a function (text, labels) -> entities (label, start, end, value, confidence).
    """

    def __init__(self, load: Callable[[], Callable], labels: tuple[str, ...] = LABELS, threshold: float = 0.4):
        self.load, self.labels, self.threshold, self._ready = load, labels, threshold, None

    def __getstate__(self):
        return {**self.__dict__, "_ready": None}

    def __call__(self, text: str) -> list[Span]:
        self._ready = self._ready or self.load()
        found = []
        for offset, part in parts(text):
            for label, start, end, value, confidence in self._ready(part, self.labels):
                if confidence >= self.threshold:
                    kind = TYPES.get(label, label)
                    found.append(Span(start + offset, end + offset, kind, value, round(confidence, 4), "ner", RISKS.get(kind, "indirect")))
        found.sort(key=lambda s: (s.start, -s.end))
        return apart(found) if len(text) > PART else found
